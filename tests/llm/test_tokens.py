"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querymill.llm import bpe, queries, token_file

SF = "/root/testdata/sf0.01"
HARD = [
    None, "", " ", "a", "''s 's'S I'm", "<|endoftext|>x<|ENDOFTEXT|> <|endof", "é é́ ÀÉ ǅ İ ΑΣ ß", "a\x1c\x1db\xa0c d\u0085e", "1234567 ½ ² ..,,!! ‍😀😀👩‍👩‍👧",
    "word " * 3000, "ab" * 5000, "a" * 7001, "é" * 3000, "!?" * 4000, "的" * 3000, " " * 9000, "x<|endoftext|>" * 900, "́" * 500,
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(bpe.tokenizer_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def test_pieces_and_joins_give_the_ids_of_the_whole(spark, tok):
    rng = random.Random(3)
    letters = "abcdefgh'st 12.,!é́ß\n<|>"
    texts = HARD + ["".join(rng.choices(letters, k=rng.randint(1, 3000))) for _ in range(40)] + ["".join(rng.choices("theandingo", k=3000)) for _ in range(10)]
    df = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(texts)], "doc_id long, text string, ids string, _row long")
    for size in (37, 500):
        for r in (bpe.encode(df, piece_bytes=size, decoded=True) if size > 100 else bpe.decode(bpe.encode(df, piece_bytes=size))).collect():
            want = ids_of(tok, texts[r.doc_id])
            assert np.frombuffer(r.ids, "<u4").tolist() == want, (size, texts[r.doc_id] and texts[r.doc_id][:60])
            assert r.decoded == tok.decode(want, skip_special_tokens=False)


def test_op6_equals_the_library_on_all_documents(spark, tok):
    got = {r.doc_id: r for r in queries.op6_bpe_round_trip(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = ids_of(tok, d.text)
        assert got[d.doc_id].n_tokens == len(want)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(tok.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_op8_equals_the_library_on_all_documents(spark, tok):
    got = {r.doc_id: r for r in queries.op8_token_files(spark, SF).collect()}
    start = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        want = ids_of(tok, d.text) + [2]
        r = got.pop(d.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert not got


@pytest.mark.parametrize("case", ["random", "outliers", "equal", "short", "wide", "none"])
def test_images_round_trip_and_read_ranges(case):
    rng = np.random.default_rng(1)
    ids = {
        "random": rng.integers(0, 49408, 5000), "outliers": np.where(rng.random(3000) < 0.05, 2**32 - 1, rng.integers(0, 9, 3000)), "equal": np.full(1000, 7),
        "short": np.array([5]), "wide": rng.integers(0, 2**32, 700), "none": np.zeros(0),
    }[case].astype("<u4")
    lengths = [len(ids) // 3, 0, len(ids) - len(ids) // 3]
    image = token_file.image_of(ids, lengths, [-5, None, 2**40])
    back, n, names = token_file.read_image(image)
    assert (back == ids).all() and n.tolist() == lengths and names == [-5, None, 2**40]
    for a, b in [(0, 1), (255, 257), (300, 299), (len(ids) // 2, len(ids))]:
        assert (token_file.read_ids(image, a, min(b, len(ids))) == ids[a : min(b, len(ids))]).all()


def test_token_files_of_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(3, "b a"), (None, "x"), (3, "b a"), (1, None), (2, "")], "doc_id long, text string")
    rows = [tuple(r) for r in token_file.read_token_files(token_file.write_token_files(df, shard_ids=2)).select("doc_id", "start", "n_tokens").orderBy(F.col("start")).collect()]
    assert rows == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 3), (3, 7, 3)]
    assert token_file.read_token_files(token_file.write_token_files(df.limit(0))).count() == 0
    assert bpe.encode(df.limit(0)).count() == 0


def fuzz_texts(seed, n):
    """Short texts over scripts, combining and trailing marks, spellings of special tokens, case pairs and white space."""
    rng = random.Random(seed)
    pools = [
        "abcdefgXYZ", "éèêëïîôöùüÿçñåÅÉßẞſ", "İıǅǆŉŀĿΣσςΩΩKÅ", "жщЫЯёЁ", "अआकखि", "的一是不", "กขคงจ", "شسيبا", "ｱｲｳﾞ", "ﬁﬂ½²①Ⅷ",
        "ְ́̇̈ͅि", ".,!?;:)", "'\"-_(#*&", "0123456789", "😀👩‍👧‍️", "\x00\x1c\x85\xa0 　",
    ]
    words = ["'s", "'ll", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|end", "the", "and", "İ;", "i̇.", "</w>"]
    for _ in range(n):
        part = rng.sample(pools, rng.randint(1, 3))
        yield "".join(rng.choice(words) if rng.random() < 0.06 else " " if rng.random() < 0.12 else rng.choice(rng.choice(part)) for _ in range(rng.randint(1, 24)))


def test_random_texts_of_many_scripts_equal_the_library(tok):
    texts = list(fuzz_texts(11, 60_000))
    coder = bpe.WordCoder(bpe.tokenizer_path())
    for k in range(0, len(texts), 5000):
        part = texts[k : k + 5000]
        want = [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
        for t, got, ids in zip(part, coder.encode([t.encode() for t in part]), want):
            assert np.frombuffer(got, "<u4").tolist() == ids, t
