"""BPE encoding and decoding with a given tokenizer file, by tree concatenation.

A text over PIECE_BYTES is cut at code points, the pieces are encoded in parallel, and neighbours are joined pair by
pair up a tree. At each join a window around it is encoded anew and grows until it has one token in common with
the left side's ids and one with the right side's; what lies between those tokens comes from the window. Adjacent
tokens are valid or not by themselves, so the joined ids are those of the whole text.

Shorter texts, and pieces, are encoded word by word through a bounded cache of words (the tokenizer never joins
text across ASCII white space).

Defined results: null is the empty text, with no ids; repeated rows are encoded each; other columns stay, but for
`ids` and `decoded`, which are replaced, and `_row` and `_piece`, which go.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.common import HashTable, give_back

PIECE_BYTES = 1 << 15
WINDOW = 64
#: Words kept by each of the two generations of a worker's cache, and the longest kept.
CACHE_WORDS, CACHED_BYTES = 300_000, 40
#: Marks that a word may end in; after a letter they are tokens of their own.
MARKS = b'.,!?;:)'
#: Lower-case letters that are single code points in every normal form the tokenizer uses.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u012f\u0131-\u0148\u014a-\u017e]+")
#: Kinds of bytes, and the longest word that is merged with others.
SPACE, LETTER, MARK, OTHER = range(4)
LATIN_BYTES = 24
NO_RANK = np.int32(2**31 - 1)
#: Text that is split into words at a time.
CHUNK_BYTES = 2 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=1)
def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: lower case and kind. By two bytes (the first as high part): the lower case of Latin letters, 0 for others."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    kind = np.full(256, OTHER, np.uint8)
    kind[97:123] = kind[65:91] = LETTER
    kind[list(MARKS)] = MARK
    kind[list(b" \t\n\v\f\r")] = SPACE
    pairs = np.zeros(1 << 16, np.uint16)
    for c in map(chr, range(0x80, 0x800)):
        low = c.lower()
        if LATIN.fullmatch(low) and len(raw := low.encode()) == 2 and unicodedata.normalize("NFC", c) == c:
            pairs[int.from_bytes(c.encode(), "big")] = int.from_bytes(raw, "big")
    return lower, kind, pairs


def classified(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text with ASCII and Latin capitals in lower case (of no other length), and the kind of each byte."""
    raw = np.frombuffer(text, np.uint8)
    lower, kinds, pairs = byte_tables()
    body, kind = lower[raw], kinds[raw]
    lead = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5))
    low = pairs[raw[lead].astype(np.int64) << 8 | raw[lead + 1]]
    lead, low = lead[low > 0], low[low > 0]
    body[lead], body[lead + 1] = low >> 8, low & 255
    kind[lead] = kind[lead + 1] = LETTER
    return body, kind


def _counts(mask: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """How many places of each span are marked."""
    upto = np.cumsum(mask, dtype=np.int32)
    upto = np.concatenate([np.zeros(1, np.int32), upto])
    return (upto[stop] - upto[start]).astype(np.int64)


def distinct_words(body: np.ndarray, start: np.ndarray, size: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words among spans of up to `longest` bytes (a multiple of eight, none of them zero).

    Gives their bytes, one after the other, their sizes, and each span's place in them.
    """
    if not len(start):
        return np.zeros(0, np.uint8), *(np.zeros(0, np.int64),) * 2
    mask = np.where(np.arange(longest)[None] < np.arange(longest + 1)[:, None], 255, 0).astype(np.uint8).view("<u8")
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([body, np.zeros(longest, np.uint8)]), longest)[start].view("<u8") & mask[size]
    h = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        h = (h ^ column) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    order = np.argsort(h)
    new = np.ones(len(order), bool)
    near = rows[order]
    new[1:] = h[order[1:]] != h[order[:-1]]
    differ = (near[1:] != near[:-1]).any(axis=1)
    if (differ & ~new[1:]).any():  # two words with one hash
        order = np.lexsort(rows.T)
        near = rows[order]
        differ = (near[1:] != near[:-1]).any(axis=1)
    new[1:] = differ
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    raw, size = near[new].view(np.uint8).reshape(-1, longest), size[order[new]]
    return raw[np.arange(longest)[None] < size[:, None]], size, place


class WordCoder:
    """Encodes texts (UTF-8) to ids (little-endian unsigned 32-bit) and back, as the tokenizer would."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tokens = np.array([self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))], dtype=object)
        self.ends = np.array([t.endswith("</w>") for t in self.tokens])
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self._merge_table()

    def raw(self, texts: list[bytes]) -> list[bytes]:
        found = self.tok.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _merge_table(self) -> None:
        """Ids of the byte symbols (within and at the end of a word), and the pairs that merge, by their ids."""
        import json

        names = {**{b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}}
        names |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in names)}
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.inside = np.array([vocab[names[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[names[b] + "</w>"] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.loads(self.tok.to_str())["model"]["merges"]]
        self.pairs = HashTable(np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64))  # places are ranks
        self.pair_id = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # ranks of two byte symbols, by the first one's byte and the second one's, which are 256 more where they end a word
        self.byte_rank = self._rank(np.repeat(self.inside, 512), np.tile(np.concatenate([self.inside, self.final]), 256))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.pairs.find(left.astype(np.int64) << 20 | right)
        return np.where(rank < 0, NO_RANK, rank)

    def latin(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words of Latin letters, one after the other, and how many each has.

        All words merge together, each its first best pair in a round.
        """
        last = np.zeros(len(codes), bool)
        last[np.cumsum(sizes) - 1] = True
        ids, word = np.where(last, self.final[codes], self.inside[codes]), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(codes), NO_RANK, np.int32)
        rank[:-1] = self.byte_rank[(codes[:-1].astype(np.int32) << 9) + codes[1:] + (last[1:].astype(np.int32) << 8)]
        rank[last] = NO_RANK
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            counts = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            going = best < NO_RANK
            if not going.all():
                stay = np.repeat(going, counts)
                done.append((ids[~stay], word[~stay]))
                ids, word, rank, last = ids[stay], word[stay], rank[stay], last[stay]
                best, counts = best[going], counts[going]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            at = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]
            ids[at] = self.pair_id[best]
            last[at] |= last[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one symbol went in each word before
            ids, word, rank, last = ids[keep], word[keep], rank[keep], last[keep]
            rank[at] = NO_RANK
            inner = at[~last[at]]
            before = at[at > 0] - 1
            before = before[~last[before]]
            changed = np.concatenate([inner, before])
            rank[changed] = self._rank(ids[changed], ids[changed + 1])
        flat, word = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        return flat[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(sizes))

    def joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters of any script, encoded as one text: each ends in the one token that ends a word."""
        if not words:
            return []
        ids = np.array(self.tok.encode(b" ".join(words).decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):  # case folding left a mark that is no letter
            return self.raw(words)
        raw, at = ids.tobytes(), [0, *(4 * stop).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def learn(self, ask: set[bytes]) -> None:
        """Add words to the cache. A word of letters and trailing marks is made of both parts' ids.

        Whether it is one is asked of the normal form: a letter whose lower case ends in a combining mark would take the
        trailing marks into its own token.
        """
        new, old = self.new, self.old
        letters, other, made = set(), set(), []
        for w in ask:
            stem = w.rstrip(MARKS)
            if stem and not stem.isascii() and unicodedata.normalize("NFC", stem.decode("utf-8", "replace")).lower().isalpha():
                letters.add(stem)
                if len(stem) < len(w):
                    made.append((w, stem, w[len(stem) :]))
            else:
                other.add(w)
        other.update(m for _, _, m in made)
        for group, encode in ((letters, self.joined), (other, self.raw)):
            group.difference_update(new)
            new.update((w, old[w]) for w in group if w in old)
            todo = [w for w in group if w not in old]
            for k in range(0, len(todo), 65_536):
                new.update(zip(part := todo[k : k + 65_536], encode(part)))
        for w, stem, marks in made:
            new[w] = new[stem] + new[marks]

    def cached(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of any kind, through the cache."""
        new, old = self.new, self.old
        ask = set(words).difference(new)
        known = [w for w in ask if w in old]
        new.update((w, old[w]) for w in known)
        self.learn(ask.difference(known))
        out = list(map(new.__getitem__, words))
        for w in ask:
            if len(w) > CACHED_BYTES:
                del new[w]
        if len(new) > CACHE_WORDS:
            self.old, self.new = new if len(new) < 3 * CACHE_WORDS else {}, {}
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Words of Latin letters with trailing marks are found, told apart and merged in arrays; others go through the cache."""
        whole = b"\n".join(texts)
        body, kind = classified(whole)
        space = kind == SPACE
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = np.concatenate([[0] if len(space) and not space[0] else [], edge, [len(space)] if len(space) and not space[-1] else []]).astype(np.int64)
        start, stop = edge[::2], edge[1::2]
        # marks that end a word; what is no Latin word, or has marks elsewhere, is hard
        is_mark = kind == MARK
        odd = kind == OTHER
        odd[:-1] |= is_mark[:-1] & (kind[1:] == LETTER)
        marks, odds = _counts(is_mark, start, stop), _counts(odd, start, stop)
        size = stop - start - marks
        hard = (odds > 0) | (size == 0) | (size > LATIN_BYTES) | (marks > 8)
        easy = ~hard
        tailed = np.flatnonzero(easy & (marks > 0))
        stems, stem_sizes, stem_of = distinct_words(body, start[easy], size[easy], LATIN_BYTES)
        tails, tail_sizes, tail_of = distinct_words(body, stop[tailed] - marks[tailed], marks[tailed], 8)
        cuts = np.cumsum(tail_sizes).tolist()
        coded_tails = self.cached([tails[a:b].tobytes() for a, b in zip([0, *cuts], cuts)])
        # ASCII capitals are folded first, which the tokenizer does too; not where a special token may be spelt
        raw_hard = [w if b"<|" in w else w.lower() for w in (whole[a:b] for a, b in zip(start[hard].tolist(), stop[hard].tolist()))]
        coded_hard = self.cached(raw_hard)
        ids, n = self.latin(stems, stem_sizes)
        # a word is two units of the dictionary: stem and marks, or itself and nothing
        lengths = np.concatenate([n, np.fromiter(map(len, coded_tails), np.int64, len(coded_tails)) // 4, np.fromiter(map(len, coded_hard), np.int64, len(coded_hard)) // 4, [0]])
        flat = np.concatenate([ids, np.frombuffer(b"".join(coded_tails) + b"".join(coded_hard), "<u4")])
        unit = np.full((len(start), 2), len(lengths) - 1, np.int64)
        unit[easy, 0], unit[tailed, 1] = stem_of, tail_of + len(n)
        unit[hard, 0] = np.arange(len(coded_hard)) + len(n) + len(coded_tails)
        first, count = (np.cumsum(lengths) - lengths)[unit].reshape(-1), lengths[unit].reshape(-1)
        before = np.concatenate([[0], np.cumsum(count)])
        out = flat[np.repeat(first - before[:-1], count) + np.arange(before[-1])].tobytes()
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        at = (4 * before[2 * np.searchsorted(start, np.concatenate([[0], ends]))]).tolist()
        return [out[a:b] for a, b in zip(at, at[1:])]

    def forget(self) -> None:
        """Empty the word cache."""
        self.new, self.old = {}, {}

    def decode(self, ids: bytes) -> str:
        return " ".join(self.tokens[np.frombuffer(ids, "<u4")].tolist())


@functools.lru_cache(maxsize=4)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def chunks(column: pa.Array) -> Iterator[list[bytes]]:
    """Texts as bytes, null as empty, some megabytes at a time."""
    part, size = [], 0
    for x in column.cast(pa.binary()):
        part.append(x.as_py() or b"")
        size += len(part[-1])
        if size > CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch some megabytes of text at a time, with the texts."""
    at = 0
    for part in chunks(batch.column(column)):
        yield batch.slice(at, len(part)), part
        at += len(part)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def cut_points(text: bytes, size: int) -> list[int]:
    """0, then about every `size` bytes the start of a code point, then the length."""
    at = [0]
    while len(text) - at[-1] > size:
        p = at[-1] + size
        while p > at[-1] + 1 and text[p] & 0xC0 == 0x80:
            p -= 1
        at.append(p)
    return [*at, len(text)]


def _tail(text: bytes, n: int) -> bytes:
    p = max(0, len(text) - n)
    while p > 0 and text[p] & 0xC0 == 0x80:
        p -= 1
    return text[p:]


def _head(text: bytes, n: int) -> bytes:
    p = min(len(text), n)
    while p < len(text) and text[p] & 0xC0 == 0x80:
        p += 1
    return text[:p]


def _spans(tok, text: str) -> tuple[list[int], list[tuple[int, int, int] | None]]:
    """Ids and (start, end, id) of each token; None where a token shares its characters with another (parts of one)."""
    e = tok.encode(text, add_special_tokens=False)
    offsets, seen = e.offsets, {}
    for o in offsets:
        seen[o] = seen.get(o, 0) + 1
    return e.ids, [(a, b, i) if seen[(a, b)] == 1 and b > a else None for (a, b), i in zip(offsets, e.ids)]


def join_pair(tok, a: tuple[bytes, np.ndarray], b: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """Text and ids of a followed by b."""
    (ta, ia), (tb, ib), size = a, b, WINDOW
    while True:
        left, right = _tail(ta, size), _head(tb, size)
        window = (left + right).decode("utf-8", "replace")
        if len(left) == len(ta) and len(right) == len(tb):
            return ta + tb, np.array(tok.encode(window, add_special_tokens=False).ids, dtype="<u4")
        ls, rs = left.decode("utf-8", "replace"), right.decode("utf-8", "replace")
        wi, ws = _spans(tok, window)
        at = {s: k for k, s in enumerate(ws) if s}
        li, lsp = _spans(tok, ls)
        ri, rsp = _spans(tok, rs)
        whole_left, whole_right, shift = len(left) == len(ta), len(right) == len(tb), len(ls)
        keep_a = from_w = keep_b = to_w = None
        for k, s in enumerate(lsp):
            if s and (s[0] > 0 or whole_left) and s in at and len(ia) >= len(li) - k and (ia[len(ia) - (len(li) - k) :] == li[k:]).all():
                keep_a, from_w = len(ia) - (len(li) - k), at[s]
                break
        if whole_left and keep_a is None:
            keep_a, from_w = 0, 0  # the window starts where the text does
        for k in range(len(rsp) - 1, -1, -1):
            s = rsp[k]
            if s and (s[1] < len(rs) or whole_right) and (key := (s[0] + shift, s[1] + shift, s[2])) in at and len(ib) > k and (ib[: k + 1] == ri[: k + 1]).all():
                keep_b, to_w = k + 1, at[key] + 1
                break
        if whole_right and keep_b is None:
            keep_b, to_w = len(ib), len(wi)
        if keep_a is not None and keep_b is not None and from_w <= to_w:
            return ta + tb, np.concatenate([ia[:keep_a], np.array(wi[from_w:to_w], dtype="<u4"), ib[keep_b:]])
        size *= 2


def join_tree(tok, parts: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
    while len(parts) > 1:
        parts = [join_pair(tok, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0][1]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", piece_bytes: int = PIECE_BYTES, decoded: bool = False) -> DataFrame:
    """Adds `ids` (binary, little-endian unsigned 32-bit) to every row; if asked for, also `decoded`, what decode gives for them."""
    path = path or tokenizer_path()
    docs = docs.drop("ids", "decoded", "_row", "_piece")
    fields = docs.schema.fields
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields)}, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for rows, part in slices(batch, text):
                yield _with(rows, "ids", pa.array(c.encode(part), pa.binary()))
        c.forget()
        give_back()

    def run_both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(batches):
            yield _with(rows, "decoded", pa.array([coder(path).decode(x.as_py()) for x in rows.column("ids")], pa.string()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k, x in enumerate(batch.column(text).cast(pa.binary())):
                body, one = x.as_py(), batch.slice(k, 1)
                at = cut_points(body, piece_bytes)
                for n, (p, q) in enumerate(zip(at, at[1:])):
                    rest = list(one.columns)
                    rest[one.schema.names.index(text)] = pa.array([body[p:q].decode("utf-8", "replace")])
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([row], pa.int64()), pa.array([n], pa.int32())], names=[*one.schema.names, "_row", "_piece"])
                row += 1

    def join(_, group):
        group = group.sort_values("_piece")
        parts = [(t.encode(), np.frombuffer(i, "<u4")) for t, i in zip(group[text], group["ids"])]
        out = group.iloc[:1].copy()
        out["ids"] = [join_tree(coder(path).tok, parts).astype("<u4").tobytes()]
        out[text] = ["".join(group[text])]
        out["decoded"] = [coder(path).decode(out["ids"].iloc[0])] if decoded else ""
        return out[[f.name for f in fields] + ["ids"] + ["decoded"] * decoded]

    size = F.coalesce(F.octet_length(text), F.lit(0))
    wanted = schema + ", decoded string" * decoded
    short = docs.where(size <= piece_bytes).mapInArrow(run_both if decoded else run, wanted)
    pieces = docs.where(size > piece_bytes).mapInArrow(cut, schema.removesuffix(", ids binary") + ", _row long, _piece int")
    coded = pieces.repartition("_row", "_piece").mapInArrow(run, schema.removesuffix(", ids binary") + ", _row long, _piece int, ids binary")
    return short.unionByName(coded.groupBy("_row").applyInPandas(join, wanted))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds `decoded`, the text of `ids` with special tokens, to every row; null ids give an empty text."""
    path = path or tokenizer_path()
    df = df.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                yield _with(rows, "decoded", pa.array([c.decode(x.as_py() or b"") for x in rows.column(ids)], pa.string()))

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, decoded string")
