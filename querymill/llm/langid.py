"""Language identification by segmentation-marginalised unigram models.

The pieces of a fixed public vocabulary have one probability per language. A word's likelihood is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of letters, in lower
case, each begun by the vocabulary's word mark). Piece probabilities come from expectation maximisation
(forward-backward) over labelled texts; the languages' posterior with equal priors gives the label and score.

The model is fitted on at most about TRAIN_ROWS_PER_LANG texts of each language, chosen by hash of the id. Every language is
learned, from letter runs of any length; one whose chosen texts hold no letter has nothing to learn from and is left out.
Probabilities are held sparsely, and training and scoring take LANGS_AT_ONCE languages in turn. The driver gets the
languages' names and the pieces that each one uses. Every text is scored whole.

Defined results: null text, or text without a letter, is `und` with score 0, as is all text where nothing could be
learned; repeated rows are scored each; rows with null ids are scored, and may be learned from.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.bpe import slices, tokenizer_path
from querymill.llm.common import HashTable, give_back, join_small, materialize

TRAIN_ROWS_PER_LANG = 4000
#: Languages whose probabilities are spread out at a time.
LANGS_AT_ONCE = 32
ROUNDS = 2
SMOOTH = 0.01
#: Probability of a letter that no piece covers, the same in every language.
UNKNOWN = 1e-7
#: Words up to this length are learned from and scored in batches; longer ones one by one, in logarithms.
BATCHED = 24
CACHE_WORDS = 100_000
MARK = "▁"
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Letter runs in lower case; empty where the text has no letter."""
    found = LETTERS.findall(text.lower())
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


@dataclass
class Vocabulary:
    """Pieces in the order of their rolling hashes, with a table from hash to place."""

    pieces: list[str]

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))
        hashes = np.array([_hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.pieces = [self.pieces[k] for k in order]
        self.hashes = hashes[order]
        self.place = {p: k for k, p in enumerate(self.pieces)}

    @functools.cached_property
    def table(self) -> HashTable:
        return HashTable(self.hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes, len(pieces) where there is none."""
        at = self.table.find(h).reshape(h.shape)
        return np.where(at < 0, len(self.hashes), at)


BASE = 0x9E3779B97F4A7C15


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * BASE + ord(c) + 1) & (2**64 - 1)
    return h


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
    kept = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
    pieces = {sp.id_to_piece(k) for k in kept}
    return Vocabulary(sorted(p for p in pieces if p == p.lower()))


def _grids(vocabulary: Vocabulary, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By word length: the places in `words`, and the piece at [start, length - 1] for each of them."""
    lengths = np.array([len(w) + 1 for w in words])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for k in range(0, len(at), 8192):
            part = at[k : k + 8192]
            codes = np.frombuffer("".join(MARK + words[j] for j in part.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n).astype(np.uint64) + np.uint64(1)
            deep = min(int(n), vocabulary.longest)
            grid = np.full((int(n), deep, len(part)), len(vocabulary.pieces), np.int32)
            h = codes.T.copy()
            for size in range(1, deep + 1):
                if size > 1:
                    h = h[:-1] * np.uint64(BASE) + codes.T[size - 1 :]
                grid[: n - size + 1, size - 1] = vocabulary.find(h)
            yield part, grid


def _forward(grid: np.ndarray, probs: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """alpha[end, word, lang]: the summed probability of the first `end` characters. probs has a last row of zeros."""
    n, deep, m = grid.shape
    alpha = np.zeros((n + 1, m, probs.shape[1]))
    alpha[0] = 1
    for end in range(1, n + 1):
        for size in range(1, min(deep, end) + 1):
            piece = grid[end - size, size - 1]
            p = probs[piece]
            if size == 1:
                p = np.where((piece == len(probs) - 1)[:, None], unknown, p)
            alpha[end] += alpha[end - size] * p
    return alpha


@dataclass
class Sparse:
    """Piece probabilities by language: the least of each, and the pieces that have more."""

    rows: int  # pieces, and a last row of zeros
    least: list[float]
    pieces: list[np.ndarray]
    values: list[np.ndarray]

    def add(self, probs: np.ndarray) -> None:
        """Further languages: piece by language, and a last row of zeros."""
        for column in probs[:-1].T:
            self.least.append(float(column.min()))
            self.pieces.append(np.flatnonzero(column > column.min()).astype(np.int32))
            self.values.append(column[self.pieces[-1]])

    def __getitem__(self, at: tuple[slice, slice]) -> np.ndarray:
        """[:, a:b] as an array."""
        langs = range(len(self.least))[at[1]]
        out = np.empty((self.rows, len(langs)))
        for k, lang in enumerate(langs):
            out[:, k] = self.least[lang]
            out[self.pieces[lang], k] = self.values[lang]
        out[-1] = 0
        return out


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray | Sparse  # piece by language, and a last row of zeros
    vocabulary: Vocabulary

    def __post_init__(self) -> None:
        self.spread: tuple[int, np.ndarray] | None = None

    def part(self, first: int) -> np.ndarray:
        """Probabilities of LANGS_AT_ONCE languages; those asked for last are kept."""
        if self.spread is None or self.spread[0] != first:
            self.spread = first, self.probs[:, first : first + LANGS_AT_ONCE]
        return self.spread[1]

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (any length) in each language."""
        return np.concatenate([np.zeros((len(words), 0)), *[self.scores_from(k, words) for k in range(0, len(self.langs), LANGS_AT_ONCE)]], axis=1)

    def scores_from(self, first: int, words: list[str]) -> np.ndarray:
        """The same in LANGS_AT_ONCE languages."""
        probs = self.part(first)
        out = np.zeros((len(words), probs.shape[1]))
        short = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) <= BATCHED)
        for part, grid in _grids(self.vocabulary, [words[k] for k in short.tolist()]):
            out[short[part]] = np.log(_forward(grid, probs, np.float64(UNKNOWN))[-1])
        for k, w in enumerate(words):
            if len(w) > BATCHED:
                out[k] = self._long(MARK + w, first)
        return out

    def _long(self, w: str, first: int = 0) -> np.ndarray:
        probs = self.part(first)
        logs, place, deep = np.full((len(w) + 1, probs.shape[1]), -np.inf), self.vocabulary.place, self.vocabulary.longest
        logs[0] = 0
        for end in range(1, len(w) + 1):
            terms = []
            for size in range(1, min(deep, end) + 1):
                piece = place.get(w[end - size : end])
                if piece is not None:
                    terms.append(logs[end - size] + np.log(probs[piece]))
                elif size == 1:
                    terms.append(logs[end - 1] + np.log(UNKNOWN))
            logs[end] = np.logaddexp.reduce(terms, axis=0)
        return logs[-1]


def _log_sum(terms: list[float]) -> float:
    most = max(terms)
    return most + math.log(sum(math.exp(t - most) for t in terms))


def _add_long_counts(counts: np.ndarray, vocabulary: Vocabulary, w: str, weight: float, logs: list[float]) -> None:
    """Add the expected uses of each piece in one word of any length, in logarithms."""
    place, n, unknown = vocabulary.place, len(w), math.log(UNKNOWN)
    into: list[list[tuple[int, int, float]]] = []  # by end: start, piece (-1: none covers the letter), logarithm
    before = [0.0]
    for end in range(1, n + 1):
        found = [(end - size, place[w[end - size : end]]) for size in range(1, min(vocabulary.longest, end) + 1) if w[end - size : end] in place]
        edges = [(start, piece, logs[piece]) for start, piece in found]
        if w[end - 1] not in place:
            edges.append((end - 1, -1, unknown))
        into.append(edges)
        before.append(_log_sum([before[start] + p for start, _, p in edges]))
    after: list[list[float]] = [[] for _ in range(n)] + [[0.0]]
    for end in range(n, 0, -1):
        rest = _log_sum(after[end])
        for start, piece, p in into[end - 1]:
            after[start].append(p + rest)
            if piece >= 0:
                counts[piece] += weight * math.exp(before[start] + p + rest - before[n])


def expected_counts(vocabulary: Vocabulary, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words of one language (probs: one column) by forward-backward."""
    counts = np.zeros(len(probs))
    short = np.array([k for k, w in enumerate(words) if len(w) <= BATCHED], np.int64)
    if len(short) < len(words):
        logs = np.log(probs[:-1, 0]).tolist()
        for w, weight in zip(words, weights.tolist()):
            if len(w) > BATCHED:
                _add_long_counts(counts, vocabulary, MARK + w, weight, logs)
    weights = weights[short]
    for part, grid in _grids(vocabulary, [words[k] for k in short.tolist()]):
        alpha = _forward(grid, probs, np.float64(UNKNOWN))[:, :, 0]
        n, deep, m = grid.shape
        beta = np.zeros((n + 1, m))
        beta[n] = 1
        for start in range(n - 1, -1, -1):
            for size in range(1, min(deep, n - start) + 1):
                piece = grid[start, size - 1]
                p = probs[piece, 0]
                if size == 1:
                    p = np.where(piece == len(probs) - 1, UNKNOWN, p)
                use = p * beta[start + size]
                beta[start] += use
                np.add.at(counts, piece, weights[part] * alpha[start] * use / alpha[n])
    counts[-1] = 0
    return counts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS_PER_LANG) -> DataFrame:
    """lang and text of about `rows` rows of each language (all, if fewer), by hash of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = materialize(known.groupBy("lang").agg((F.lit(float(rows)) / F.count(F.lit(1))).alias("share")))
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1_000_000)) / 1_000_000.0
    return join_small(known.select("doc_id", "lang", "text"), share, "lang").where(draw < F.col("share")).select("lang", "text")


def train(docs: DataFrame, vocabulary: Vocabulary | None = None, rows: int = TRAIN_ROWS_PER_LANG, rounds: int = ROUNDS) -> Model:
    """Fit to the lang and text of the given rows. Each round sums a number for each piece and LANGS_AT_ONCE languages on the driver."""
    vocabulary = vocabulary or load_vocabulary()
    n_pieces = len(vocabulary.pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    counted = training_sample(docs, rows).mapInArrow(count, "lang string, word string, n long")
    words = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    learned = Sparse(n_pieces + 1, [], [], [])
    for first in range(0, len(langs), LANGS_AT_ONCE):
        some = langs[first : first + LANGS_AT_ONCE]
        learned.add(fit(words.where(F.col("lang").isin(some)), some, vocabulary, rounds))
    return Model(langs, learned, vocabulary)


def fit(words: DataFrame, langs: list[str], vocabulary: Vocabulary, rounds: int) -> np.ndarray:
    """words: lang, word, n. Probabilities of the pieces (and a last row of zeros) in each of the languages."""
    spark, n_pieces = words.sparkSession, len(vocabulary.pieces)
    probs = np.full((n_pieces + 1, len(langs)), 1 / max(n_pieces, 1))
    probs[-1] = 0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, langs, probs))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, names, p = shared.value
            total = np.zeros((len(v.pieces) + 1, len(names)))
            for batch in batches:
                lang, word, n = (batch.column(k).to_pylist() for k in range(3))
                for k, name in enumerate(names):
                    own = [j for j, x in enumerate(lang) if x == name]
                    if own:
                        total[:, k] += expected_counts(v, [word[j] for j in own], np.array([n[j] for j in own], float), p[:, k : k + 1])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], names=["piece", "lang", "n"])

        # sums of doubles depend on their order: rounded, so that reruns agree
        sums = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum(F.col("n").cast("decimal(28,6)")).cast("double").alias("n"))
        counts = np.zeros_like(probs)
        for r in sums.toLocalIterator():
            counts[r["piece"], r["lang"]] = r["n"]
        shared.unpersist()
        probs = (counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * n_pieces)
        probs[-1] = 0
    return probs


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in `keep`, lang_pred and score (in place of columns so called) of every row with a `text` column."""
    keep = [k for k in dict.fromkeys(keep) if k not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place: dict[str, int] = {}
        table = np.zeros((0, 0))

        def score(texts: list[bytes]) -> Iterator[tuple[str, float]]:
            nonlocal place, table
            lists = [words_of(t.decode("utf-8", "replace")) for t in texts]
            totals = np.zeros((len(lists), len(m.langs)))
            for first in range(0, len(m.langs), LANGS_AT_ONCE):
                if len(m.langs) > LANGS_AT_ONCE:  # words are kept only where one part has all languages
                    place = {}
                new = list({w for ws in lists for w in ws}.difference(place))
                if len(place) + len(new) > CACHE_WORDS and place:
                    place = {}
                    new = list({w for ws in lists for w in ws})
                held = table[: len(place)] if place else np.zeros((0, len(m.langs[first : first + LANGS_AT_ONCE])))
                place.update(zip(new, range(len(place), len(place) + len(new))))
                table = np.concatenate([held, m.scores_from(first, new)]) if new else held
                for k, ws in enumerate(lists):
                    totals[k, first : first + LANGS_AT_ONCE] = table[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            for ws, total in zip(lists, totals):
                if not ws or not m.langs:
                    yield UNDETERMINED, 0.0
                    continue
                best = int(total.argmax())
                yield m.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())

        for batch in batches:
            for rows, part in slices(batch, "text"):
                found = list(score(part))
                columns = [rows.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*keep, "lang_pred", "score"])
        place, table = {}, np.zeros((0, 0))
        give_back()

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "lang_pred string", "score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def identify(docs: DataFrame, keep: list[str], rows: int = TRAIN_ROWS_PER_LANG) -> DataFrame:
    """Learn from the labelled rows that aren't held out, and label every row."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text"), rows=rows)
    return predict(docs, model, keep)
