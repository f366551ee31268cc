"""Host-level quality rules, with DataFrame functions alone.

Rule failures of the documents are summed by host, each host's failure rate of each rule is shrunk towards a beta
prior fitted to all hosts by moments, and a host whose shrunk rate exceeds the limit for some rule is refused;
that verdict is joined back to the host's documents.

Defined results: null text has no words and fails the length rule; a null host is a host of its own; repeated rows
count each; an empty table gives an empty result. Three-word windows are compared by their 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.common import WORD, join_small, let, materialize

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: A host is refused where the shrunk share of its documents that fail a rule is above this.
MAX_RATE = 0.5


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more. Sorts the windows' hashes: n log n in the words."""

    def of(w: Column) -> Column:
        n = F.size(w)
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j)["h"] == x["h"])
            hit = F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
            starts = F.sort_array(F.transform(hit, lambda x: x["i"]))
            # consecutive windows overlap: each adds the words up to the next window's start, three at most
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

        return F.when(n < 4, F.lit(0)).otherwise(let(windows, twice))

    return let(words, of)


def text_features(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host and the measures of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return docs.select(
        F.col("doc_id"),
        host.alias("host"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
    )


#: Rules by name; each is true for a document that fails it.
RULES = {
    "short": lambda: F.col("n_words") < MIN_WORDS,
    "repetitive": lambda: F.col("n_repeat_words") * 100 > F.col("n_words") * 50,
    "symbols": lambda: F.col("n_symbols") * 10 > F.col("word_chars"),
}


def host_verdicts(features: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """host, n_docs, a shrunk rate for each rule, and host_ok. One row of moments reaches the driver."""
    counts = materialize(features.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(rule()).alias(f"f_{k}") for k, rule in RULES.items()]))
    rate = {k: F.col(f"f_{k}") / F.col("n_docs") for k in RULES}
    moments = counts.agg(F.sum("n_docs").alias("n"), *[x for k in RULES for x in (F.sum(f"f_{k}").alias(f"s_{k}"), F.sum(F.col("n_docs") * rate[k] * rate[k]).alias(f"q_{k}"))]).first()
    out, ok = counts, F.lit(True)
    for k in RULES:
        mean = (moments[f"s_{k}"] or 0) / moments["n"] if moments["n"] else 0.0
        spread = max((moments[f"q_{k}"] or 0) / moments["n"] - mean * mean, 1e-6) if moments["n"] else 1e-6
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)  # alpha + beta
        out = out.withColumn(f"rate_{k}", (F.col(f"f_{k}") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))
        ok = ok & (F.col(f"rate_{k}") <= max_rate)
    return out.select("host", "n_docs", *[f"rate_{k}" for k in RULES], ok.alias("host_ok"))


def judge(docs: DataFrame, host: Column, max_rate: float = MAX_RATE) -> DataFrame:
    """The measures of each document, base_failed (length or repetition) and kept (also refused with its host)."""
    features = materialize(text_features(docs, host))  # ids and counts only; the texts are read once
    judged = join_small(features, host_verdicts(features, max_rate).select("host", "host_ok"), "host")
    failed = RULES["short"]() | RULES["repetitive"]()
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
