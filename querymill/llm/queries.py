"""One query per operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm import ann, bpe, chat, host_rules, langid, mixing, resample, simhash, suffix_dedup, token_file
from querymill.llm.common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, source_size * 3 AS cap,
    (SELECT sum(source_size) FROM s) - coalesce(sum(source_size * 3) OVER o, 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share
  FROM w WINDOW o AS (ORDER BY source_size * 3 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * (remaining::DOUBLE / share) > cap AS capped FROM l),
f AS (SELECT (SELECT sum(source_size) FROM s) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS remaining, sum(weight) FILTER (WHERE NOT capped) AS share FROM c),
t AS (SELECT c.source, c.source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * f.remaining::DOUBLE / f.share::DOUBLE END AS target FROM c, f),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM r
"""


def op2_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")))).alias("x")
    ).select("conv_id", "x.turn", "x.role", F.lit(hard).alias("text"))
    formatted = chat.format_turns(chat.turns_of(table.unionByName(extra))).drop("turns")
    back = chat.parse_formatted(formatted)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + (length(text) - length(translate(text, '\<#', ''))) AS text_chars,
    length(role) + (length(role) - length(translate(role, '\<#:', ''))) AS role_chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(4 + role_chars + 2 + text_chars + 8)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), F.col("source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM
  (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS u(i))),
p AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM g, unnest([0, 1, 2]) AS v(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, (count(*) - count(DISTINCT x))::BIGINT AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
r AS (SELECT *, n_words < 50 AS f1, n_repeat_words * 100 > n_words * 50 AS f2, n_symbols * 10 > word_chars AS f3 FROM m),
h AS (SELECT source, count(*) AS n, sum(f1::INT) AS s1, sum(f2::INT) AS s2, sum(f3::INT) AS s3 FROM r GROUP BY source),
u AS (SELECT source, n, s1 AS s, 1 AS k FROM h UNION ALL SELECT source, n, s2, 2 FROM h UNION ALL SELECT source, n, s3, 3 FROM h),
a AS (SELECT k, sum(s) / sum(n) AS mean, greatest(sum(n * (s / n) * (s / n)) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)), 1e-6) AS spread FROM u GROUP BY k),
b AS (SELECT k, mean, least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) AS strength FROM a),
v AS (SELECT source, bool_and((s + mean * strength) / (n + strength) <= 0.5) AS host_ok FROM u JOIN b USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND host_ok AS kept
FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source
"""


def op3_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    found = resample.resample(docs, labels, good, good & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    return found.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    found = suffix_dedup.deduplicate(docs, columns=["doc_id", "n_bytes"])
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_file.write_token_files(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_file.read_token_files(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return langid.identify(docs, ["doc_id"]).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_format_chat": op2_format_chat,
    "op3_importance_resample": op3_importance_resample,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash_components": op5_simhash_components,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_token_files": op8_token_files,
    "op9_host_rules": op9_host_rules,
    "op10_language_id": op10_language_id,
    "pipeline": pipeline,
}
SQL = {"op1_mix_sources": OP1_SQL, "op2_format_chat": OP2_SQL, "op9_host_rules": OP9_SQL}
