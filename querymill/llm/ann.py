"""Nearest neighbours by inner product over low-dimensional 2-stable projections.

Vectors get one more component that gives all of them the largest norm, which turns the largest inner product into
the smallest Euclidean distance; PLANES random normal projections then give each a short image. If two vectors lie
d apart, the squared distance of their images over d * d is chi-square distributed with PLANES degrees of freedom.

A kd-tree over the images of a bounded sample cuts the space into cells, every vector goes to its cell, and cells over
CELL_ROWS (equal vectors cannot be cut apart) are salted into blocks. Each query first searches a block of its own cell,
which bounds the distance d of its k-th neighbour, and then all blocks whose boxes meet the stopping radius. Inside a
block a kd-tree gives its leaves by distance from the query's image, and of each leaf the vectors whose images lie within
d * sqrt(chi-square quantile) are verified in full, until the next leaf is farther than that: by then a nearer vector would
have shown up with probability CONFIDENCE.

A block is sent once for each QUERY_ROWS queries that visit it, and a query to the blocks it visits, so the shuffle grows
with the visits alone. How many those are depends on the data: where most vectors lie nearly as far as the k-th
neighbour, no index avoids them.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; equal scores go by smaller id; repeated ids are separate candidates except for the query's own id; fewer
candidates than k give all of them; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.common import materialize

PLANES = 32
CONFIDENCE = 0.88
CELL_ROWS = 4096
LEAF_ROWS = 128
SAMPLE_ROWS = 40_000
#: Queries that one task holds beside a block.
QUERY_ROWS = 8192
#: Share of a leaf above which whole products are cheaper than those of the pairs asked for.
DENSE = 0.2
SEED = 7


def chi_square_quantile(p: float, degrees: int) -> float:
    """For an even number of degrees of freedom, by bisection."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(degrees // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def split_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and threshold of each inner node of a full binary tree, cut at medians of the widest axis."""
    axes, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)

    def cut(node: int, rows: np.ndarray) -> None:
        if node >= len(axes):
            return
        if len(rows):
            axes[node] = int(np.argmax(np.ptp(points[rows], axis=0)))
            cuts[node] = float(np.median(points[rows, axes[node]]))
        side = points[rows, axes[node]] > cuts[node]
        cut(2 * node + 1, rows[~side])
        cut(2 * node + 2, rows[side])

    cut(0, np.arange(len(points)))
    return axes, cuts


def leaf_of(points: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range(int(math.log2(len(axes) + 1))):
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - len(axes)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    gap = np.maximum(low[None] - points[:, None], points[:, None] - high[None])
    return (np.maximum(gap, 0) ** 2).sum(axis=2)


def search_block(ids: np.ndarray, vectors: np.ndarray, images: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, q_images: np.ndarray, bound: np.ndarray, radius2: float, k: int, far2: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Best k places in the block for each query (-1: none), their scores, best first, and how many pairs were verified.

    bound: squared distance within which each query has k neighbours already; far2: the squared norm of all vectors.
    """
    depth = max(0, math.ceil(math.log2(max(1, len(ids)) / LEAF_ROWS)))
    leaf = leaf_of(images, *split_tree(images, depth)) if depth else np.zeros(len(ids), np.int64)
    order = np.lexsort((ids, leaf))
    starts = np.searchsorted(leaf[order], np.arange(2**depth + 1))
    filled = np.flatnonzero(np.diff(starts))
    low = np.stack([images[order[starts[n] : starts[n + 1]]].min(axis=0) for n in filled])
    high = np.stack([images[order[starts[n] : starts[n + 1]]].max(axis=0) for n in filled])
    gaps = box_distance(q_images, low, high)
    path = np.argsort(gaps, axis=1, kind="stable")
    norm2 = (queries**2).sum(axis=1)
    image2, q_image2, verified = (images**2).sum(axis=1), (q_images**2).sum(axis=1), 0
    best, score = np.full((len(q_ids), k), -1), np.full((len(q_ids), k), -np.inf)
    live = np.arange(len(q_ids))
    for step in range(len(filled)):
        nearest = np.minimum(bound[live], norm2[live] + far2 - 2 * score[live, -1])
        at = path[live, step]
        go = gaps[live, at] <= radius2 * np.maximum(nearest, 0)
        live, at, reach = live[go], at[go], radius2 * np.maximum(nearest[go], 0)
        if not len(live):
            break
        for n in np.unique(at):
            rows, who = order[starts[filled[n]] : starts[filled[n] + 1]], live[at == n]
            near = q_image2[who][:, None] + image2[rows][None] - 2 * (q_images[who] @ images[rows].T) <= reach[at == n][:, None]
            verified += int(near.sum())
            if near.mean() > DENSE:
                found = np.where(near, np.round(queries[who] @ vectors[rows].T, 12), -np.inf)
            else:
                found = np.full(near.shape, -np.inf)
                a, b = np.nonzero(near)
                found[a, b] = np.round(np.einsum("ij,ij->i", queries[who[a]], vectors[rows[b]]), 12)
            found[q_ids[who][:, None] == ids[rows][None]] = -np.inf
            every = np.concatenate([score[who], found], axis=1)
            place = np.concatenate([best[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
            names = np.where(place < 0, np.iinfo(np.int64).max, ids[place])
            top = np.lexsort((names, -every), axis=1)[:, :k]
            score[who], best[who] = np.take_along_axis(every, top, 1), np.take_along_axis(place, top, 1)
    best[np.isneginf(score)] = -1
    return best, score, verified


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows that take part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    df = df.where(F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False)))
    most = df.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return df.where(F.size(vector) == (most["n"] if most else 0))


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product with each query row."""
    spark = df.sparkSession
    rows = usable(df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null"), "v")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, far2, size, n_queries = rows.agg(F.count(F.lit(1)), F.max(norm2), F.max(F.size("v")), F.count_if("asks")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n_queries:
        return spark.createDataFrame([], schema)
    planes = np.random.default_rng(SEED).standard_normal((size + 1, PLANES))
    radius2 = chi_square_quantile(CONFIDENCE, PLANES)

    def image(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy().reshape(-1, size)
            more = np.sqrt(np.maximum(far2 - (v**2).sum(axis=1), 0))
            own, asked = v @ planes[:-1] + more[:, None] * planes[-1], v @ planes[:-1]
            lists = [pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * PLANES, PLANES, dtype=np.int32), pa.array(x.reshape(-1))) for x in (own, asked)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "y", "q"])

    imaged = materialize(rows.mapInArrow(image, "id long, v array<double>, asks boolean, y array<double>, q array<double>"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < min(1.0, SAMPLE_ROWS / n) * 1_000_000
    sample = np.array([r[0] for r in imaged.where(draw).select("y").collect()]).reshape(-1, PLANES)
    depth = max(0, math.ceil(math.log2(min(n / CELL_ROWS, max(1, len(sample) / 16)))))
    tree = split_tree(sample, depth)
    place = F.pandas_udf(lambda y: pd.Series(leaf_of(np.stack(y), *tree)), "long") if depth else lambda y: F.lit(0).cast("long")
    celled = materialize(imaged.withColumn("cell", place(F.col("y"))))

    bounds = [f(F.get("y", F.lit(j))) for j in range(PLANES) for f in (F.min, F.max)]
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)), *bounds).collect()  # at most 2 ** depth rows
    boxes = np.array([list(r[2:]) for r in cells]).reshape(-1, PLANES, 2)
    low, high, names = boxes[:, :, 0], boxes[:, :, 1], np.array([r["cell"] for r in cells])
    salts = np.array([-(-r[1] // CELL_ROWS) for r in cells])
    # one row for each cell, of which there are at most 2 ** depth, fewer than SAMPLE_ROWS
    n_salts = spark.createDataFrame([(int(c), int(n)) for c, n in zip(names, salts)], "cell long, salts int")
    blocks = celled.join(F.broadcast(n_salts), "cell").select("cell", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), "id", "v", "y")
    asks = celled.where("asks").select("id", "v", "q")

    def visits(first: bool):
        """(block, query) for the one block that is searched first, or for all within the stopping radius."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = b.column("q").flatten().to_numpy().reshape(-1, PLANES)
                gaps = box_distance(q, low, high)
                if first:
                    who, at = np.arange(len(q)), gaps.argmin(axis=1)
                    salt = np.zeros(len(q), np.int64)
                else:
                    who, at = np.nonzero(gaps <= radius2 * np.maximum(b.column("bound").to_numpy(), 0)[:, None])
                    times = salts[at]
                    salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    who, at = np.repeat(who, times), np.repeat(at, times)
                part = b.take(pa.array(who))
                bound = part.column("bound") if not first else pa.array(np.full(len(who), np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(salt.astype(np.int32)), part.column("id"), part.column("v"), part.column("q"), bound], names=["cell", "salt", "id", "v", "q", "bound"])

        return run

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, vectors = block["id"].to_numpy(), np.stack(block["v"])
        q_ids, asked = queries["id"].to_numpy(), np.stack(queries["v"])
        best, _, _ = search_block(ids, vectors, np.stack(block["y"]), q_ids, asked, np.stack(queries["q"]), queries["bound"].to_numpy(), radius2, k, far2)
        who, rank = np.nonzero(best >= 0)
        at = best[who, rank]
        return pd.DataFrame({"query_id": q_ids[who], "vec_id": ids[at], "score": (vectors[at] * asked[who]).sum(axis=1)})

    def searched(visited: DataFrame) -> DataFrame:
        """Every block goes to as many tasks as the queries that visit it fill; the queries are dealt over them."""
        visited = materialize(visited)
        parts = materialize(visited.groupBy("cell", "salt").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("parts")))
        on = ["cell", "salt"]
        dealt = visited.join(parts, on).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), "parts").cast("int"))
        held = blocks.join(parts, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        on.append("part")
        return held.drop("parts").groupBy(*on).cogroup(dealt.drop("parts").groupBy(*on)).applyInPandas(search, "query_id long, vec_id long, score double")

    visit = "cell long, salt int, id long, v array<double>, q array<double>, bound double"
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = searched(asks.mapInArrow(visits(True), visit)).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k)
    kth = kth.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("found"))
    bounded = asks.join(kth, asks["id"] == kth["query_id"], "left").withColumn(
        "bound", F.when(F.col("found") >= k, norm2 + F.lit(far2) - 2 * F.col("s")).otherwise(F.lit(float("inf"))).cast("double")
    )
    found = searched(bounded.select("id", "v", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound")).mapInArrow(visits(False), visit))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
