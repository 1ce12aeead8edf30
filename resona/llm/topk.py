"""Exact top-k inner products over a pivot-distance index.

Components become floor(scale * x). One more coordinate, sqrt(M^2 - |x|^2) with M the
largest norm, turns the largest inner product into the smallest distance, so the
triangle inequality can bound it.

The index keys every vector by its nearest pivot and its distance from it, in
``ANNULI`` sorted rings per pivot; a ring of more than ``block`` vectors is several
blocks. The pivots are a bounded sample (``pivots`` vectors); all vectors are indexed.

A query first searches the ring it falls into itself, which gives it k scores to
beat. Then its annuli expand: a ring [low, high] of pivot p lies at least
max(low - d, d - high, 0) from a query at distance d from p, so its best possible
score is known. Each round searches a query's next ``FIRST`` most promising rings (four times as
many in every further round) among those that can still reach its k-th score, which the
round then raises; the search stops when no query has such a ring left. The summary of all rings has at most
``pivots * ANNULI`` rows and is the only thing sent to every task.

A round moves the blocks of the rings that queries ask for and no others. A block is
repeated only where more than ``query_block`` queries ask for it, once for each so many.

Scores are integers, so results are exact; equal scores go to the smaller vec_id.
Defined results: vectors that are null, empty, or hold null or non-finite
components, and rows with a null vec_id, take no part; vectors of different lengths never meet; a query whose length has fewer
than k others gets them all; repeated rows are candidates each, except those with the
query's own vec_id; rows that repeat a query's vec_id are one query, with the first of their vectors in
array order; an empty table gives no rows. Columns besides vec_id and
embedding are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resona.llm.tables import cut
from resona.llm.vectors import finite, matrix

ANNULI = 32
FIRST = 4
SLACK = 1e-6


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _search(vectors: pd.DataFrame, asked: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    """The k best of the block for each query, none below the score it has to beat."""
    vectors = vectors.sort_values("vec_id", kind="stable")
    v, q = matrix(vectors["ints"], dim), matrix(asked["q_ints"], dim)
    ids, own = vectors["vec_id"].to_numpy(), asked["query_id"].to_numpy()
    beat = asked["beat"].to_numpy()
    out = []
    for at in range(0, len(q), 256):
        scores = q[at : at + 256] @ v.T if len(v) else np.zeros((len(q[at : at + 256]), 0))
        scores[ids[None, :] == own[at : at + 256, None]] = -np.inf
        scores[scores < beat[at : at + 256, None]] = -np.inf
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(scores, best, 1)
        row, column = np.nonzero(found > -np.inf)
        out.append(pd.DataFrame({"query_id": own[at + row], "vec_id": ids[best[row, column]], "score": found[row, column].astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, pivots: int = 24, block: int = 1024, query_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest integer inner products.

    ``is_query`` is a boolean column over vec_id. Vectors whose squared length in integers
    reaches 2**53 raise an error.
    """
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    valid = cut(
        vectors.where(finite() & F.col("vec_id").isNotNull()).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), ints.alias("ints"), F.coalesce(is_query, F.lit(False)).alias("is_query")
        )
    )
    queries = cut(valid.where("is_query").groupBy("vec_id").agg(F.min("ints").alias("ints")).withColumn("dim", F.size("ints")))
    shapes = valid.groupBy("dim").agg(F.max(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x * x)).alias("most")).join(queries.select("dim").distinct(), "dim").orderBy("dim").collect()
    if any(s["most"] >= 2.0**53 for s in shapes):  # no product is larger, nor any sum on the way to it
        raise ValueError("components are too large: a squared length reaches 2**53, beyond which scores would not be exact")
    of = lambda df, s: df.where(F.col("dim") == s["dim"])
    found = [_of_one_length(of(valid, s), of(queries, s), s["dim"], s["most"], k, pivots, block, query_block) for s in shapes]
    if not found:
        return valid.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _of_one_length(valid: DataFrame, queries: DataFrame, dim: int, most: float, k: int, pivots: int, block: int, query_block: int) -> DataFrame:
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("ints").collect()
    centres = _augmented(np.array([r["ints"] for r in sample], np.float64), most)
    width = 2 * np.sqrt(max(most, 1.0)) / ANNULI

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("ints").to_pylist(), np.float64).reshape(-1, dim)
            d = _distances(_augmented(x, most), centres)
            near = d.argmin(1)
            far = d[np.arange(len(d)), near]
            ring = np.minimum((far / width).astype(np.int64), ANNULI - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near * ANNULI + ring), pa.array(far)],
                names=["vec_id", "ints", "ring", "far"],
            )

    index = cut(valid.select("vec_id", "ints").mapInArrow(key, "vec_id long, ints binary, ring long, far double"))
    rings = index.groupBy("ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).orderBy("ring").collect()
    number = np.array([r["ring"] for r in rings], np.int64)
    low, high = np.array([r["low"] for r in rings]), np.array([r["high"] for r in rings])
    blocks = np.array([-(-r["n"] // block) for r in rings], np.int64)
    counted = valid.sparkSession.createDataFrame([(int(n), int(b)) for n, b in zip(number, blocks, strict=True)], "ring long, blocks long")
    blocked = index.join(F.broadcast(counted), "ring").select("ring", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"), "vec_id", "ints")
    queries = cut(queries.select("vec_id", "ints").mapInArrow(key, "vec_id long, ints binary, ring long, far double").select(F.col("vec_id").alias("query_id"), "ints", "ring"))

    def searched(asked: DataFrame) -> DataFrame:
        """asked (query_id, q_ints, ring, block, beat): the best of each query in the blocks it asks for."""
        pair = ["ring", "block"]
        many = asked.groupBy(*pair).agg(F.ceil(F.count("*") / query_block).alias("parts"))
        asked = asked.join(many, pair).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).drop("parts")
        sides = blocked.join(many, pair).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        run = lambda left, right: _search(left, right, dim, k) if len(left) and len(right) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return sides.groupBy(*pair, "part").cogroup(asked.groupBy(*pair, "part")).applyInPandas(run, "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_of = lambda found: cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    own = queries.join(F.broadcast(counted), "ring").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    best = best_of(searched(own.select("query_id", F.col("ints").alias("q_ints"), "ring", "block", F.lit(float("-inf")).alias("beat"))))
    begin, step = 0, FIRST
    while begin < len(number):

        def expand(batches: Iterator[pa.RecordBatch], begin: int = begin, end: int = begin + step) -> Iterator[pa.RecordBatch]:
            """The rings from ``begin`` on in the order of their best possible scores that can still reach the score to beat."""
            for batch in batches:
                q = np.frombuffer(b"".join(batch.column("ints").to_pylist()), np.float64).reshape(-1, dim)
                beat = np.array([-np.inf if b is None else b for b in batch.column("beat").to_pylist()])
                d = _distances(np.column_stack([q, np.zeros(len(q))]), centres)[:, number // ANNULI]
                gap = np.maximum(0, np.maximum(low[None] - d, d - high[None]) - SLACK * (1 + d))
                most_ = ((q * q).sum(1)[:, None] + most - gap**2) / 2
                most_[number[None] == batch.column("ring").to_numpy()[:, None]] = np.inf  # the own ring comes first and is done
                column = np.argsort(-most_, axis=1, kind="stable")[:, 1 + begin : 1 + end]
                ahead = np.take_along_axis(most_, column, 1)
                row, place = np.nonzero(ahead + SLACK * (1 + np.abs(ahead)) >= beat[:, None])
                column = column[row, place]
                each = blocks[column]
                row, column = np.repeat(row, each), np.repeat(column, each)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("ints").take(take), pa.array(number[column]), pa.array(inside), pa.array(beat[row])], names=["query_id", "q_ints", "ring", "block", "beat"])

        beat = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("beat"))
        asked = cut(queries.join(beat, "query_id", "left").mapInArrow(expand, "query_id long, q_ints binary, ring long, block long, beat double"))
        if asked.isEmpty():
            break  # rings come by falling bounds and the score to beat only rises
        best = best_of(best.drop("rank").union(searched(asked)))
        begin, step = begin + step, step * 4
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
