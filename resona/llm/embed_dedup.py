"""Embedding near-dedup with randomised-rotation binary codes.

Every unit vector is rotated by a shared random orthogonal matrix and kept as its
sign bits with a correction factor c = <rotated, signs / sqrt(d)>. For a pair,
<signs_a / sqrt(d), rotated_b> / c_a estimates the cosine without bias, and
``EPSILON * sqrt((1 - c^2) / c^2) / sqrt(d - 1)`` bounds its error with high
confidence. Only pairs whose estimate plus bound reaches the threshold are
recomputed, in double precision; only those at the threshold or above are links.

Candidates are vectors of equal label that agree in one of the bands of sign bits (of
as many rotations as that takes). A band has about log2 of the number of vectors plus
two bits, so a bucket holds few strangers however many vectors there are, and there are as
many bands as keep the probability that a pair at the threshold shares none below ``miss``
(28 bands of 18 bits at 65,000 vectors and cosine 0.98). A pair is counted in the first band it shares.

Vectors stay where they are: buckets get a code of some 200 bytes (sign bits, factor,
rotated values in half precision, bands). Only the vectors of pairs that the estimates
let through follow, and meet again in the bucket that found them. Equal vectors
are merged before anything is compared, and a bucket of more than ``block`` vectors is
compared block against block in separate tasks; tasks return counts and the
spanning edges of their own links, never pairs.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and rows with a null label or null vec_id, link with nothing; vectors
of different lengths link with nothing; repeated rows are separate vectors that link with
each other; an empty table gives no rows. Columns besides vec_id, embedding
and label are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import kernels
from resona.llm.components import components
from resona.llm.tables import cut
from resona.llm.vectors import finite, rotation

EPSILON = 5.0


def bands_for(vectors: int, threshold: float, miss: float) -> tuple[int, int]:
    """(number of bands, bits of a band) for so many vectors."""
    bits = min(62, max(8, int(np.ceil(np.log2(max(vectors, 2)))) + 2))
    agree = 1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi
    share = min(agree**bits, 1 - 1e-12)
    return max(1, int(np.ceil(np.log(miss) / np.log1p(-share)))), bits


def encode(classes: DataFrame, tables: int, band_bits: int) -> DataFrame:
    """node, dim, code (sign bits), factor, turned (half-precision rotated vector), bands (one long per table, as bytes)."""
    turns: dict = {}

    def rotation_of(d: int, k: int) -> np.ndarray:
        if (d, k) not in turns:
            turns[d, k] = rotation(d, 11 + k)
        return turns[d, k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                unit = _units(part.column("embedding"), d)
                turned = unit @ rotation_of(d, 0).T
                more = [unit @ rotation_of(d, k).T > 0 for k in range(1, -(-tables * band_bits // d))]
                bits = np.concatenate([turned > 0, *more], axis=1)[:, : tables * band_bits].reshape(len(unit), tables, band_bits)
                bands = bits @ (1 << np.arange(band_bits, dtype=np.int64))
                codes, factors = np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(d)
                as_bytes = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("label_key"), part.column("dim"), part.column("copies"), as_bytes(codes), pa.array(factors), as_bytes(turned.astype(np.float16)), as_bytes(bands)],
                    names=["node", "label_key", "dim", "copies", "code", "factor", "turned", "bands"],
                )

    return classes.select("node", "label_key", "dim", "copies", "embedding").mapInArrow(
        run, "node long, label_key string, dim int, copies long, code binary, factor double, turned binary, bands binary"
    )


def _units(column: pa.Array, d: int) -> np.ndarray:
    """Rows of unit length; scaled by their largest component first, so that no square over- or underflows."""
    v = np.asarray(column.flatten().cast(pa.float64())).reshape(-1, d)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _near(group: pd.DataFrame, threshold: float, dim: int, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of each bucket and block pair that the estimates let through, each in the first band it shares."""
    signs = np.unpackbits(np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1), axis=1)[:, :dim].astype(np.float32) * 2 - 1
    turned = np.frombuffer(b"".join(group["turned"]), np.float16).reshape(len(group), dim).astype(np.float32)
    bands = np.frombuffer(b"".join(group["bands"]), np.int64).reshape(len(group), -1)
    factor, table = group["factor"].to_numpy(), group["t"].to_numpy()
    # the half-precision values add their rounding to the bound
    slack = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2) / np.sqrt(max(dim - 1, 1)) + 2.0**-10 / factor
    keys = group[["bucket", "p", "q"]].to_numpy()
    for left, right in kernels.pairs_within(keys, (group["p"] == group["q"]).to_numpy(), group["second"].to_numpy(), most):
        estimate = np.einsum("ij,ij->i", signs[left], turned[right]) / (np.sqrt(dim) * factor[left])
        near = np.flatnonzero(estimate + slack[left] >= threshold)
        left, right = left[near], right[near]
        before = np.arange(bands.shape[1])[None] < table[left][:, None]
        fresh = ~((bands[left] == bands[right]) & before).any(1)
        if fresh.any():
            yield left[fresh], right[fresh]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 5e-5, block: int = 1024) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    takes_part = (
        finite()
        & F.exists("embedding", lambda x: x != 0)
        & F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
    )
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label_key"), F.coalesce(takes_part, F.lit(False)).alias("valid"))
    # equal vectors by 128 bits; adding zero makes a negative zero a zero
    same = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    rows = rows.withColumns({h: F.when(F.col("valid"), F.xxhash64(F.lit(i), "label_key", same)) for i, h in enumerate(("h1", "h2"))})
    classes = (
        rows.where("valid")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label_key").alias("label_key"), F.first("embedding").alias("embedding"))
    )
    classes = cut(classes.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))
    tables, band_bits = bands_for(classes.count(), threshold, miss)
    coded = cut(encode(classes, tables, band_bits))
    places = F.sequence(F.lit(0), F.lit(tables - 1))
    # a band's bytes serve as its value
    keys = coded.select("node", "label_key", "dim", F.explode(places).alias("t"), "bands").select("node", "t", F.xxhash64("label_key", "dim", "t", F.substring("bands", F.col("t") * 8 + 1, F.lit(8))).alias("bucket"))
    shared = cut(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, total // 16384)
    mine = F.pmod(F.xxhash64("node"), "parts")
    placed = (
        keys.join(shared, "bucket")
        .withColumn("parts", F.ceil(F.col("n") / block))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("node", "t", "bucket", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") > F.col("other")).alias("second"))
        .withColumn("task", F.when(F.col("q") == 0, F.pmod("bucket", F.lit(tasks))).otherwise(F.xxhash64("bucket", "p", "q")))
    )
    codes = coded.select("node", "dim", "code", "factor", "turned", "bands")

    def by_length(group: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        for dim, own in group.groupby("dim", sort=False):
            yield int(dim), own.sort_values(["bucket", "p", "q", "second"], kind="stable").reset_index(drop=True)

    def estimate(group: pd.DataFrame) -> pd.DataFrame:
        """The rows that are in a pair let through."""
        out = []
        for dim, own in by_length(group):
            hit = np.zeros(len(own), bool)
            for left, right in _near(own, threshold, dim):
                hit[left] = hit[right] = True
            out.append(own.loc[hit, ["task", "node", "t", "bucket", "p", "q", "second"]])
        return pd.concat(out)

    def recompute(group: pd.DataFrame) -> pd.DataFrame:
        """Per row of a pair let through: its links by the vectors themselves, and the node that stands for the rows it links with."""
        out = []
        for dim, own in by_length(group):
            unit = _units(pa.array(own["embedding"], pa.list_(pa.float64())), dim)
            copies, counts, root = own["copies"].to_numpy(), np.zeros(len(own), np.int64), np.arange(len(own))
            for left, right in _near(own, threshold, dim):
                linked = np.einsum("ij,ij->i", unit[left], unit[right]) >= threshold
                left, right = left[linked], right[linked]
                np.add.at(counts, left, copies[right])
                np.add.at(counts, right, copies[left])
                root = kernels.union(root, left, right)
            node, some = own["node"].to_numpy(), counts > 0
            out.append(pd.DataFrame({"node": node, "links": counts, "top": node[root]})[some])
        return pd.concat(out)

    let_through = cut(placed.join(codes, "node").groupBy("task").applyInPandas(estimate, "task long, node long, t int, bucket long, p long, q long, second boolean"))
    exact = codes.join(classes.select("node", "copies", "embedding"), "node")
    found = cut(let_through.join(exact, "node").groupBy("task").applyInPandas(recompute, "node long, links long, top long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("top").alias("b")))
    grouped = classes.select("h1", "h2", "node", "first_id", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "component").join(links, "node", "left").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.coalesce("component_id", F.col("vec_id"))
    return rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
