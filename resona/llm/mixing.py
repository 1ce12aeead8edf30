"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Words are counted per document and summed per source.
2. Every source gets a target: its weight's share of all words, stopped at
   ``cap`` times its own size, the excess shared again by weight.
3. The mix has ``total / block_words`` blocks. Sainte-Laguë's highest quotients
   ``target / (2k + 1)`` give each source an integer number of them, and the
   same rule splits a source's blocks over its shards by the shards' words.
4. In a shard the documents lie in a seeded order and are cut into equal-token
   blocks. The quota takes whole passes over the shard first, then a seeded run
   of blocks, so a document's ``taken`` words follow from its place alone.

A source has a shard for every ``shard_words`` words, at most ``most_shards``, so a source with
a third of all rows is spread over many tasks and no task holds more than ``most_shards`` sums. Rows that are equal in
doc_id, source and text (and ``by``) travel as one row with their number, and their copies lie one after another, so
copies without a doc_id are no group for one task either. One row per source is planned in one task.

Defined results: a null or empty text has size 0 and takes 0; a null source is a
source of its own, sorted last; a null doc_id is placed by its text alone;
repeated rows are placed one after another; an empty table gives no rows. Columns
besides doc_id, text, source and ``by`` are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resona.llm.tables import WHITE, cut

WEIGHTS = (5.0, 2.0, 1.0)
#: sources whose plan is sent to every task; more are joined by a shuffle, each source dealt over ``SALTS`` keys
MOST_BROADCAST = 10_000
SALTS = 256


def capped_targets(sizes: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Shares of ``sizes.sum()`` by weight, none above ``cap`` times its size; the excess is shared again by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, limit, open_ = np.zeros(len(sizes)), cap * sizes, np.ones(len(sizes), bool)
    while open_.any():
        share = (sizes.sum() - target[~open_].sum()) * weights / weights[open_].sum()
        over = open_ & (share > limit)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = limit[over]
        open_ &= ~over
    return target


def sainte_lague(claims: np.ndarray, seats: int, limits: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients claim / (2k + 1), none above its limit; ties go to the earlier claim.

    Starts from the quotients that are surely among the highest and settles the
    remaining few with a heap, so the work does not follow the number of seats.
    """
    claims, limits = np.asarray(claims, float), np.asarray(limits, np.int64)
    seats = int(min(seats, limits[claims > 0].sum()))
    if seats <= 0 or not len(claims):
        return np.zeros(len(claims), np.int64)
    low, high = 0.0, seats / claims.sum() * 2 + 1 / claims[claims > 0].min()
    given = lambda x: np.minimum(np.floor(claims * x + 0.5).astype(np.int64), limits)
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() <= seats:
            low = middle
        else:
            high = middle
    out = given(low)
    heap = [(-c / (2 * k + 1), i) for i, (c, k, m) in enumerate(zip(claims, out, limits, strict=True)) if c > 0 and k < m]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < limits[i]:
            heapq.heappush(heap, (-claims[i] / (2 * out[i] + 1), i))
    return out


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    cap: int = 3,
    block_words: int = 16,
    shard_words: int = 100_000,
    most_shards: int = 4096,
    seed: str = "mix",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: doc_id, source, order_key, ``by``, size, source_size, target (its source's), taken words, and what they are.

    ``passes`` is how often the whole document is taken, ``ranges`` the stretches (first
    word, number of words) taken once more. ``order_key`` is the seeded hash of the
    doc_id and text; ``by`` names columns that tell further rows apart.
    """
    white = F.lit(f"[^{WHITE}]+")
    digest = F.md5(F.coalesce("text", F.lit("")))
    sized = docs.select(
        "doc_id",
        "source",
        *by,
        F.coalesce(F.regexp_count("text", white), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest)).alias("order_key"),
    )
    sized = cut(sized.groupBy("doc_id", "source", *by, "order_key", "size").agg(F.count("*").alias("copies")))
    named = sized.select("*", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"))
    words = F.col("size") * F.col("copies")
    sources = named.groupBy("no_source", "source_key").agg(F.sum(words).alias("source_size"))

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(code_points=group["source_key"].map(lambda s: s.encode())).sort_values(["no_source", "code_points"]).reset_index(drop=True)
        size = group["source_size"].to_numpy(np.int64)
        target = capped_targets(size, np.resize(np.asarray(weights, float), len(size)), cap)
        blocks = -(-size // block_words)
        quota = sainte_lague(target, int(np.floor(size.sum() / block_words + 0.5)), cap * blocks)
        return group[["no_source", "source_key", "source_size"]].assign(target=target, quota=quota)

    planned = cut(
        sources.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(plan, "no_source boolean, source_key string, source_size long, target double, quota long")
    )
    key = ["no_source", "source_key"]
    if planned.count() <= MOST_BROADCAST:
        placed = named.join(F.broadcast(planned), key)
    else:
        dealt = planned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = named.withColumn("salt", F.pmod(F.hash("order_key"), F.lit(SALTS))).join(dealt, [*key, "salt"]).drop("salt")
    shards = F.least(F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)), F.lit(most_shards))
    placed = placed.withColumn("shard", F.pmod(_number(F.col("order_key")), shards))
    sums = placed.groupBy(*key, "shard").agg(F.sum(words).alias("shard_size"), F.first("quota").alias("quota"))

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard").reset_index(drop=True)
        size = group["shard_size"].to_numpy(np.int64)
        quota = sainte_lague(size, int(group["quota"].iloc[0]), cap * -(-size // block_words))
        return group[["no_source", "source_key", "shard", "shard_size"]].assign(shard_quota=quota)

    quotas = sums.groupBy(*key).applyInPandas(split, "no_source boolean, source_key string, shard long, shard_size long, shard_quota long")
    run = Window.partitionBy(*key, "shard").orderBy("order_key", "doc_id", "size", *by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = F.ceil(F.col("shard_size") / block_words)
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), "source_key", F.lit(":"), F.col("shard").cast("string")))
    chosen = (
        placed.join(quotas, [*key, "shard"])
        .withColumn("begin", F.sum(words).over(run) - words)
        .withColumn("passes", F.when(blocks > 0, F.floor(F.col("shard_quota") / blocks)).otherwise(F.lit(0)))
        .withColumn("rest", F.col("shard_quota") - F.col("passes") * blocks)
        .withColumn("first", F.when(blocks > 0, F.pmod(_number(seeded), blocks)).otherwise(F.lit(0)))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("begin") + F.col("copy") * F.col("size"))
    )
    # the run is cyclic: what goes beyond the last block starts again at the first
    over = F.greatest(F.col("first") + F.col("rest") - blocks, F.lit(0))
    ranges = F.array(_overlap(F.lit(0), over, block_words), _overlap(F.col("first"), F.least(F.col("first") + F.col("rest"), blocks), block_words))
    return chosen.withColumn("ranges", F.filter(ranges, lambda r: r["words"] > 0)).select(
        "doc_id",
        "source",
        "order_key",
        *by,
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["words"])).cast("long").alias("taken"),
        F.col("passes").cast("long").alias("passes"),
        "ranges",
    )


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often and as far as ``mix`` takes it.

    Whole passes give the row as it is; a stretch gives the row with the text from the
    stretch's first word to its last. Rows differ by all their columns, so none is mistaken for another.
    """
    key = ["doc_id", "source", "order_key", "row_key"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select("doc_id", "source", "text", F.xxhash64(row).alias("row_key"), row.alias("row"))
    mixed = mix(keyed, by=("row_key",), **options).where("taken > 0")
    digest = F.md5(F.coalesce("text", F.lit("")))
    order_key = F.md5(F.concat(F.lit(f"{options.get('seed', 'mix')}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), digest))
    texts = keyed.select("doc_id", "source", order_key.alias("order_key"), "row_key", "row").groupBy(*key).agg(F.first("row").alias("row"))
    same = reduce(lambda a, b: a & b, [F.col(f"t.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key])
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("first"), F.col("m.size").alias("words")), F.col("passes").cast("int"))
    each = texts.alias("t").join(mixed.alias("m"), same).select("row", "size", F.explode(F.concat(whole, "ranges")).alias("part"))
    # a word with the blanks before it, so that a stretch keeps the text between its words
    words = F.slice(F.regexp_extract_all("row.text", F.lit(f"[{WHITE}]*[^{WHITE}]+"), F.lit(0)), (F.col("part.first") + 1).cast("int"), F.col("part.words").cast("int"))
    stretch = F.regexp_replace(F.array_join(words, ""), f"^[{WHITE}]+", "")
    text = F.when(F.col("part.words") == F.col("size"), F.col("row.text")).otherwise(stretch)
    return each.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _number(digest):
    """The first 32 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _overlap(first, last, block_words: int):
    """The words of a document from ``start`` on that lie inside the blocks [first, last): its first such word and their number."""
    begin = F.greatest(F.col("start"), first * block_words)
    end = F.least(F.col("start") + F.col("size"), last * block_words)
    return F.struct((begin - F.col("start")).cast("long").alias("first"), F.greatest(F.lit(0), end - begin).cast("long").alias("words"))
