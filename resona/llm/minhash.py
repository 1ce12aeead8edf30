"""MinHash near-dedup with tensored banding and exact verification.

1. Every text becomes its set of distinct ``words``-word shingles (64-bit hashes).
   Equal sets fall together first, by a partial aggregation on the set's hash, so
   thousands of copies count as one class.
2. A class gets ``collections`` small collections of ``rows`` minhashes each. Table
   keys are formed from PAIRS of collections, so ``collections * rows`` minhashes
   serve ``collections * (collections - 1) / 2`` tables: 28 hashes for 91 tables of 4.
   At similarity 0.8 a pair shares no table only if fewer than two of the 14
   collections agree: 1.6e-5 (3e-6 at 0.85).
   A collection's value that one class alone has can be in no shared key, so such
   values go first, with one row per collection instead of one per table.
3. Every class meets the hub of each of its buckets, the class whose collection values most
   classes share. A 28-byte sketch (one byte of each minhash) tells which pairs agree in
   ``AGREE`` hashes at least, which a pair at similarity 0.8 misses with probability 3e-6; the
   likeliest of a class is confirmed on the full sets. So a group of near copies becomes
   one component at a cost that follows its size.
4. Only buckets that still hold several components remain. Their classes meet by sketches
   where components differ, and those that may link are tied into candidate clusters. A
   bucket of more than ``block`` classes is replaced by the buckets of its classes' rarest
   shingles: two sets at the threshold share one of the ``size - least + 1`` rarest of
   each, where ``least`` is the smallest overlap a link allows, so texts that share
   boilerplate alone never meet.
5. Inside a cluster, blocks of ``block`` classes (``sketch_block`` where sketches meet) meet block by block in separate tasks, which
   compare full sets by one matrix product where components differ and return the
   spanning edges of their links. The components of all confirmed links are the groups.
   No pair is emitted, no bucket is capped, and no candidate is left out.

Classes are told apart by 128 bits of their shingles' hashes and numbered for the graph.

Defined results: a text with no words has an empty set and links with nothing; with
fewer words than a shingle, the whole sequence is the one shingle; rows with equal
sets are one class, whatever their doc_id; a null doc_id takes part and ties texts together, but a group's
id is its smallest doc_id that is not null (null if there is none; such rows are kept); an empty table gives no rows.
Columns besides doc_id and text are ignored, whatever their names.
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

SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: share of the minhashes that a pair must agree in before its full sets are compared
AGREE = 12 / 28


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text back to back, and each text's first (one entry more than texts)."""
    starts, ends, first = kernels.spans(raw, offsets)
    hashes = kernels.span_hashes(raw, starts, ends)
    counts = np.diff(first)
    full = np.zeros(0, np.uint64)
    if len(hashes) >= words:
        full = hashes[: len(hashes) - words + 1].copy()
        for k in range(1, words):
            full = kernels.mix64(full * kernels.BASE + hashes[k : len(hashes) - words + 1 + k])
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, n in enumerate(counts):
        if n >= words:
            sets.append(np.unique(full[first[i] : first[i + 1] - words + 1]))
        elif n:
            whole = np.array([n], np.uint64)
            for k in range(first[i], first[i + 1]):
                whole = kernels.mix64(whole * kernels.BASE + hashes[k : k + 1])
            sets.append(whole)
        else:
            continue
        sizes[i] = len(sets[-1])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _set_hash(values: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """One hash per set; sets are sorted and distinct, so the sum of scrambled members tells them apart."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix64(values ^ np.uint64(seed)), dtype=np.uint64)])
    return kernels.mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two halves of the text's hash."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def signatures(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """doc_id, t1, t2 (the text's hash), h1, h2 (the set's), n_shingles, minima (array of ``hashes`` longs; empty for empty sets)."""
    multipliers = kernels.mix64(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = kernels.mix64(np.arange(1001, hashes + 1001, dtype=np.uint64))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            values, bounds = shingle_sets(*kernels.text_bytes(piece.column("text")), words)
            sizes = np.diff(bounds)
            filled = np.flatnonzero(sizes)
            minima = np.empty((len(filled), hashes), np.uint64)
            for k in range(hashes):
                x = values * multipliers[k] + shifts[k]
                minima[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), bounds[:-1][filled]) if len(filled) else 0
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, hashes, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *(piece.column(c) for c in ("doc_id", "t1", "t2")),
                    *(_signed(_set_hash(values, bounds, seed)) for seed in SEEDS),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(ends), _signed(minima.reshape(-1))),
                ],
                names=["doc_id", "t1", "t2", "h1", "h2", "n_shingles", "minima"],
            )

    return _texts(docs).mapInArrow(run, f"doc_id {id_type}, t1 long, t2 long, h1 long, h2 long, n_shingles long, minima array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, members (its shingles' hashes) for ``nodes`` (node, first: the row that stands for it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            values, bounds = shingle_sets(*kernels.text_bytes(piece.column("text")), words)
            yield pa.RecordBatch.from_arrays([piece.column("node"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(values))], names=["node", "members"])

    asked = nodes.select("node", F.col("first.t1").alias("t1"), F.col("first.t2").alias("t2"), F.col("first.doc_id").alias("first_id"))
    found = _texts(docs).join(asked, ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
    return found.mapInArrow(run, "node long, members array<long>").groupBy("node").agg(F.first("members").alias("members"))


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products over the shingles both sides hold."""
    rows_l, rows_r = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    all_l, all_r = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(all_l, all_r)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(common):
        return out.astype(np.int64)
    place_l, place_r = np.searchsorted(common, all_l), np.searchsorted(common, all_r)
    in_l, in_r = common[np.minimum(place_l, len(common) - 1)] == all_l, common[np.minimum(place_r, len(common) - 1)] == all_r
    rows_l, place_l, rows_r, place_r = rows_l[in_l], place_l[in_l], rows_r[in_r], place_r[in_r]
    for at in range(0, len(common), 8192):
        x, y = np.zeros((len(left), min(8192, len(common) - at)), np.float32), np.zeros((len(right), min(8192, len(common) - at)), np.float32)
        mine, other = (place_l >= at) & (place_l < at + 8192), (place_r >= at) & (place_r < at + 8192)
        x[rows_l[mine], place_l[mine] - at] = 1
        y[rows_r[other], place_r[other] - at] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _agree(left: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b, s_a, s_b) whose sizes allow a link and whose sketches agree often enough: (a, b, agree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
            agree = (a == b).sum(1) if batch.num_rows else np.zeros(0, np.int64)
            near = pa.array(np.flatnonzero(agree >= AGREE * a.shape[1]) if batch.num_rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(near), batch.column("b").take(near), pa.array(agree.astype(np.int32)).take(near)], names=["a", "b", "agree"])

    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return left.where(fits).select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long, agree int")


def _blocked(members: DataFrame, key: str, block: int, tasks: int) -> DataFrame:
    """``members`` with p, q, second and task: every two blocks of a ``key`` meet in one task, small keys some to a task."""
    parts = members.groupBy(key).agg(F.ceil(F.count("*") / block).alias("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    placed = members.join(parts, key).withColumn("mine", F.pmod(F.xxhash64("node"), "parts")).withColumn("other", other)
    placed = placed.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other"), "second": F.col("mine") > F.col("other")}).drop("parts", "mine", "other")
    return placed.withColumn("task", F.when(F.col("q") == 0, F.pmod(F.xxhash64(key), F.lit(tasks))).otherwise(F.xxhash64(key, "p", "q")))


def _meet(members: DataFrame, percent: int, block: int, tasks: int) -> DataFrame:
    """members (bucket, node, comp, n, sketch): spanning edges (a, b) of the pairs of a bucket whose components differ and whose sizes and sketches allow a link."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["bucket", "p", "q", "second"], kind="stable")
        node, comp, n = (group[c].to_numpy() for c in ("node", "comp", "n"))
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        names, own = np.unique(node, return_inverse=True)  # a class is in many of the task's buckets, and is tied once
        top = np.arange(len(names))
        for left, right in kernels.pairs_within(group[["bucket", "p", "q"]].to_numpy(), (group["p"] == group["q"]).to_numpy(), group["second"].to_numpy()):
            live = (comp[left] != comp[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])) & (top[own[left]] != top[own[right]])
            left, right = left[live], right[live]
            near = (sketch[left] == sketch[right]).sum(1) >= AGREE * sketch.shape[1]
            top = kernels.union(top, own[left[near]], own[right[near]])
        tied = top != np.arange(len(top))
        return pd.DataFrame({"a": names[top[tied]], "b": names[tied]})

    placed = _blocked(members, "bucket", block, tasks)
    return placed.groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def _linked(members: DataFrame, percent: int, block: int, tasks: int) -> DataFrame:
    """members (cluster, node, comp, members): spanning edges (a, b) of the links of a cluster whose components differ."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.reset_index(drop=True)
        node, comp, sets = group["node"].to_numpy(), group["comp"].to_numpy(), [np.asarray(x) for x in group["members"]]
        top, size = np.arange(len(group)), np.array([len(x) for x in sets])
        for (_, p, q), own in group.groupby(["cluster", "p", "q"], sort=False):
            left, right = (own.index, own.index) if p == q else (own.index[~own["second"]], own.index[own["second"]])
            if len(left) and len(right):
                same = _intersections([sets[i] for i in left], [sets[i] for i in right])
                linked = (100 * same >= percent * (size[left][:, None] + size[right][None] - same)) & (comp[left][:, None] != comp[right][None])
                i, j = np.nonzero(linked)
                top = kernels.union(top, np.asarray(left)[i], np.asarray(right)[j])
        tied = top != np.arange(len(top))
        return pd.DataFrame({"a": node[top[tied]], "b": node[tied]})

    return _blocked(members, "cluster", block, tasks).groupBy("task").applyInPandas(compare, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    side = lambda to: sets.select(F.col("node").alias(to), F.col("members").alias(f"m_{to}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    same = F.size(F.array_intersect("m_a", "m_b"))
    return both.where(100 * same >= percent * (F.size("m_a") + F.size("m_b") - same)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, collections: int = 14, rows: int = 2, block: int = 512, sketch_block: int = 4096) -> DataFrame:
    """Per document: doc_id, t1, t2 (its text's hash), n_shingles, component_id (smallest doc_id reachable), kept (it is that document), keeper.

    Linked: 100 * intersection >= percent * union of the shingle sets. ``keeper`` marks
    one text under one doc_id in each group (the smallest doc_id, nulls last, and its
    first text by hash), and every text without words.
    """
    signed = cut(signatures(docs, words, collections * rows))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(row).alias("first"), F.first("minima").alias("minima"), F.first("n_shingles").alias("n"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    small = F.transform(F.sequence(F.lit(0), F.lit(collections - 1)), lambda c: F.xxhash64(F.slice("minima", c * rows + 1, F.lit(rows))))
    values = classes.select("node", F.posexplode(small).alias("c", "value"))
    repeated = cut(values.groupBy("c", "value").agg(F.count("*").alias("n")).where("n > 1"))
    held = values.join(repeated, ["c", "value"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("held"), F.sum("n").alias("popular"))
    pairs = F.expr("flatten(transform(held, (x, i) -> transform(slice(held, i + 2, size(held)), y -> xxhash64(x.c, y.c, x.value, y.value))))")
    keyed = cut(held.where(F.size("held") > 1).select("node", "popular", F.explode(pairs).alias("bucket")))
    edges = cut(keyed.groupBy("bucket").agg(F.max(F.struct("popular", "node"))["node"].alias("hub"), F.count("*").alias("many")).where("many > 1"))
    shared = keyed.join(edges, "bucket")
    sketch = F.unhex(F.array_join(F.transform("minima", lambda x: F.lpad(F.hex(F.pmod(x, F.lit(256))), 2, "0")), ""))
    brief = cut(shared.select("node").distinct().join(classes, "node").select("node", "n", "first", sketch.alias("sketch")))
    side = lambda to: brief.select(F.col("node").alias(to), F.col("n").alias(f"n_{to}"), F.col("sketch").alias(f"s_{to}"))
    stars = shared.select(F.col("hub").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    likely = _agree(stars.join(side("b"), "b").join(side("a"), "a"), percent)
    likely = cut(likely.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")))
    sets = cut(_sets(docs, brief, words))
    stars = cut(components(_confirmed(likely, sets, percent)))
    comp = F.coalesce("component", "node").alias("comp")
    placed = shared.join(stars, "node", "left").select("bucket", "node", "many", comp)
    open_ = cut(placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket"))
    left = cut(placed.join(open_, "bucket").join(brief.select("node", "n", "sketch"), "node"))
    tasks = max(1, left.count() // 32768)
    more = _meet(left.where(F.col("many") <= block).drop("many"), percent, sketch_block, tasks)
    large = left.where(F.col("many") > block).select("node", "comp", "n", "sketch").distinct()
    if not large.isEmpty():
        more = more.union(_meet(_rarest(large, sets, percent), percent, sketch_block, tasks))
    clusters = cut(components(more).select("node", F.col("component").alias("cluster")))
    tasks = max(1, clusters.count() // 512)
    inside = clusters.join(sets, "node").join(stars, "node", "left").select("cluster", "node", comp, "members")
    links = _linked(inside, percent, block, tasks)
    stars = cut(components(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)))
    ids = classes.select("h1", "h2", "node", "first").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("first").alias("least"))
    named = ids.join(least, "component").select("h1", "h2", "least")
    out = signed.select("doc_id", "t1", "t2", "h1", "h2", "n_shingles").join(named, ["h1", "h2"], "left")
    filled = F.col("n_shingles") > 0
    component = F.when(filled, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    keeper = ~filled | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("t1") == F.col("least.t1")) & (F.col("t2") == F.col("least.t2")))
    return out.select("doc_id", "t1", "t2", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), keeper.alias("keeper"))


def _rarest(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """nodes (node, ...) with ``bucket``: each of the shingles one of which every link of theirs must share."""
    members = cut(sets.join(nodes.select("node"), "node").select("node", F.explode("members").alias("bucket")))
    often = members.groupBy("bucket").agg(F.count("*").alias("times")).where("times > 1")
    rank = F.array_sort(F.collect_list(F.struct("times", "bucket")))
    # a shingle that one set alone has would be among the rarest: those are counted, not listed
    listed = members.join(often, "bucket").groupBy("node").agg(rank.alias("rank"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("rank"))
    rare = nodes.join(listed, "node").where(prefix > 0).select(*nodes.columns, F.explode(F.slice("rank", 1, prefix.cast("int"))).alias("own"))
    return rare.select(F.col("own.bucket").alias("bucket"), *nodes.columns)
