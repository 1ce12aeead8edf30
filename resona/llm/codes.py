"""Vector code compression: integer product codes whose codebooks come from a dual-tree Lloyd.

Components become floor(4096 * x); a vector is cut into 8 consecutive parts, and every
part is replaced by the number of its nearest codebook entry.

* Vectors are cut once into blocks of at most ``block`` rows, written to the shared
  checkpoint folder. A block keeps, for each part position, its rows in the order of a
  balanced tree (halved at the median of the widest component), with every node's
  box, row count and sum of rows.
* In every round each block meets a tree over the entries. Pairs of a node of parts and
  a node of entries descend together: a pair goes when the least distance of its boxes
  exceeds the smallest upper bound of the node. Single entries go as well when another
  one is nearer (or as near, with a lower index) in every corner of the node's box. A node
  left with one entry is assigned whole, by its cached sum and count; leaves that stay
  uncertain compare their rows with the entries left, in integers.
* Tasks return sums and counts only, added up by Spark; the codebooks (8 * 16 entries)
  are all that the driver holds between rounds.

Every bound is an integer, so pruning never changes an assignment.

Defined results: rows whose vector is null, empty, or holds null or non-finite
components are dropped. Vectors of each length have codebooks of their own; a length that 8 does
not divide counts as filled up with zeros. A codebook starts with the 16 smallest kept
vec_ids (nulls last, rows of one vec_id by their vectors), with fewer entries where there are fewer rows. Repeated
rows count each. Components so large that squared distances or sums leave 64 bits
raise an error. An empty table gives no rows. Other columns pass through, except
those that bear the name of a result in any case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm.tables import cut, without
from resona.llm.vectors import finite

PARTS = 8
ENTRIES = 16
SCALE = 4096
LEAF = 16
RESULTS = ("code", "error", "label_error", "codebooks_sha256")


@dataclass
class Tree:
    """``PARTS`` balanced trees over equally many points: points [PARTS, n, w] in tree order, levels from the root down."""

    points: np.ndarray
    order: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    total: list[np.ndarray]
    count: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.low) - 1


def grow(parts: np.ndarray, leaf: int) -> Tree:
    """Trees over ``parts`` [PARTS, n, w]; the last row fills the leaves up and weighs nothing there."""
    groups, n, w = parts.shape
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if n > leaf else 0
    size = leaf if depth else max(n, 1)
    padded = size << depth
    order = np.broadcast_to(np.minimum(np.arange(padded), n - 1), (groups, padded)).copy()
    weight = np.broadcast_to(np.arange(padded) < n, (groups, padded)).copy()
    points = np.take_along_axis(parts, order[:, :, None], 1)
    for level in range(depth):
        shape = (groups << level, padded >> level)
        inside = points.reshape(*shape, w)
        widest = (inside.max(1) - inside.min(1)).argmax(1)
        rank = np.argsort(np.take_along_axis(inside, widest[:, None, None], 2)[:, :, 0], axis=1, kind="stable")
        points = np.take_along_axis(inside, rank[:, :, None], 1).reshape(groups, padded, w)
        order = np.take_along_axis(order.reshape(shape), rank, 1).reshape(groups, padded)
        weight = np.take_along_axis(weight.reshape(shape), rank, 1).reshape(groups, padded)
    leaves = points.reshape(groups, 1 << depth, size, w)
    heavy = weight.reshape(groups, 1 << depth, size)
    low, high, total, count = [leaves.min(2)], [leaves.max(2)], [(leaves * heavy[..., None]).sum(2)], [heavy.sum(2)]
    for _ in range(depth):
        halves = lambda x: (x[:, 0::2], x[:, 1::2])
        low.append(np.minimum(*halves(low[-1])))
        high.append(np.maximum(*halves(high[-1])))
        total.append(np.add(*halves(total[-1])))
        count.append(np.add(*halves(count[-1])))
    return Tree(points, np.where(weight, order, -1), low[::-1], high[::-1], total[::-1], count[::-1])


def _gap(low: np.ndarray, high: np.ndarray, low_e: np.ndarray, high_e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of the points of two boxes."""
    near = np.maximum(0, np.maximum(low_e - high, low - high_e))
    far = np.maximum(high_e - low, high - low_e)
    return (near * near).sum(-1), (far * far).sum(-1)


def _dominated(low: np.ndarray, high: np.ndarray, entry: np.ndarray, number: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Pairs (rows sorted by ``node``) whose entry is farther than the one nearest the box's middle, all over the box."""
    middle = low + high - 2 * entry
    key = (middle * middle).sum(-1)
    begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    stretch = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1
    best = np.full(len(begins), -1)
    first = key == np.minimum.reduceat(key, begins)[stretch]
    best[stretch[first][::-1]] = np.flatnonzero(first)[::-1]
    rival = best[stretch]
    step = entry - entry[rival]
    corner = np.where(step > 0, high, low)
    worst = 2 * (corner * step).sum(-1) + (entry[rival] ** 2).sum(-1) - (entry**2).sum(-1)
    return ((worst < 0) | ((worst == 0) & (number[rival] < number))) & (rival != np.arange(len(entry)))


def assign(tree: Tree, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry of every point in tree order, sums [PARTS, k, w], counts [PARTS, k], point distances computed) for ``books`` [PARTS, k, w]."""
    groups, padded, w = tree.points.shape
    k = books.shape[1]
    entries = grow(books, 1)
    numbers = entries.order  # of the entries in the order of their tree; -1 fills it up
    code = np.zeros((groups, padded), np.int64)
    sums, counts = np.zeros((groups, k, w), np.int64), np.zeros((groups, k), np.int64)
    part, node, side = np.arange(groups), np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    level = side_level = 0
    while True:
        low, high = tree.low[level][part, node], tree.high[level][part, node]
        low_e, high_e = entries.low[side_level][part, side], entries.high[side_level][part, side]
        near, far = _gap(low, high, low_e, high_e)
        place = part * (1 << level) + node
        bound = np.full(groups << level, np.iinfo(np.int64).max)
        np.minimum.at(bound, place, far)
        keep = (near <= bound[place]) & (entries.count[side_level][part, side] > 0)
        part, node, side, low, high, place = (x[keep] for x in (part, node, side, low, high, place))
        if side_level == entries.depth:
            sort = np.lexsort((side, place))
            part, node, side, low, high, place = (x[sort] for x in (part, node, side, low, high, place))
            keep = ~_dominated(low, high, entries.points[part, side], numbers[part, side], place)
            part, node, side, place = (x[keep] for x in (part, node, side, place))
            alone = np.bincount(place, minlength=groups << level)[place] == 1
            p, at, e = part[alone], node[alone], numbers[part[alone], side[alone]]
            np.add.at(sums, (p, e), tree.total[level][p, at])
            np.add.at(counts, (p, e), tree.count[level][p, at])
            span = padded >> level
            code.reshape(groups, 1 << level, span)[p, at] = e[:, None]
            part, node, side = part[~alone], node[~alone], side[~alone]
        if not len(part) or level == tree.depth and side_level == entries.depth:
            break
        for axis in range(2):  # both sides of the pair open up
            if axis == 0 and level < tree.depth:
                part, node, side = np.repeat(part, 2), (2 * node[:, None] + [0, 1]).reshape(-1), np.repeat(side, 2)
            if axis == 1 and side_level < entries.depth:
                part, node, side = np.repeat(part, 2), np.repeat(node, 2), (2 * side[:, None] + [0, 1]).reshape(-1)
        level, side_level = min(level + 1, tree.depth), min(side_level + 1, entries.depth)
    work = 0
    if len(part):
        size = padded >> tree.depth
        leaves = tree.points.reshape(groups, 1 << tree.depth, size, w)
        number = numbers[part, side]
        apart = leaves[part, node] - books[part, number][:, None]
        key = (apart * apart).sum(-1) * ENTRIES + number[:, None]
        work = key.size
        place = part * (1 << tree.depth) + node
        sort = np.argsort(place, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(place[sort]) != 0]))
        best = np.minimum.reduceat(key[sort], begins) % ENTRIES
        p, at = part[sort][begins], node[sort][begins]
        code.reshape(groups, 1 << tree.depth, size)[p, at] = best
        real = tree.order.reshape(groups, 1 << tree.depth, size)[p, at] >= 0
        who = np.broadcast_to(p[:, None], best.shape)[real], best[real]
        np.add.at(sums, who, leaves[p, at][real])
        np.add.at(counts, who, 1)
    return code, sums, counts, work


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """[rows, dim filled up to a multiple of PARTS] of floor(SCALE * x)."""
    v = np.floor(np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dim) * SCALE).astype(np.int64)
    return np.pad(v, ((0, 0), (0, -dim % PARTS)))


def _split(v: np.ndarray) -> np.ndarray:
    """[PARTS, rows, w] of rows of integers."""
    return np.ascontiguousarray(v.reshape(len(v), PARTS, -1).transpose(1, 0, 2))


def _packed(tree: Tree) -> bytes:
    return b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in (tree.points, tree.order, *tree.low, *tree.high, *tree.total, *tree.count))


def _unpacked(raw: bytes, depth: int, padded: int, w: int) -> Tree:
    flat, at = np.frombuffer(raw, np.int64), 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        at += (n := int(np.prod(shape)))
        return flat[at - n : at].reshape(shape)

    points, order = take(PARTS, padded, w), take(PARTS, padded)
    box = [[take(PARTS, 1 << level, w) for level in range(depth + 1)] for _ in range(3)]
    return Tree(points, order, *box, [take(PARTS, 1 << level) for level in range(depth + 1)])


def blocks_of(rows: DataFrame, dim: int, block: int) -> DataFrame:
    """rows (row, embedding) of one length as blocks: their rows, and their trees as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                tree = grow(_split(_integers(part.column("embedding"), dim)), LEAF)
                own = part.column("row")
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([tree.depth], pa.int32()), pa.array([tree.points.shape[1]], pa.int32()), pa.array([_packed(tree)], pa.binary())],
                    names=["rows", "depth", "padded", "tree"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"rows array<{kind}>, depth int, padded int, tree binary"))


def _trees(batch: pa.RecordBatch, w: int) -> Iterator[Tree]:
    for depth, padded, raw in zip(batch.column("depth").to_pylist(), batch.column("padded").to_pylist(), batch.column("tree"), strict=True):
        yield _unpacked(raw.as_buffer(), depth, padded, w)


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of the mean of each entry's parts; an entry without parts stays."""
    w = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for tree in _trees(batch, w):
                _, s, n, _ = assign(tree, books)
                sums, counts = sums + s, counts + n
        place = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.reshape(-1)), pa.array(np.repeat(counts.reshape(-1), w))], names=["place", "total", "n"])

    found = blocks.select("depth", "padded", "tree").mapInArrow(run, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0")
    out = books.reshape(-1).copy()
    for r in found.collect():  # at most PARTS * ENTRIES * w rows
        out[r["place"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def _coded(blocks: DataFrame, books: np.ndarray, kind: str) -> DataFrame:
    """row, code, error of every row for the last ``books``."""
    w = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tree in enumerate(_trees(batch, w)):
                own = batch.column("rows")[i].values
                found, _, _, _ = assign(tree, books)
                apart = tree.points - books[np.arange(PARTS)[:, None], found]
                codes, errors = np.zeros((len(own), PARTS), np.int64), np.zeros(len(own), np.int64)
                for p in range(PARTS):
                    real = tree.order[p] >= 0
                    codes[tree.order[p][real], p] = found[p][real]
                    errors[tree.order[p][real]] += (apart[p][real] ** 2).sum(-1)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([own, pa.array(text), pa.array(errors)], names=["row", "code", "error"])

    return blocks.mapInArrow(run, f"row {kind}, code string, error long")


def compress(vectors: DataFrame, rounds: int = 6, block: int = 2048) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(``vectors`` without embedding, plus code, error and codebooks_sha256, one row per kept vector; codebooks [PARTS, entries, w] by vector length)."""
    kept = without(vectors, *RESULTS, "embedding").columns
    rows = vectors.where(finite()).select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("vec_id").alias("id"), "embedding")
    kind = rows.schema["row"].dataType.simpleString()
    shapes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("most")).orderBy("dim").collect()
    out, books_of = [], {}
    for dim, most in shapes:
        w = -(-dim // PARTS)
        if w * (2 * SCALE * most + 2) ** 2 * ENTRIES >= 2.0**62:
            raise ValueError(f"a component of size {most:g} is too large for codes in 64-bit integers")
        own = rows.where(F.size("embedding") == dim)
        floats = F.transform("embedding", lambda x: x.cast("double"))
        first = own.select("id", floats.alias("v")).orderBy(F.col("id").isNull(), "id", "v").limit(ENTRIES).collect()
        books = _split(_integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dim))
        blocks = blocks_of(own.select("row", "embedding"), dim, block)
        for _ in range(rounds):
            books = _round(blocks, books)
        books_of[dim] = books
        out.append(_coded(blocks, books, kind).withColumn("codebooks_sha256", F.lit(digest(books))))
    if not out:
        empty = rows.where("false").select("row", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
        return empty.select("row.*", "code", "error", "codebooks_sha256"), books_of
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole.select("row.*", "code", "error", "codebooks_sha256"), books_of


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` plus label_error: the errors summed over rows of equal label, nulls together. The sums of few labels are broadcast by Spark itself."""
    coded = cut(coded)
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
