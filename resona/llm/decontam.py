"""Benchmark decontamination: a prefix-filtered set join of documents with item windows.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one
window. Every document word inside an occurrence of a window is hit.

1. The items' distinct windows and their shingles (``SHINGLE`` words, fewer in shorter windows) are listed.
2. One scan of all documents counts these shingles. A window's shingles are ordered by rarity; as an
   occurrence holds all of them, the necessary prefix is the rarest one alone.
3. A second scan meets the documents' shingles with the windows' prefix shingles. The
   shingle's place in the window gives the one place where the window can lie; it must not
   begin before the document nor end behind it.
4. Of what is left, word lengths and hashes and then the words' bytes are compared over the whole
   window, so a hit is exact.

Documents never move: each scan is one pass of tasks that hold the windows of one slice, at
most ``most_windows``. More windows are matched slice by slice, and the slices' findings
meet by the text's hash; the result is the same. A passage that a third of all documents share
costs its documents no more than any other.

Defined results: null and empty texts have no words; an item without words has no
window; an item without item_id hits words, but is no item that could be counted; items that share
a window are all found by it; repeated rows get equal results; an empty table gives no
rows, and an empty benchmark no hits. Other columns than the text pass through, except those that
bear the name of a result in any case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import kernels
from resona.llm.tables import cut, without

OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SHINGLE = 3
#: windows that a task holds at once, some 300 bytes each
MOST_WINDOWS = 200_000
RESULTS = ("n_words", "n_hit", "n_items", "items", "hits")


@dataclass
class Words:
    """The words of many texts back to back."""

    first: np.ndarray  # each text's first word, one entry more than texts
    length: np.ndarray  # bytes of each word
    hashes: np.ndarray
    at: np.ndarray  # where each word begins in ``data``, one entry more than words
    data: bytes  # the words' lower-cased bytes

    @staticmethod
    def of(column: pa.Array) -> Words:
        raw, offsets = kernels.text_bytes(column)
        starts, ends, first = kernels.spans(raw, offsets, OUTSIDE)
        length = ends - starts
        return Words(first, length, kernels.span_hashes(raw, starts, ends), np.concatenate([[0], np.cumsum(length)]), LOWER[raw[~OUTSIDE[raw]]].tobytes())

    def shingles(self, size: int) -> np.ndarray:
        """The hash of the ``size`` words from each word on, whatever the texts' ends."""
        n = max(0, len(self.hashes) - size + 1)
        out = kernels.mix64(self.hashes[:n] + np.uint64(size))
        for k in range(1, size):
            out = kernels.mix64(out * kernels.BASE + self.hashes[k : k + n])
        return out

    def room(self) -> np.ndarray:
        """How many words of its text follow each word, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hashes))


class Lookup:
    """Which of many 64-bit hashes belong to a set: a bit table first, then a search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - int(np.clip(np.ceil(np.log2(16 * max(1, len(keys)))), 12, 26)))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[keys >> self.shift] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that are in the set."""
        some = np.flatnonzero(self.table[hashes >> self.shift])
        if not len(self.keys):
            return some[:0]
        found = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        return some[self.keys[found] == hashes[some]]


def windows_of(benchmark: DataFrame, window: int, most_windows: int) -> tuple[DataFrame, int]:
    """(window, size, shingles, items, slice) of the distinct windows, and the number of slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            words = Words.of(piece.column("text"))
            texts, sizes, shingles, items = [], [], [], []
            by_size = {s: words.shingles(s).view(np.int64) for s in range(1, SHINGLE + 1)}
            ids = piece.column("item").to_pylist()
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                for at in range(a, max(b - window, a) + 1) if b > a else ():
                    n = min(window, b - at)
                    s = min(SHINGLE, n)
                    texts.append(b" ".join(words.data[words.at[k] : words.at[k + 1]] for k in range(at, at + n)).decode())
                    sizes.append(n)
                    shingles.append(by_size[s][at : at + n - s + 1].tolist())
                    items.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(shingles, pa.list_(pa.int64())), pa.array(items, pa.string())], names=["window", "size", "shingles", "item"])

    listed = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text IS NOT NULL").mapInArrow(run, "window string, size int, shingles array<long>, item string")
    distinct = cut(listed.groupBy("window", "size", "shingles").agg(F.array_sort(F.collect_set("item")).alias("items")))
    slices = max(1, -(-distinct.count() // most_windows))
    return distinct.withColumn("slice", F.pmod(F.xxhash64("window"), F.lit(slices))), slices


def _counts(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(shingle, n): how often each of ``shingles`` (shingle, length; those of one slice) occurs in all documents."""
    listed = shingles.toPandas()
    wanted = {int(s): Lookup(own["shingle"].to_numpy(np.int64).view(np.uint64)) for s, own in listed.groupby("length")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text"):
            words = Words.of(piece.column("text"))
            room = words.room()
            for size, lookup in wanted.items():
                hashes = words.shingles(size)
                at = lookup.places(hashes)
                values, n = np.unique(hashes[at[room[at] >= size]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


class Windows:
    """One slice's windows by their prefix shingle, as arrays."""

    def __init__(self, rows: pa.Table, window: int):
        key = np.asarray(rows.column("key").combine_chunks()).view(np.uint64)
        order = np.argsort(key, kind="stable")
        rows = rows.take(pa.array(order))
        self.key, self.size, self.place = key[order], np.asarray(rows.column("size"), np.int64), np.asarray(rows.column("place"), np.int64)
        words = Words.of(rows.column("window").combine_chunks())
        self.data, self.begin = words.data, words.at[words.first]
        self.hashes, self.length = np.zeros((len(key), window), np.uint64), np.zeros((len(key), window), np.int64)
        row, column = np.repeat(np.arange(len(key)), self.size), np.arange(len(words.hashes)) - np.repeat(words.first[:-1], self.size)
        self.hashes[row, column], self.length[row, column] = words.hashes, words.length
        items = rows.column("items").combine_chunks()
        named = items.flatten()
        self.names, number = np.unique(np.array(named.to_pylist(), object), return_inverse=True)
        self.items, self.item_at = number.astype(np.int64), np.asarray(items.offsets, np.int64) - items.offsets[0].as_py()
        self.lookups = {int(s): Lookup(self.key[np.minimum(self.size, SHINGLE) == s]) for s in np.unique(np.minimum(self.size, SHINGLE))}

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in ``words``."""
        before = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], np.diff(words.first))
        room, found = words.room(), []
        for size, lookup in self.lookups.items():
            hashes = words.shingles(size)
            at = lookup.places(hashes)
            low, high = np.searchsorted(self.key, hashes[at], "left"), np.searchsorted(self.key, hashes[at], "right")
            each = high - low
            at = np.repeat(at, each)
            which = np.repeat(low, each) + np.arange(len(at)) - np.repeat(np.cumsum(each) - each, each)
            fits = (self.place[which] <= before[at]) & (self.size[which] - self.place[which] <= room[at]) & (np.minimum(self.size[which], SHINGLE) == size)
            begin, which = at[fits] - self.place[which[fits]], which[fits]
            for k in range(self.hashes.shape[1]):
                word = np.minimum(begin + k, len(words.hashes) - 1)
                same = (k >= self.size[which]) | ((words.hashes[word] == self.hashes[which, k]) & (words.length[word] == self.length[which, k]))
                begin, which = begin[same], which[same]
            a, b = words.at[begin].tolist(), self.begin[which].tolist()
            n = (self.begin[which + 1] - self.begin[which]).tolist()
            equal = np.fromiter((words.data[x : x + m] == self.data[y : y + m] for x, y, m in zip(a, b, n, strict=True)), bool, len(n))
            found.append((begin[equal], which[equal]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _matched(docs: DataFrame, windows: Windows) -> DataFrame:
    """``docs`` with hits and items in place of the text."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    context = docs.sparkSession.sparkContext
    held = context.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for piece in kernels.pieces(batches, "text"):
            words = Words.of(piece.column("text"))
            begin, which = own.occurrences(words)
            # runs of hit words; a run ends with its text
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + own.size[which], -1)
            hit = np.cumsum(edge[:-1]) > 0
            cut_ = np.zeros(len(hit) + 1, bool)
            cut_[words.first] = True
            starts = np.flatnonzero(hit & (cut_[:-1] | ~np.concatenate([[False], hit[:-1]])))
            ends = np.flatnonzero(hit & (cut_[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
            text = np.searchsorted(words.first, starts, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(starts - words.first[text]), pa.array(ends - words.first[text])], names=["first", "end"])
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, words.first).astype(np.int32)), spans)
            # the items of a text: those of its distinct windows
            pair = np.unique((np.searchsorted(words.first, begin, "right") - 1) * max(1, len(own.size)) + which)
            of, window = pair // max(1, len(own.size)), pair % max(1, len(own.size))
            each = own.item_at[window + 1] - own.item_at[window]
            place = np.repeat(own.item_at[window], each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            pair = np.unique(np.repeat(of, each) * max(1, len(own.names)) + own.items[place])
            bounds = np.searchsorted(pair // max(1, len(own.names)), np.arange(piece.num_rows + 1))
            items = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own.names[pair % max(1, len(own.names))].tolist(), pa.string()))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(np.diff(words.first)), listed, items], names=[*names, "n_words", "hits", "items"])

    return docs.mapInArrow(run, f"{schema}, n_words long, hits {RUNS}, items array<string>")


RUNS = "array<struct<first:bigint,end:bigint>>"
#: SQL that joins overlapping and touching runs of words
MERGED = f"""aggregate(array_sort(hits), CAST(array() AS {RUNS}), (a, x) ->
  IF(size(a) > 0 AND x.first <= element_at(a, -1).end,
     concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'end', greatest(element_at(a, -1).end, x.end)))),
     array_append(a, x)))"""


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``docs`` without the text, plus n_words, hits (runs of hit words: first, end), n_hit, items (ids of the items found, sorted as strings), n_items."""
    docs = without(docs, *RESULTS)
    windows, slices = windows_of(benchmark, window, most_windows)
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2"))
    parts = []
    for number in range(slices):
        own = windows.where(F.col("slice") == number).drop("slice")
        listed = own.select("window", "size", F.posexplode("shingles").alias("place", "shingle"))
        counts = _counts(docs, listed.select("shingle", F.least("size", F.lit(SHINGLE)).alias("length")).distinct())
        rarest = listed.join(counts, "shingle", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("rare"))
        prefixed = own.join(rarest, "window").select("window", "size", "items", F.col("rare.place").alias("place"), F.col("rare.shingle").alias("key"))
        held = Windows(prefixed.toArrow(), window)  # at most ``most_windows`` rows
        if slices == 1:
            out = _matched(docs, held)
        else:
            hit = _matched(keyed.select("_t1", "_t2", "text"), held).where(F.size("hits") > 0)
            parts.append(cut(hit.groupBy("_t1", "_t2").agg(F.first("hits").alias("hits"), F.first("items").alias("items"))))
    if slices > 1:
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.union(more)
        merged = whole.groupBy("_t1", "_t2").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        plain = _matched(keyed, Windows(windows.limit(0).selectExpr("window", "size", "items", "0 AS place", "0L AS key").toArrow(), window)).drop("hits", "items")
        out = plain.join(merged, ["_t1", "_t2"], "left").drop("_t1", "_t2")
        out = out.withColumns({"hits": F.coalesce(F.expr(MERGED), F.expr(f"CAST(array() AS {RUNS})")), "items": F.coalesce("items", F.expr("CAST(array() AS array<string>)"))})
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return out.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
