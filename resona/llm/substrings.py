"""Removal of repeated 200-byte strings across the whole corpus, byte for byte.

Every byte covered by a ``length``-byte string that also starts anywhere else is
removed. The suffixes that matter are found in three exact steps:

1. Sieve. Each window of ``length`` bytes has one anchor, its smallest k-gram by hash
   (the rightmost of equals), which its own bytes determine. Neighbouring windows
   with the same anchor form a run. Equal windows have equal anchors at equal
   offsets, so a window whose anchor k-gram occurs nowhere else is unique. About 1.3
   runs per 100 bytes travel, as hashes.
2. Whole runs. Runs with equal content at two places are repeated in full, which a
   partial aggregation settles, however often the passage occurs.
3. Edges. What remains are runs around the ends of repeated passages: their k-gram
   occurs elsewhere, their content does not. Their bytes and one copy of each
   different run of the same k-gram are compared window by window inside tasks;
   a k-gram with more than ``hot`` different runs is compared as single windows instead,
   by a partial aggregation, so no task holds an unbounded group.

Texts that are equal count as one text with copies, which are repeated in full.
``gsaca.repeated_starts`` finds the same windows by a linear suffix array; the README
says why that does not run over whole tables.

Windows are compared by 64-bit hashes of all their bytes. Texts are numbered by 64 bits of their
SHA-256, and those few that share a number get another, so none is mistaken for another. Defined results: a null or
empty text has no bytes; texts shorter than ``length`` keep all; matches never cross
texts; a null doc_id takes part like any other; rows repeated with equal text are copies of each other, whatever their doc_id; an
empty table gives no rows. Columns besides doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm import kernels
from resona.llm.tables import cut

INVERSE = np.uint64(pow(int(kernels.BASE), -1, 1 << 64))
PLACE = 28  # low bits of a key that hold the place inside a piece
SEGMENT = 1 << 21
_inverse = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        _inverse = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, INVERSE, np.uint64))])
    return _inverse[:n]


class Rolling:
    """Hashes of any stretches of a byte array."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(kernels.EXACT[raw] * kernels.powers(len(raw)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return kernels.mix64((self.sums[ends] - self.sums[starts]) * _inverses(len(self.sums))[starts])

    def windows(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return kernels.mix64((self.sums[length:] - self.sums[:n]) * _inverses(len(self.sums))[:n])


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def runs(raw: np.ndarray, owner_ends: np.ndarray, length: int, gram: int):
    """(first window, last window, anchor, anchor's hash, hash of all bytes of the run) of every run inside one text."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(raw)
    grams = rolling.windows(gram)
    mask = np.uint64((1 << PLACE) - 1)
    keys = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    least = _smallest(keys, length - gram + 1)
    starts = np.arange(n)
    inside = starts + length <= owner_ends[np.searchsorted(owner_ends, starts, "right")]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    good = inside[first]
    first, last = first[good], last[good]
    anchor = (mask - (least[first] & mask)).astype(np.int64)
    return first, last, anchor, grams[anchor], rolling.of(first, last + length)


def _segments(batches: Iterator[pa.RecordBatch], length: int):
    """Pieces of bytes with each text's end; a giant text comes in overlapping segments: (raw, ends, row of the piece, offset in the text)."""
    for piece in kernels.pieces(batches, "text", SEGMENT):
        raw, offsets = kernels.text_bytes(piece.column("text"))
        if piece.num_rows == 1 and len(raw) > 2 * SEGMENT:
            for at in range(0, len(raw) - length + 1, SEGMENT):
                part = raw[at : at + SEGMENT + length - 1]
                yield piece, part, np.array([len(part)]), at
        else:
            yield piece, raw, offsets[1:], 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _all_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """texts (text_key, text) as runs: gram, run (content hash), text_key, span (first window * 256 + windows - 1), lead (anchor - first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, raw, ends, at in _segments(batches, length):
            first, last, anchor, grams, content = runs(raw, ends, length, gram)
            if not len(first):
                continue
            row = np.searchsorted(ends, first, "right")
            begin = np.concatenate([[0], ends])[row]
            content = kernels.mix64(content ^ kernels.mix64(((anchor - first) * 1000 + last - first).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [_signed(grams), _signed(content), piece.column("text_key").take(pa.array(row)), pa.array(((first - begin + at) << 8) | (last - first))],
                names=["gram", "run", "text_key", "span"],
            )

    return texts.mapInArrow(run, "gram long, run long, text_key long, span long")


def _window_hashes(first: np.ndarray, count: np.ndarray, data: list[bytes], length: int):
    """Hash of every window of every stretch, and the stretch it is in."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    begin = np.cumsum([0, *map(len, data)])[:-1]
    owner = np.repeat(np.arange(len(data)), count)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return Rolling(raw).windows(length)[at], owner


def _spans(owner: np.ndarray, start: np.ndarray, length: int):
    """Unions of windows [start, start + length) that touch, for ascending starts per owner: owner, start, end."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], start[first], start[last] + length


def _text_key(sha256: Column, salt: int) -> Column:
    return F.xxhash64(sha256) if salt == 0 else F.xxhash64(sha256, F.lit(salt))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 40, hot: int = 20_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, texts): doc_id with its text_key, n_bytes, copies and text_sha256; the stretches to remove per text_key, unmerged; the texts that have any."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_sha256"))
    keyed = keyed.withColumn("text_key", _text_key(F.col("text_sha256"), 0))
    documents = cut(keyed.select("doc_id", "text_key", "text_sha256", F.octet_length("text").cast("long").alias("n_bytes")))
    copies = cut(documents.groupBy("text_key", "text_sha256").agg(F.count("*").alias("copies")))
    shared = copies.groupBy("text_key").agg(F.count("*").alias("n"), F.min("text_sha256").alias("first_sha256")).where("n > 1").drop("n")
    clash = copies.join(shared, "text_key").where("text_sha256 <> first_sha256").select("text_sha256", F.lit(True).alias("again"))
    if not clash.isEmpty():
        renumbered = F.when(F.col("again"), _text_key(F.col("text_sha256"), 1)).otherwise(F.col("text_key"))
        again = lambda df: df.join(clash, "text_sha256", "left").withColumn("text_key", renumbered).drop("again")
        keyed, documents, copies = again(keyed), cut(again(documents)), again(copies)
    found = _all_runs(keyed.where(F.octet_length("text") >= length).select("text_key", "text"), length, gram)
    place = F.xxhash64("text_key", "span")
    grams = cut(found.select("gram", place.alias("at")).groupBy("gram").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("gram"))
    live = cut(found.join(grams, "gram"))
    kinds = cut(
        live.withColumn("at", place)
        .groupBy("gram", "run")
        .agg(F.min("at").alias("low"), F.max("at").alias("high"), F.min(F.struct("text_key", "span")).alias("sample"))
        .select("gram", "run", (F.col("low") != F.col("high")).alias("whole"), "sample.text_key", "sample.span")
    )
    first, count = F.shiftright("span", 8), F.col("span").bitwiseAND(F.lit(255)) + 1
    whole = live.join(kinds.where("whole").select("gram", "run"), ["gram", "run"]).select("text_key", first.alias("start"), (first + count - 1 + length).alias("end"))
    groups = kinds.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    edges = kinds.join(groups, "gram").select("gram", "n", "text_key", first.alias("first"), count.alias("count"), "whole")
    one_each = documents.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))
    named = live.select("text_key").distinct().join(one_each, "text_key")
    texts = cut(
        keyed.select("doc_id", "text_key", "text").join(named.select(F.col("text_key").alias("asked"), F.col("doc_id").alias("asked_id")), F.col("doc_id").eqNullSafe(F.col("asked_id")))
        .where("text_key = asked")
        .dropDuplicates(["text_key"])
        .select("text_key", "text")
    )
    wanted = edges.groupBy("text_key").agg(F.collect_list(F.struct("gram", "n", "first", "count", "whole")).alias("wanted"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in kernels.pieces(batches, "text", SEGMENT):
            raw, offsets = kernels.text_bytes(piece.column("text"))
            lists = piece.column("wanted")
            row = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start = flat.field("first").to_numpy()
            size = flat.field("count").to_numpy() + length - 1
            data = raw.tobytes()
            stretch = [data[o : o + n] for o, n in zip(offsets[row] + start, size, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("text_key").take(pa.array(row)), *(flat.field(c) for c in ("gram", "n", "first", "count", "whole")), pa.array(stretch, pa.binary())],
                names=["text_key", "gram", "n", "first", "count", "whole", "data"],
            )

    stretches = cut(texts.join(wanted, "text_key").mapInArrow(bytes_of, "text_key long, gram long, n long, first long, count long, whole boolean, data binary"))
    tasks = max(1, stretches.count() // 4000)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        hashes, owner = _window_hashes(group["first"].to_numpy(), group["count"].to_numpy(), list(group["data"]), length)
        _, which, times = np.unique(hashes, return_inverse=True, return_counts=True)
        inside = np.arange(len(owner)) - (np.cumsum(group["count"].to_numpy()) - group["count"].to_numpy())[owner]
        hit = (times[which] > 1) & ~group["whole"].to_numpy()[owner]
        owner, start = owner[hit], group["first"].to_numpy()[owner[hit]] + inside[hit]
        owner, start, end = _spans(owner, start, length)
        return pd.DataFrame({"text_key": group["text_key"].to_numpy()[owner], "start": start, "end": end})

    few = (
        stretches.where(F.col("n") <= hot)
        .withColumn("task", F.pmod("gram", F.lit(tasks)))
        .groupBy("task")
        .applyInPandas(compare, "text_key long, start long, end long")
    )
    parts = [whole, few]
    if not stretches.where(F.col("n") > hot).isEmpty():

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000).to_pandas()
                    count = part["count"].to_numpy()
                    hashes, owner = _window_hashes(part["first"].to_numpy(), count, list(part["data"]), length)
                    inside = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
                    yield pa.RecordBatch.from_arrays(
                        [_signed(hashes), pa.array(part["text_key"].to_numpy()[owner]), pa.array(part["first"].to_numpy()[owner] + inside), pa.array(part["whole"].to_numpy()[owner])],
                        names=["window", "text_key", "start", "whole"],
                    )

        windows = stretches.where(F.col("n") > hot).mapInArrow(single, "window long, text_key long, start long, whole boolean")
        spot = F.xxhash64("text_key", "start")
        again = cut(windows.withColumn("at", spot).groupBy("window").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("window"))
        parts.append(windows.where("NOT whole").join(again, "window").select("text_key", "start", (F.col("start") + length).alias("end")))
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.union(part)
    return documents.join(copies.select("text_sha256", "copies"), "text_sha256"), spans, texts


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 40, hot: int = 20_000) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and ``removed``, the runs as structs (start, end) of bytes.

    ``kept_bytes`` applies the runs to a text.
    """
    documents, spans, texts = repeated_spans(docs, length, gram, hot)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, merged = [], []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = text.as_buffer().to_pybytes()
                kept, at, gone = [], 0, []
                for start, end in sorted((x["start"], x["end"]) for x in found.as_py()):
                    if start > at or not gone:
                        kept.append(raw[at:start])
                        gone.append({"start": start, "end": end})
                        at = end
                    elif end > at:
                        gone[-1]["end"] = at = end
                kept.append(raw[at:])
                merged.append(gone)
                digest.append(hashlib.sha256(b"".join(kept)).hexdigest())
            runs_ = pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(digest), runs_], names=["text_key", "digest", "removed"])

    gathered = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    stripped = texts.join(gathered, "text_key").mapInArrow(strip, "text_key long, digest string, removed array<struct<start:long,end:long>>")
    full = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    found = documents.join(stripped, "text_key", "left").withColumn("removed", F.when(full, whole).otherwise(F.coalesce("removed", none)))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.when(full, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "text_sha256")).alias("kept_sha256"),
        "removed",
    )


def kept_bytes(text: Column, removed: Column) -> Column:
    """The UTF-8 bytes of ``text`` outside the runs ``removed``; empty for null."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    part = lambda start, end: F.substring(raw, (start + 1).cast("int"), (end - start).cast("int"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))
    kept = F.aggregate(removed, begin, lambda a, r: F.struct(r["end"].alias("at"), F.concat(a["out"], part(a["at"], r["start"])).alias("out")))
    return F.concat(kept["out"], part(kept["at"], F.octet_length(raw).cast("long")))
