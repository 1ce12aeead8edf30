"""Filter interaction audit over a sparse document-term matrix.

Five filters judge every document: A (too few words), B (too few distinct words), C (too
many capitals), D (holds a symbol) and E (its text is that of a document with a smaller
doc_id). The audit tells for every order of the filters what each step removes, and
what it removes alone or in vain.

1. ``matrix``: documents are cut into shards of about ``shard_bytes`` text. A shard encodes its words
   with a dictionary of its own and keeps the matrix in CSR form (row bounds, columns,
   counts), in the shared checkpoint folder.
2. The shards' dictionaries are unified: each sends its words once to one of ``buckets``
   word buckets, a bucket numbers its distinct words in their order, and the numbers return to the
   shard, whose columns become those of the global dictionary. A word travels once per shard, so
   the commonest word of a corpus costs a bucket as many rows as there are shards.
3. Row sums and nonzero counts of the encoded shards decide A and B; C and D were counted with the bytes of the text.
4. E compares 128-bit hashes of texts table-wide: only texts found more than once are joined back.
5. The 32 sets of failed filters are counted per part and label; all 120 orders follow from these counts.

Defined results: a null text is an empty one (and equal to it); a null or empty lang is the part
with the empty name; rows without doc_id fail E never and have no labels; rows with equal doc_id and
text are no copies of each other; several labels of one doc_id count as 1 where any is; an empty table
gives no rows. Columns besides doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm import kernels
from resona.llm.tables import cut

FILTERS = "ABCDE"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*|"]] = True
#: bytes of words that one bucket of the dictionary takes
BUCKET_BYTES = 1 << 24
CODEC = "zstd"


def _pack(x: np.ndarray) -> bytes:
    """The bytes of ``x`` in its narrowest width, compressed, behind width and length."""
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not x.size or x.max() <= np.iinfo(t).max)
    raw = x.astype(width).tobytes()
    return np.array([width().itemsize, len(raw)], np.int64).tobytes() + pa.compress(raw, CODEC, asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    width, size = np.frombuffer(raw, np.int64, 2)
    return np.frombuffer(pa.decompress(raw[16:], int(size), CODEC), f"u{width}").astype(np.int64)


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about ``size`` bytes of text, one row at least."""
    held, total = [], 0
    for piece in kernels.pieces(batches, "text", size):
        held.append(piece)
        total += piece.column("text").nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _inside(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of each text's bytes ``flags`` marks."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All words back to back, and the first word of each text (one entry more than texts)."""
    starts, ends, first = kernels.spans(raw, offsets)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    black = np.ascontiguousarray(raw[~kernels.WHITE_BYTES[raw]])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(black)), first


def shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """docs (row, text) as CSR shards: shard, rows (row and the counts of its characters), bounds, columns, counts, and the shard's words in column order."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, piece in enumerate(_joined(batches, shard_bytes)):
            raw, offsets = kernels.text_bytes(piece.column("text"))
            words, first = _words(raw, offsets)
            coded = words.dictionary_encode()
            many = max(1, len(coded.dictionary))
            cells, counts = np.unique(np.repeat(np.arange(len(first) - 1) * many, np.diff(first)) + np.asarray(coded.indices, np.int64), return_counts=True)
            bounds = np.searchsorted(cells, np.arange(len(first)) * many)
            own = pa.StructArray.from_arrays(
                [piece.column("row"), *(pa.array(_inside(f, offsets)) for f in ((raw & 0xC0) != 0x80, (raw >= 65) & (raw <= 90), SYMBOLS[raw]))],
                names=["row", "n_chars", "n_capitals", "n_symbols"],
            )
            listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + number]),
                    pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                    *(pa.array([_pack(x)], pa.binary()) for x in (bounds, cells % many, counts)),
                    pc.binary_join(listed, " "),  # words hold no blank
                    pa.array([int(coded.dictionary.nbytes)]),
                ],
                names=["shard", "rows", "bounds", "columns", "counts", "words", "size"],
            )

    rows = f"array<struct<row:{kind},n_chars:bigint,n_capitals:bigint,n_symbols:bigint>>"
    return cut(docs.mapInArrow(run, f"shard long, rows {rows}, bounds binary, columns binary, counts binary, words string, size long"))


def _dealt(parts: DataFrame, buckets: int) -> DataFrame:
    """The words of every shard by bucket: bucket, shard, words, places (their columns in the shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("words"), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                if not len(raw):
                    continue
                starts, ends, _ = kernels.spans(raw, np.array([0, len(raw)]))
                bucket = kernels.span_hashes(raw, starts, ends, kernels.EXACT) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).astype(np.int32)
                full = np.flatnonzero(np.diff(bounds))
                words, _ = _words(raw, np.array([0, len(raw)]))
                edges = pa.array(np.append(bounds[full], bounds[-1]))
                texts = pc.binary_join(pa.ListArray.from_arrays(edges, words.take(pa.array(order)).cast(pa.string())), " ")
                places = [_pack(order[bounds[b] : bounds[b + 1]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), shard)), texts, pa.array(places, pa.binary())], names=["bucket", "shard", "words", "places"])

    return parts.select("shard", "words").mapInArrow(run, "bucket long, shard long, words string, places binary")


def _numbered(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A bucket's distinct words in order, the number of each listed word, and the bounds of the rows' words."""
    listed = pc.split_pattern(table.column("words").combine_chunks(), " ")
    coded = listed.flatten().dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary), np.int64)  # the same numbers in whatever order rows arrive
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[np.asarray(coded.indices, np.int64)], np.asarray(listed.offsets, np.int64) - listed.offsets[0].as_py()


def _csr(shard: pa.Table, ids: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """rows, bounds, global columns and counts of a shard."""
    bounds, columns, counts = (unpack(shard.column(c)[0].as_py()) for c in ("bounds", "columns", "counts"))
    lookup = np.zeros(columns.max(initial=-1) + 1, np.int64)
    for places, numbers in zip(ids.column("places"), ids.column("ids"), strict=True):
        lookup[unpack(places.as_py())] = unpack(numbers.as_py())
    return shard.column("rows").combine_chunks()[0].values, bounds, lookup[columns], counts


def matrix(docs: DataFrame, shard_bytes: int = 1 << 24, bucket_bytes: int = BUCKET_BYTES, finish: Callable | None = None, schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of docs (row, text) and its dictionary.

    The matrix comes in CSR shards (shard, rows, bounds, columns, counts; lists of longs), or as what ``finish``
    (rows, bounds, columns, counts) makes of a shard, of ``schema``. The dictionary has (id, word).
    """
    parts = shards(docs, shard_bytes)
    buckets = max(1, -(-(parts.agg(F.sum("size")).first()[0] or 0) // bucket_bytes))
    dealt = _dealt(parts, buckets)

    def number(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        _, ids, bounds = _numbered(table)
        packed = [_pack(ids[a:b] * buckets + bucket) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"shard": table.column("shard"), "places": table.column("places"), "ids": pa.array(packed, pa.binary())})

    def entries(table: pa.Table) -> pa.Table:
        words, _, _ = _numbered(table)
        return pa.table({"id": np.arange(len(words)) * buckets + table.column("bucket")[0].as_py(), "word": words})

    def whole(rows: pa.Array, bounds: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> pa.Table:
        return pa.table({"rows": pa.array([rows.to_pylist()], pa.list_(rows.type)), **{k: pa.array([x]) for k, x in (("bounds", bounds), ("columns", columns), ("counts", counts))}})

    def encode(shard: pa.Table, ids: pa.Table) -> pa.Table:
        return (finish or whole)(*_csr(shard, ids))

    numbered = dealt.groupBy("bucket").applyInArrow(number, "shard long, places binary, ids binary")
    schema = schema or f"rows {parts.schema['rows'].dataType.simpleString()}, bounds array<long>, columns array<long>, counts array<long>"
    encoded = parts.select("shard", "rows", "bounds", "columns", "counts").groupBy("shard").cogroup(numbered.groupBy("shard")).applyInArrow(encode, schema)
    return encoded, dealt.groupBy("bucket").applyInArrow(entries, "id long, word string")


def failures(docs: DataFrame, min_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3, **sizes: int) -> DataFrame:
    """Per document: doc_id, lang, n_words, n_distinct, and ``fails``, the sum of 1, 2, 4, 8 and 16 for A to E."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct("doc_id", "lang", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    source = docs.select(row.alias("row"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(rows: pa.Array, bounds: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(counts)])
        words, distinct = total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)
        chars, capitals, symbols = (np.asarray(rows.field(c)) for c in ("n_chars", "n_capitals", "n_symbols"))
        fails = (words < min_words) + 2 * (100 * distinct < distinct_percent * words) + 4 * (100 * capitals > capital_percent * chars) + 8 * (symbols > 0)
        own = rows.field("row")
        return pa.table({**{c: own.field(c) for c in ("doc_id", "lang", "t1", "t2")}, "n_words": words, "n_distinct": distinct, "fails": fails.astype(np.int32)})

    judged, _ = matrix(source, **sizes, finish=judge, schema=f"doc_id {kind}, lang string, t1 long, t2 long, n_words long, n_distinct long, fails int")
    judged = cut(judged)
    again = judged.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * 16
    return judged.join(again, ["t1", "t2"], "left").select("doc_id", "lang", "n_words", "n_distinct", (F.col("fails") + copy).alias("fails"))


def _steps() -> str:
    """SQL for all steps of all orders: an array of structs (filter_order, step, bit, before)."""
    steps = []
    for order in map("".join, permutations(FILTERS)):
        for step, letter in enumerate(order):
            before = sum(1 << FILTERS.index(x) for x in order[:step])
            steps.append(f"named_struct('filter_order', '{order}', 'step', {step + 1}, 'bit', {1 << FILTERS.index(letter)}, 'before', {before})")
    return f"array({', '.join(steps)})"


def audit(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    judged = failures(docs, **options)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")])
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counted = judged.join(known, "doc_id", "left").groupBy(F.coalesce("lang", F.lit("")).alias("part"), "fails").agg(F.count("*").alias("n"), one("quality"), one("toxic"))
    # at most 32 sets of failed filters a part
    sets = counted.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "quality", "toxic")).alias("sets"))
    stepped = sets.select("part", "sets", F.explode(F.expr(_steps())).alias("s")).select("part", "sets", "s.*")
    total = lambda what, when: F.expr(f"aggregate(filter(sets, x -> {when}), 0L, (a, x) -> a + {what})")
    here, earlier = "(x.fails & bit) <> 0", "(x.fails & before) <> 0"
    return stepped.select(
        "part",
        "filter_order",
        "step",
        total("x.n", "(x.fails & (before | bit)) = 0").alias("kept"),
        total("x.n", f"{here} AND NOT {earlier}").alias("removed"),
        total("x.n", f"{here} AND {earlier}").alias("redundant"),
        total("x.n", "x.fails = bit").alias("unique_fails"),
        total("x.quality", f"{here} AND NOT {earlier}").alias("good_lost"),
        total("x.toxic", f"{here} AND NOT {earlier}").alias("toxic_lost"),
        # in 120 / f of the orders this filter is the first of the f that a document fails
        total("x.n * (120 DIV bit_count(x.fails))", here).alias("shapley"),
    )
