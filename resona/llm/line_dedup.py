"""Line dedup: the first document that holds a line keeps it; the others lose it.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lower-cased. Only the 128-bit hash of a key travels, with the document and the
line's position; text never leaves its row.

* The hashed lines are range-partitioned by (hash, part) and sorted by document and
  position inside each hash and part. ``part`` is one of ``parts`` hashes of the
  document, so a line found in a third of all documents spans many partitions, while
  the parts of an ordinary line lie next to each other.
* A window over each sorted stretch carries its first document along: later
  documents drop the line, and only the first one's rows go on.
* The firsts of a hash's parts, at most ``parts`` documents, meet once more in the
  same way, and all but the first of them drop the line too.
* The dropped positions become a keep bitmap per document, stored as run lengths.

Defined results: a null or empty text is one empty line; keys under ``min_chars``
code points always stay; a null doc_id is no document that could hold a line
first and keeps all its lines; rows with equal doc_id are one document, and rows
repeated with equal text get equal results; an empty table gives no rows. Columns
besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from resona.llm.tables import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGES = " \t\n\x0b\x0c\r"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line):
    return F.translate(F.btrim(line, F.lit(EDGES)), UPPER, LOWER)


def _first_holders(sorted_by: list[str], lines: DataFrame) -> DataFrame:
    """``lines`` with ``held_by``: the first document of the row's group in the order of document and position."""
    stream = Window.partitionBy(*sorted_by).orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("held_by", F.first("doc_id").over(stream))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, parts: int = 4096) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, dropped_runs: a bitmap for each document that loses lines.

    ``dropped_runs`` is the bitmap in compressed form: an array of structs
    (first, length), ascending, one for every maximal run of dropped lines.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    lines = cut(
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", text_hash, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", _key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    spread = lines.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    # the range partitioning serves the window as it is: no second exchange
    streamed = cut(_first_holders(["h1", "h2", "part"], spread.repartitionByRange("h1", "h2", "part")))
    later = F.col("doc_id") > F.col("held_by")
    firsts = _first_holders(["h1", "h2"], streamed.where(~later).drop("held_by", "part"))
    position = ["doc_id", "text_hash", "pos"]
    dropped = (
        streamed.where(later).select(position).union(firsts.where(later).select(position))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    )
    starts = F.expr("filter(dropped, (p, i) -> i = 0 OR dropped[i - 1] < p - 1)")
    ends = F.expr("filter(dropped, (p, i) -> i = size(dropped) - 1 OR dropped[i + 1] > p + 1)")
    return dropped.select(
        "doc_id",
        "text_hash",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.transform(F.arrays_zip(starts.alias("first"), ends.alias("last")), lambda r: F.struct(r["first"].alias("first"), (r["last"] - r["first"] + 1).alias("length"))).alias("dropped_runs"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with text cut to its kept lines, plus n_lines and n_dropped. Every column of ``docs`` stays."""
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    with_runs = own.join(
        bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("n_dropped").alias("_n"), F.col("dropped_runs").alias("_runs")),
        ["_id", "_hash"],
        "left",
    ).withColumn("_lines", _lines(F.col("row.text")))
    # the kept runs lie between the dropped ones: from the end of run i - 1 to the start of run i
    kept = F.expr(
        """CASE WHEN _runs IS NULL THEN _lines ELSE flatten(transform(sequence(0, size(_runs)), i ->
             slice(_lines,
                   IF(i = 0, 0, _runs[i - 1].first + _runs[i - 1].length) + 1,
                   IF(i = size(_runs), size(_lines), _runs[i].first) - IF(i = 0, 0, _runs[i - 1].first + _runs[i - 1].length)))) END"""
    )
    columns = [F.array_join("_kept", "\n").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return with_runs.withColumn("_kept", kept).select(
        *columns,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
