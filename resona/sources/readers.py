"""Readers: CSV with schemas, encodings, labels and globs; media manifests; materialised results."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("UTF-8", "ISO-8859-1")


def csv(spark: SparkSession, path: str | list[str], schema: str | None = None, encoding: str = "UTF-8", **options) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", encoding).options(**options)
    return (reader.schema(schema) if schema else reader).csv(path)


def encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding) of every file that holds a line: UTF-8 where all its lines are valid UTF-8, else Latin-1.

    The lines' bytes are tested as the text source splits them, so a file of any size is read in parts by many tasks and no
    row holds more than a line; no part of a UTF-8 character is a line's end. Nothing but the verdicts is gathered.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    valid = lines.groupBy("path").agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    return valid.select("path", F.when(F.col("valid"), ENCODINGS[0]).otherwise(ENCODINGS[1]).alias("encoding"))


def csv_any_encoding(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files under ``path``, one read per encoding found."""
    found = encodings(spark, path)
    parts = [
        csv(spark, [r["path"] for r in found.where(F.col("encoding") == e).select("path").collect()], schema, e)
        for e in ENCODINGS
        if not found.where(F.col("encoding") == e).isEmpty()
    ]
    return reduce(DataFrame.unionByName, parts) if parts else csv(spark, path, schema)


def labelled(spark: SparkSession, paths: Mapping[str, str], label: str, schema: str | None = None) -> DataFrame:
    """Several CSV sources in one table; ``label`` tells them apart."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [csv(spark, p, schema).withColumn(label, F.lit(v)) for v, p in paths.items()])


def glob(spark: SparkSession, folder: str, pattern: str, schema: str | None = None) -> DataFrame:
    """Files of the folder that match the pattern, with their name as normalization_source."""
    frame = csv(spark, folder, schema, pathGlobFilter=pattern)
    return frame.withColumn("normalization_source", F.col("_metadata.file_name"))


def materialized(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``; where it can't be read, ``build()`` is written there first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        build().write.parquet(path)
        return spark.read.parquet(path)


def signature(df: DataFrame) -> str:
    """What ``df`` would be made of: a hash of its plan, its schema, and its input files' names, sizes and times."""
    files = df.inputFiles()
    listed = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", F.unix_micros("modificationTime").alias("at")) if files else None
    # sums of hashes don't depend on an order; nothing but three figures comes back
    row = F.xxhash64("path", "length", "at")
    state = listed.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), row))).first() if files else ()
    return hashlib.sha256(repr((df.semanticHash(), df.schema.json(), tuple(map(str, state)))).encode()).hexdigest()[:32]


def reused(df: DataFrame, path: str) -> DataFrame:
    """``df`` as saved under ``path`` while its inputs and its plan stay as they were; else it is computed and saved there first.

    Each signature has a folder of its own, which counts once its mark is written, so a crash leaves no half result.
    Earlier results stay until they are deleted.
    """
    from pyspark.errors import AnalysisException

    spark, key = df.sparkSession, signature(df)
    try:
        spark.read.text(f"{path}/marks/{key}").count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df.write.mode("overwrite").parquet(f"{path}/results/{key}")
        spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/marks/{key}")
    return spark.read.parquet(f"{path}/results/{key}")


MEDIA = ("mp3", "wav", "flac", "m4a", "ogg")


def media_manifest(files: DataFrame, kinds: Sequence[str] = MEDIA, most_bytes: int = 50 << 20, seconds: tuple[float, float] = (5, 600)) -> DataFrame:
    """files (path, length[, duration]) with extension and the array of what is wrong with each."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    duration = F.col("duration") if "duration" in files.columns else F.lit(None).cast("double")
    problems = F.array_compact(
        F.array(
            F.when(~extension.isin(*kinds), "extension"), F.when(F.col("length") > most_bytes, "size"),
            F.when(duration < seconds[0], "too short"), F.when(duration > seconds[1], "too long")))
    return files.drop("content").withColumns({"extension": extension, "problems": problems}).withColumn("valid", F.size("problems") == 0)
