"""A table merged by key: copy-on-write buckets under a manifest.

``path/data/<version>/bucket=<n>`` holds the rows of one bucket of keys, and ``path/manifests/version=<n>`` which
folder each bucket has at that version. A merge rewrites the buckets that its rows touch and then
writes the next manifest, in one file; until that file is there, readers see the version before. Untouched
buckets keep their files. One writer at a time, as under a streaming query.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "bucket int, folder string, buckets int"


def _manifest(spark: SparkSession, path: str) -> tuple[int, list]:
    """The newest complete version and its (bucket, folder, buckets) rows; (0, []) before the first."""
    try:
        rows = spark.read.schema(f"{MANIFEST}, version long").parquet(f"{path}/manifests")
        newest = rows.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    return (0, []) if newest is None else (newest, rows.where(F.col("version") == newest).orderBy("bucket").collect())


def keyed_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows at its newest version; None before the first."""
    _, rows = _manifest(spark, path)
    return spark.read.parquet(*[r["folder"] for r in rows]) if rows else None


def merge_by_key(rows: DataFrame, path: str, key: str, order: list[str], buckets: int = 64) -> int:
    """Merge ``rows`` into the table at ``path``: of each key the newest row by ``order`` stays. Returns the version; no rows, no new version.

    ``buckets`` counts for the first merge and stays. Rows without a key are left out. Of equal ``order``, the row
    with the larger values stays, so that a replay gives the same table.
    """
    spark = rows.sparkSession
    version, known = _manifest(spark, path)
    buckets = known[0]["buckets"] if known else buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    fresh = rows.where(F.col(key).isNotNull())
    touched = {r[0] for r in fresh.select(bucket.alias("b")).distinct().collect()}
    if not touched:
        return version
    folders = {r["bucket"]: r["folder"] for r in known}
    before = [folders[b] for b in sorted(touched & folders.keys())]
    if before:
        fresh = fresh.unionByName(spark.read.parquet(*before), allowMissingColumns=True)
    others = [c for c in fresh.columns if c != key]
    newest = fresh.groupBy(key).agg(F.max(F.struct(*order, F.struct(*[c for c in others if c not in order]).alias("_rest"))).alias("_row"))
    columns = [F.col(key) if c == key else F.col("_row")[c].alias(c) if c in order else F.col("_row._rest")[c].alias(c) for c in fresh.columns]
    folder = f"{path}/data/{version + 1}"
    newest.select(*columns, bucket.alias("_bucket")).repartition(min(buckets, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
    folders |= {b: f"{folder}/_bucket={b}" for b in touched}
    listed = spark.createDataFrame([(b, f, buckets) for b, f in sorted(folders.items())], MANIFEST)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/version={version + 1}")
    return version + 1
