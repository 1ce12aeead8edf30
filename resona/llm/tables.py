"""Reading the corpus tables and cutting lineage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns that bear one of ``names`` in any case, as Spark resolves them."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the reread rows.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, local mode uses a temporary one; a cluster, whose executors could not
    read such a folder, gets an error. The plan
    behind ``df`` is let go at once, so that Spark's cleaner can remove its shuffle
    files while the job goes on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    context._jvm.System.gc()
    return out
