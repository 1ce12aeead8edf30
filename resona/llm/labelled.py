"""The labelled rows a classifier may learn from, and the split that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resona.llm.tables import cut


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 3 is 1; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of at most ``per_class`` labelled rows of each class outside the held-out split, and the classes' sizes.

    The rows are those with the smallest hash of their doc_id, so reruns agree. At
    most ``2 * per_class`` ids are broadcast. A doc_id labelled more than once counts
    once, by its largest label.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))
    sample = cut(docs.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"]))
    return sample, sizes
