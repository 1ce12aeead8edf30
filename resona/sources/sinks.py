"""Writers: CSV, JSON and text reports, exports, several datasets at once, models."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_report(row: DataFrame, path: str) -> None:
    """Each row as one JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def text_report(lines: DataFrame, path: str) -> None:
    """lines (section, ord, line), written in order; a report is small."""
    lines.orderBy("section", "ord").select("line").coalesce(1).write.mode("overwrite").text(path)


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as <column>_<field>."""
    names = []
    for f in df.schema.fields:
        inner = getattr(f.dataType, "fields", None)
        names += [F.col(f"`{f.name}`.`{i.name}`").alias(f"{f.name}_{i.name}") for i in inner] if inner else [F.col(f"`{f.name}`")]
    return df.select(*names)


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = flatten(df).write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def datasets(frames: Mapping[str, DataFrame], folder: str) -> dict[str, int]:
    """Every dataset under its name; the row counts come from the writes themselves."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in frames.items():
        seen = Observation(name)
        df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
