"""Standardising columns, filtering rows, joins, set operations and samples on whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and reread, so that what follows doesn't replay it.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is
    unset, local mode uses a temporary one and a cluster, whose executors could not read it, gets an error.
    Tables are kept as Parquet, packed and read by column; what it can't hold (no, equal or untyped columns) is kept as rows.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    kinds = df.schema.simpleString()
    if len({c.lower() for c in df.columns}) < max(1, len(df.columns)) or "void" in kinds or "interval" in kinds or "variant" in kinds:
        return df.checkpoint(eager=True)
    path = f"{context.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def standardize(df: DataFrame, aliases: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """One select: each target takes its first alias that is there (any case); absent targets become null strings."""
    there = {c.lower(): c for c in df.columns}
    pick = lambda names: next((F.col(f"`{there[n.lower()]}`") for n in names if n.lower() in there), F.lit(None).cast("string"))
    return df.select(*keep, *[pick(names).alias(target) for target, names in aliases.items()])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Mapped names, and lower case for the rest."""
    return df.toDF(*[names.get(c, c.lower()) for c in df.columns])


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """The first column of each name, without CSV index columns."""
    seen: set[str] = set()
    unique = [f"{c}#{k}" for k, c in enumerate(df.columns)]
    kept = [(u, c) for u, c in zip(unique, df.columns, strict=True) if not (c in seen or seen.add(c)) and not c.startswith("Unnamed:")]
    return df.toDF(*unique).select(*[F.col(f"`{u}`").alias(c) for u, c in kept])


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Adds the columns that are absent."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def select_present(df: DataFrame, wanted: Sequence[str], prefixes: Sequence[str] = ()) -> DataFrame:
    names = [c for c in wanted if c in df.columns] + [c for c in df.columns if any(c.startswith(p) for p in prefixes)]
    return df.select(*dict.fromkeys(names))


def with_provenance(df: DataFrame, source: str, priority: int, key: Sequence[str]) -> DataFrame:
    """source, priority and a row key that only the row's own content decides."""
    row_key = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key]), 256)
    return df.withColumns({"source_dataset": F.lit(source), "source_priority": F.lit(priority), "row_key": row_key})


def column_check(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(column, state): missing or extra."""
    rows = [(c, "missing") for c in expected if c not in df.columns] + [(c, "extra") for c in df.columns if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, state string")


def shape(frames: Mapping[str, DataFrame], features: Sequence[str]) -> DataFrame:
    """Rows, columns, and the features present and missing of each table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"),
            F.lit(",".join(f for f in features if f in df.columns)).alias("present"), F.lit(",".join(f for f in features if f not in df.columns)).alias("missing"))
        for name, df in frames.items()
    ]
    return reduce(DataFrame.union, parts)


def type_check(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(column, expected, actual, state) over the schema alone; ``expected`` holds numeric, string, boolean or timestamp."""
    kinds = {"double": "numeric", "float": "numeric", "int": "numeric", "bigint": "numeric", "smallint": "numeric", "tinyint": "numeric", "string": "string", "boolean": "boolean"}
    actual = {f.name: kinds.get(f.dataType.simpleString(), "timestamp" if "timestamp" in f.dataType.simpleString() or f.dataType.simpleString() == "date" else "other") for f in df.schema.fields}
    rows = [(c, e, actual.get(c, "absent"), "PASS" if actual.get(c) == e else "FAIL") for c, e in expected.items()]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string, state string")


def not_blank(column: str) -> Column:
    return F.trim(column) != ""


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of the critical columns is null; columns that are absent are no condition."""
    return df.na.drop("any", subset=[c for c in columns if c in df.columns])


def label_encode(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds ``to``: the place of the value among the column's distinct values, from 0; null for null."""
    ranged = settled(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    # ranges ascend by their number: a range's first place is the size of those before it
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    codes = ranged.join(F.broadcast(before), "_part").select(column, place.cast("int").alias(to))
    return df.join(codes, column, "left")


def one_hot(df: DataFrame, column: str, values: Sequence[str] | None = None, most: int = 1000) -> DataFrame:
    """Adds <column>_<value> as 0 or 1 for each value, by default those the column has; more than ``most`` are an error."""
    if values is None:
        values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} values")
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in values})


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in a stable order."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def first_row(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As ``first_per_key``, aggregated before the shuffle, so that a key may hold any share of the rows.

    Rows are compared by their order and then by the rest of their columns, and each column is carried once.
    """
    value = [c for c in df.columns if c not in key]
    inside = [c for c in dict.fromkeys(order) if c in value]
    inside += [c for c in value if c not in inside]
    if any("map<" in kind or "variant" in kind for _, kind in df.dtypes):  # what has no order can't be compared
        first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in inside]), F.struct(*order))
    else:
        first = F.min(F.struct(*[F.col(f"`{c}`") for c in inside]))
    found = df.groupBy(*key).agg(first.alias("_first")) if value else df.select(*key).distinct()
    return found.select(*[F.col(f"`{c}`") if c in key else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


#: rows of 64-bit numbers that are sent to every executor, where they take 134 MB
MOST_SENT = 2_000_000


def lone_and_shared(df: DataFrame, key: Sequence[str], most: int = MOST_SENT) -> tuple[DataFrame | None, DataFrame]:
    """Rows whose key no other row has, and all others.

    Keys are told apart by 64-bit hashes, which alone are shuffled; keys that share a hash are among the others. Hashes that
    repeat are broadcast, and where more than ``most`` do, no row is told to be alone (None). ``df`` is read once for each part and once for both, so it should be settled.
    """
    hashed = df.withColumn("_h", F.xxhash64(*[F.col(f"`{c}`") for c in key]))
    again = settled(hashed.groupBy("_h").agg(F.count("*").alias("_n")).where("_n > 1").select("_h"))
    if again.count() > most:
        return None, df
    return tuple(hashed.join(F.broadcast(again), "_h", how).drop("_h") for how in ("left_anti", "left_semi"))


def first_of_few(df: DataFrame, key: Sequence[str], order: Sequence[str], most: int = MOST_SENT) -> DataFrame:
    """As ``first_row`` over a settled table whose keys seldom repeat: only rows whose key does are shuffled."""
    lone, shared = lone_and_shared(df, key, most)
    found = first_row(shared, key, order)
    return found if lone is None else lone.unionByName(found)


def join_by_hash(df: DataFrame, values: DataFrame, on: str, most: int = MOST_SENT) -> DataFrame:
    """Inner join with a settled table that has every value of ``on`` in ``df``, once each.

    Up to ``most`` values are broadcast under their 64-bit hashes; more of them, or two with one hash, are joined as they are.
    """
    hashed = values.withColumn("_h", F.xxhash64(on))
    n = values.count()
    if n > most or hashed.select("_h").distinct().count() < n:
        return df.join(values, on)
    return df.where(F.col(on).isNotNull()).withColumn("_h", F.xxhash64(on)).join(F.broadcast(hashed.drop(on)), "_h").drop("_h")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def top_fraction(df: DataFrame, group: str, order: Sequence[Column], parts: int = 4) -> DataFrame:
    """The first n // parts rows of each group.

    Rows are dealt into ranges of group and order, so a group may hold all rows. A group's ranges that end before
    its limit stay whole; only the one range that the limit cuts is numbered.
    """
    ranged = settled(df.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(F.col(group).alias("_group"), "_range").agg(F.count("*").alias("_n"))  # ranges ascend by their number
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_range")) - F.col("_n")
    wanted = F.floor(F.sum("_n").over(Window.partitionBy("_group")) / parts) - F.col("_before")
    left = sizes.withColumn("_before", before).withColumn("_left", wanted).where("_left > 0").select("_group", "_range", "_n", "_left")
    held = ranged.join(F.broadcast(left.withColumnRenamed("_range", "_r")), ranged[group].eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_r")))
    cut = held.where("_n > _left").withColumn("_place", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))).where("_place <= _left")
    return held.where("_n <= _left").select(*df.columns).unionByName(cut.select(*df.columns))


def seeded(key: str, seed: int) -> Column:
    """A hash of key and seed, the same in every engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_sample(df: DataFrame, stratum: str, key: str, rows: int, strata: int, seed: int | None = 42) -> DataFrame:
    """rows // strata rows of each stratum, by hash of the key and the seed (by key without a seed)."""
    order = F.col(key) if seed is None else seeded(key, seed)
    return top_per_group(df, [stratum], [order, F.col(key)], rows // strata, "_r").drop("_r")


def uniform_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    return df.orderBy(seeded(key, seed), key).limit(rows)


def held_out(key: str, train_percent: int = 80, seed: int = 42) -> Column:
    """Whether a row is on the test side; that depends on its key alone."""
    return F.pmod(F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long"), F.lit(100)) >= train_percent


def split_by_hash(df: DataFrame, key: str, train_percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a row's side depends on its key alone."""
    held = held_out(key, train_percent, seed)
    return df.where(~held), df.where(held)


def join_preferring_right(left: DataFrame, right: DataFrame, on: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Inner join; columns both sides have take the right value, then the left."""
    right = right.select(*on, *[F.col(c).alias(f"_right_{c}") for c in shared], *[c for c in right.columns if c not in on and c not in shared])
    joined = left.join(right, list(on))
    return joined.withColumns({c: F.coalesce(F.col(f"_right_{c}"), F.col(c)) for c in shared}).drop(*[f"_right_{c}" for c in shared])


def enrich(left: DataFrame, right: DataFrame, on: Sequence[str], fill_mean: str | None = None) -> DataFrame:
    """Left join; ``fill_mean`` fills that column's gaps with its mean over the joined rows."""
    joined = left.join(right, list(on), "left")
    if fill_mean is None:
        return joined
    mean = joined.agg(F.avg(fill_mean).alias("_mean"))
    return joined.crossJoin(F.broadcast(mean)).withColumn(fill_mean, F.coalesce(fill_mean, "_mean")).drop("_mean")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all tables, columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def common_columns(*frames: DataFrame) -> list[str]:
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def unknown_values(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Observed values outside the known list."""
    listed = df.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return df.select(column).distinct().join(F.broadcast(listed), column, "left_anti")


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in columns], name, value)
