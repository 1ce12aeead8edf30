"""Scaling, clustering, learned models and similar items, on Spark ML and array expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.operators.quantiles import quantile_row
from resona.operators.tables import settled


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <c>_scaled: mean 0 and population deviation 1; nulls become 0."""
    row = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {f"{c}_scaled": F.coalesce(F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(row)).withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <c>_scaled: distance from the median in interquartile ranges."""
    row = quantile_row(df, columns, (0.25, 0.5, 0.75)).select(*[F.col(c).alias(f"_q_{c}") for c in columns])
    scaled = {f"{c}_scaled": (F.col(c) - F.col(f"_q_{c}")[1]) / F.nullif(F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0], F.lit(0.0)) for c in columns}
    return df.crossJoin(F.broadcast(row)).withColumns(scaled).drop(*[f"_q_{c}" for c in columns])


def vectors(df: DataFrame, columns: Sequence[str], to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=to, handleInvalid="skip").transform(df)


def centred(points: DataFrame, columns: Sequence[str], k: int, seed: int = 42):
    """K-means over the rows of ``counted``: a row weighs as many as it has copies, which leaves cost and centres as over all rows."""
    return KMeans(k=k, seed=seed, initMode="k-means||", weightCol="_n").fit(vectors(points, columns))


def cluster(df: DataFrame, columns: Sequence[str], k: int, seed: int = 42, many: int | None = None):
    """(model, rows with cluster and probabilities): the probability falls linearly with the distance from a centre."""
    model = centred(counted(df, columns, many), columns, k, seed)
    labelled = model.transform(vectors(df, columns)).withColumnRenamed("prediction", "cluster")
    point = vector_to_array("features")
    distance = lambda centre: F.sqrt(F.aggregate(F.zip_with(point, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    labelled = labelled.withColumn("distances", F.array(*[distance(c) for c in model.clusterCenters()]))
    near = F.transform("distances", lambda d: F.array_max("distances") - d)
    total = F.aggregate(near, F.lit(0.0), lambda a, x: a + x)
    return model, labelled.withColumn("probabilities", F.transform(near, lambda x: F.when(total > 0, x / total).otherwise(1.0 / k)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and the squared distance to it."""
    squares = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
    return squares.argmin(1), np.maximum(squares.min(1), 0.0)


def _seeded_centres(x: np.ndarray, k: int, rng: np.random.Generator, tries: int = 5) -> np.ndarray:
    """k rows, each drawn by its squared distance from those before, of ``tries`` draws the one with the lowest cost."""
    best = None
    for _ in range(tries):
        chosen = [int(rng.integers(len(x)))]
        gap = _nearest(x, x[chosen])[1]
        while len(chosen) < k:
            share = gap / gap.sum() if gap.sum() > 0 else np.full(len(x), 1 / len(x))
            chosen.append(int(rng.choice(len(x), p=share)))
            gap = np.minimum(gap, _nearest(x, x[chosen[-1:]])[1])
        if best is None or gap.sum() < best[0]:
            best = (gap.sum(), x[chosen])
    return best[1]


def mini_batches(df: DataFrame, columns: Sequence[str], ks: Sequence[int], batch: int = 10_000, rounds: int = 20, seeds: int = 2_000, seed: int = 42) -> dict[int, tuple[np.ndarray, float]]:
    """k -> (centres, cost over all rows) by mini-batch k-means, every k in the same passes over the table.

    One pass draws ``rounds`` batches of about ``batch`` rows (all rows, where there are no more). Each round assigns its batch to
    every k's centres in tasks that return sums alone, and moves a centre by the batch's share of the rows it has seen. The first
    centres come from at most ``seeds`` rows. A last pass sums the costs. Rows with a null are left out; without rows there is no k.
    """
    rows = settled(df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).na.drop())
    count, names = rows.count(), [f"_{i}" for i in range(len(columns))]
    if count == 0:
        return {}
    drawn = rows.where(F.rand(seed) < min(1.0, batch * rounds / count)).withColumn("_round", F.floor(F.rand(seed + 1) * rounds).cast("int"))
    drawn = settled(drawn.repartition(rounds))
    first = drawn.select(*names).limit(seeds).toPandas().to_numpy()
    if not len(first):
        first = rows.limit(seeds).toPandas().to_numpy()
    rng = np.random.default_rng(seed)
    centres = {k: _seeded_centres(first, k, rng) for k in ks}
    seen = {k: np.zeros(k) for k in ks}

    def sums(frames, centres):
        for frame in frames:
            x = frame[names].to_numpy()
            for k, c in centres.items():
                near, _ = _nearest(x, c)
                n = np.bincount(near, minlength=k)
                totals = [np.bincount(near, weights=x[:, i], minlength=k) for i in range(x.shape[1])]
                yield pd.DataFrame({"k": k, "c": range(k), "n": n, **dict(zip(names, totals, strict=True))})[n > 0]

    def costs(frames, centres):
        for frame in frames:
            x = frame[names].to_numpy()
            yield pd.DataFrame({"k": list(centres), "cost": [_nearest(x, c)[1].sum() for c in centres.values()]})

    schema = "k int, c int, n long, " + ", ".join(f"{n} double" for n in names)
    for turn in range(rounds):
        now = dict(centres)
        partial = drawn.where(F.col("_round") == turn).mapInPandas(lambda frames, now=now: sums(frames, now), schema)
        centres = {k: c.copy() for k, c in now.items()}
        for r in partial.groupBy("k", "c").agg(*[F.sum(n).alias(n) for n in ("n", *names)]).collect():
            seen[r.k][r.c] += r.n
            centres[r.k][r.c] += (np.array([r[n] for n in names]) / r.n - now[r.k][r.c]) * r.n / seen[r.k][r.c]
    final = rows.mapInPandas(lambda frames: costs(frames, centres), "k int, cost double").groupBy("k").agg(F.sum("cost").alias("cost")).collect()
    return {r.k: (centres[r.k], r.cost) for r in final}


def elbow(df: DataFrame, columns: Sequence[str], most: int = 8, seed: int = 42, full: int = 10_000) -> tuple[int, list[float]]:
    """The k with the largest second difference of the training cost over 2..most, and the costs.

    Up to ``full`` rows are fitted once for each k, more of them by mini-batches for all k together.
    """
    ready = vectors(df, columns)
    if ready.count() > full:
        found = mini_batches(ready, columns, range(2, most + 1), seed=seed)
        costs = [found[k][1] for k in range(2, most + 1)]
    else:
        points = ready.select("features").persist()
        costs = [KMeans(k=k, seed=seed).fit(points).summary.trainingCost for k in range(2, most + 1)]
        points.unpersist()
    bends = [costs[i - 1] - 2 * costs[i] + costs[i + 1] for i in range(1, len(costs) - 1)]
    return (2 + 1 + bends.index(max(bends)) if bends else 2), costs


def silhouette(labelled: DataFrame) -> float:
    """Over all rows: the evaluator takes a weight off its cluster's size where one row must go, so copies can't be weighed."""
    return ClusteringEvaluator(predictionCol="cluster", featuresCol="features").evaluate(labelled)


def sound_profiles(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per cluster: size, share, feature means and descriptive labels."""
    total = labelled.agg(F.count("*").alias("all"))
    out = labelled.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(c).alias(c) for c in columns]).crossJoin(F.broadcast(total))
    words = {"energy": ("high energy", "calm"), "danceability": ("danceable", "listening"), "valence": ("upbeat", "moody"), "acousticness": ("acoustic", "electronic")}
    labels = F.array_compact(F.array(*[F.when(F.col(c) > 0.6, high).when(F.col(c) < 0.4, low) for c, (high, low) in words.items() if c in columns]))
    return out.select("cluster", "size", (F.col("size") / F.col("all") * 100).alias("share"), *columns, labels.alias("labels"))


# Names of personas by cluster number.
PERSONA_NAMES = (
    "High-Energy Dancers", "Chill Acoustics", "Electronic Beats", "Vocal-Heavy Tracks", "Instrumental Focus", "Balanced Mainstream", "Experimental", "Live Performance", "Melancholic", "Party Anthems",
)


def personas(labelled: DataFrame, columns: Sequence[str], viral: DataFrame, song: Sequence[str] = ("track_clean", "artist_clean"), platform: str = "platform") -> DataFrame:
    """Per cluster (numbered from 0): name, size, percentage, <c>_mean and <c>_std, the mean virality of its songs (0 with none) and its platforms by rows.

    ``viral`` holds one virality_score per song; a song that several of a cluster's rows name counts once.
    """
    total = labelled.agg(F.count("*").alias("_all"))
    figures = labelled.groupBy("cluster").agg(F.count("*").alias("size"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    members = labelled.select("cluster", *song).distinct()
    spread = members.join(viral.select(*song, "virality_score"), list(song)).groupBy("cluster").agg(F.avg("virality_score").alias("_viral"))
    counted = labelled.where(F.col(platform).isNotNull()).groupBy("cluster", platform).agg(F.count("*").alias("_n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("minus"), F.col(platform).alias("name"))))
    placed = counted.groupBy("cluster").agg(F.transform(listed, lambda x: F.struct(x["name"].alias("platform"), (-x["minus"]).alias("songs"))).alias("platforms"))
    name = F.coalesce(F.get(F.array(*[F.lit(n) for n in PERSONA_NAMES]), F.col("cluster")), F.concat(F.lit("Persona_"), F.col("cluster").cast("string")))
    out = figures.crossJoin(F.broadcast(total)).join(spread, "cluster", "left").join(placed, "cluster", "left")
    return out.select("cluster", name.alias("persona"), "size", (F.col("size") / F.col("_all") * 100).alias("percentage"), *[f"{c}_{n}" for c in columns for n in ("mean", "std")], F.coalesce("_viral", F.lit(0.0)).alias("avg_virality"), "platforms")


def nearest_songs(labelled: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Per cluster the ``k`` rows nearest to its centre."""
    own = F.element_at("distances", F.col("cluster") + 1)
    ranked = labelled.select(key, "cluster", own.alias("distance")).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", key)))
    return ranked.where(F.col("rank") <= k)


def project(df: DataFrame, columns: Sequence[str], variance: float = 0.95):
    """(model, rows with ``pca``): as many components as explain the share of variance."""
    ready = vectors(df, columns)
    explained = PCA(k=len(columns), inputCol="features", outputCol="pca").fit(ready).explainedVariance.toArray().cumsum()
    k = int((explained < variance).sum()) + 1
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="pca").fit(ready)
    return model, model.transform(ready)


#: rows from which it pays to count equal ones before a fit
COUNTED_FROM = 100_000


def counted(df: DataFrame, columns: Sequence[str], many: int | None = None) -> DataFrame:
    """The distinct rows of ``columns``, as doubles without nulls, with their number of copies (``_n``), written once.

    Where fewer than three in four rows are copies, or the table has less than ``many`` rows, they are kept as they are, and ``_n`` is 1.
    ``df`` is read twice.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    size = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct(*columns)).alias("kinds")).first()
    if size["rows"] < (COUNTED_FROM if many is None else many) or 4 * size["kinds"] > size["rows"]:
        return settled(rows.withColumn("_n", F.lit(1).cast("long")))
    return settled(rows.groupBy(*columns).agg(F.count("*").alias("_n")))


def answered(df: DataFrame, columns: Sequence[str], models: Sequence, answers: Sequence[str], many: int | None = None) -> DataFrame:
    """Rows without nulls in ``columns`` with the models' ``answers``; where most rows are copies each distinct one is asked once."""
    ask = lambda rows: reduce(lambda d, m: m.transform(d).drop("features"), models, rows)
    points = counted(df, columns, many)
    if points.where("_n > 1").isEmpty():
        return ask(df).select(*df.columns, *answers)
    return df.join(settled(ask(points).select(*columns, *answers)), list(columns)).select(*df.columns, *answers)


class Mean(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The mean of the trees' answers: numbers, or vectors of probabilities, whose likeliest class is then ``prediction``."""

    def _transform(self, df: DataFrame) -> DataFrame:
        columns, to = self.getInputCols(), self.getOutputCol()
        if df.schema[columns[0]].dataType.typeName() == "double":
            return df.withColumn(to, reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / len(columns)).drop(*columns)
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        p = F.transform(reduce(add, [vector_to_array(c) for c in columns]), lambda x: x / len(columns))
        out = df.withColumn(to, p).drop(*columns)
        return out.withColumn("prediction", F.array_position(to, F.array_max(to)).cast("double") - 1).withColumn(to, array_to_vector(to))


def _forest(df: DataFrame, columns: Sequence[str], label: str, forest, many: int | None) -> PipelineModel:
    """``forest`` fitted; where most rows are copies, tree by tree on the distinct rows.

    A tree's bootstrap takes each row Poisson(1) times, thus the ``_n`` copies of a row Poisson(``_n``) times together: that is the row's
    weight for the tree. It is drawn from the row's own hash, so that reruns agree.
    """
    points = counted(df, [*columns, label], many)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip")
    classes = forest.hasParam("probabilityCol")
    if points.where("_n > 1").isEmpty():
        return Pipeline(stages=[assembler, forest]).fit(points)
    trees, seed = forest.getNumTrees(), forest.getSeed()

    def draw(frames):
        for frame in frames:
            weights = [np.random.default_rng([seed, h & (1 << 64) - 1]).poisson(n, trees) for h, n in zip(frame["_h"].tolist(), frame["_n"], strict=True)]
            yield frame.drop(columns=["_h", "_n"]).assign(_w=weights)

    kind = ", ".join(f"`{c}` double" for c in (*columns, label))
    drawn = settled(points.withColumn("_h", F.xxhash64(*columns, label)).mapInPandas(draw, f"{kind}, _w array<long>"))
    if classes:
        top = int(drawn.agg(F.max(label)).first()[0])
        drawn = drawn.withMetadata(label, {"ml_attr": {"type": "nominal", "num_vals": max(2, top + 1)}})
    ready = assembler.transform(drawn)
    one = {"numTrees": 1, "bootstrap": False, "subsamplingRate": 1.0, "weightCol": "_weight", "featureSubsetStrategy": "sqrt" if classes else "onethird"}

    def grown(t: int):
        tree = forest.copy({forest.getParam(k): v for k, v in (one | {"seed": seed + t}).items()})
        tree = tree.copy({tree.getParam(k): v for k, v in ({"probabilityCol": f"_tree_{t}", "rawPredictionCol": "", "predictionCol": ""} if classes else {"predictionCol": f"_tree_{t}"}).items()})
        return tree.fit(ready.withColumn("_weight", F.col("_w")[t].cast("double")).where("_weight > 0"))

    with ThreadPool(4) as pool:
        stages = pool.map(grown, range(trees))
    mean = Mean()
    mean._set(inputCols=[f"_tree_{t}" for t in range(trees)], outputCol=forest.getProbabilityCol() if classes else forest.getPredictionCol())
    return PipelineModel([assembler, *stages, mean])


def forest_classifier(df: DataFrame, columns: Sequence[str], label: str, trees: int = 200, depth: int = 15, seed: int = 42, many: int | None = None):
    return _forest(df, columns, label, RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed), many)


def forest_regressor(df: DataFrame, columns: Sequence[str], label: str, trees: int = 100, depth: int = 8, seed: int = 42, many: int | None = None):
    return _forest(df, columns, label, RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, predictionCol="expected"), many)


def audience_models(df: DataFrame, columns: Sequence[str], targets: Sequence[str], trees: int = 200, depth: int = 15, most: int = 1000):
    """One forest per target column of strings, with its classes: {target: (model, classes)}. More than ``most`` classes are an error."""
    out = {}
    for target in targets:
        classes = [r[target] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().orderBy(target).limit(most + 1).collect()]
        if len(classes) > most:
            raise ValueError(f"{target} has more than {most} classes")
        numbered = df.withColumn("_label", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)).cast("double") - 1).where("_label >= 0")
        out[target] = (forest_classifier(numbered, columns, "_label", trees, depth), classes)
    return out


def select_features(df: DataFrame, columns: Sequence[str], label: str, k: int = 12) -> list[str]:
    """The ``k`` columns of largest univariate F value against a continuous label."""
    from pyspark.ml.feature import UnivariateFeatureSelector

    selector = UnivariateFeatureSelector(featuresCol="features", labelCol=label, outputCol="chosen", selectionMode="numTopFeatures")
    selector.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(min(k, len(columns)))
    return [columns[i] for i in sorted(selector.fit(vectors(df, columns)).selectedFeatures)]


def class_probabilities(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Adds the map of class probabilities, the likeliest class and its probability."""
    p = vector_to_array("probability")
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_max(p)
    return scored.withColumns({"class_map": F.map_from_arrays(names, p), "best": F.element_at(names, F.array_position(p, best).cast("int")), "confidence": best})


def two_stage(probability: Column, expected: Column, fit: Column) -> Column:
    """Expected score times probability where success is likely enough, else the rule's fit; within 0-100."""
    return F.least(F.greatest(F.when(probability > 0.3, expected * probability).otherwise(probability * fit * 100), F.lit(0.0)), F.lit(100.0))


def importances(model, columns: Sequence[str], spark) -> DataFrame:
    """Per feature its share of the gain; of a forest of single trees, the mean of the trees' shares."""
    shares = [m.featureImportances.toArray() for m in model.stages if hasattr(m, "featureImportances")]
    total = np.sum(shares, axis=0)
    values = total / total.sum() if len(shares) > 1 and total.sum() > 0 else total
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def unit(column: Column) -> Column:
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(column, lambda x: x.cast("double") / F.when(norm > 0, norm))


def _unit_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the rows with a vector of positive length, scaled to 1."""
    ready = df.select(F.col(key).alias("key"), unit(F.col(vector)).alias("v"))
    return ready.where(F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))


#: how far rounding may move a bound
SLACK = 1e-9


def _best_of(q, x, i, y, k: int):
    """The ``k`` rows of largest cosine among (i, y) for each of (q, x), as a frame; no row meets its own key."""
    near = x @ y.T
    near[q[:, None] == i[None]] = -np.inf
    if near.shape[1] > k:  # only what reaches a row's k-th cosine is sorted; cosines are rounded to 12 digits before they are compared
        r, c = np.nonzero(near >= np.partition(near, near.shape[1] - k, axis=1)[:, -k, None] - SLACK)
    else:
        r, c = np.indices(near.shape).reshape(2, -1)
    value = np.round(near[r, c], 12)
    place = np.unique(i, return_inverse=True)[1]
    order = np.lexsort((place[c], -value, r))
    r, c, value = r[order], c[order], value[order]
    kept = (np.arange(len(r)) - np.searchsorted(r, r) < k) & (value > -np.inf)
    return pd.DataFrame({"query": q[r[kept]], "item": i[c[kept]], "similarity": value[kept]})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item")))
    return ranked.where(F.col("rank") <= k).select("query", "item", "rank", "similarity")


def similar(items: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, block: int = 1024) -> DataFrame:
    """Per query the ``k`` items of largest cosine (query, item, rank, similarity), itself excluded, exactly.

    Up to ``block`` queries go to every task, whose batches of items give each query their best ``k``.
    More queries are dealt into blocks, and items too; every two blocks meet in a task, so neither side is held whole anywhere.
    Similarities are rounded to 12 digits; ties go to the smaller key. Rows without a vector of positive length are left out.
    """
    kind = items.schema[key].dataType.simpleString()
    asked_rows, item_rows = _unit_rows(queries, key, vector), _unit_rows(items, key, vector)
    few = asked_rows.limit(block + 1).collect()
    if not few:
        return asked_rows.select(F.col("key").alias("query"), F.col("key").alias("item"), F.lit(0).alias("rank"), F.lit(0.0).alias("similarity"))
    if len(few) <= block:
        q, x = np.array([r["key"] for r in few]), np.array([r["v"] for r in few])

        def scan(frames):
            for frame in frames:
                if len(frame):
                    yield _best_of(q, x, frame["key"].to_numpy(), np.stack(frame["v"]), k)

        return _ranked(item_rows.mapInPandas(scan, f"query {kind}, item {kind}, similarity double"), k)

    def packed(rows: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, -(-rows.count() // block))
        blocks = rows.groupBy(F.pmod(F.xxhash64("key", "v"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("key", "v")).alias("rows"))
        return blocks.select("block", F.transform("rows", lambda r: r["key"]).alias("keys"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("values")), n

    (asked, n), (sides, _) = packed(asked_rows), packed(item_rows)
    pairs = asked.repartition(n, "block").select(F.col("keys").alias("q_keys"), F.col("values").alias("q_values")).crossJoin(sides.drop("block"))

    def best(frames):
        for frame in frames:
            for q, x, i, y in zip(frame["q_keys"], frame["q_values"], frame["keys"], frame["values"], strict=True):
                q, i = np.asarray(q), np.asarray(i)
                yield _best_of(q, np.asarray(x).reshape(len(q), -1), i, np.asarray(y).reshape(len(i), -1), k)

    return _ranked(pairs.mapInPandas(best, f"query {kind}, item {kind}, similarity double"), k)


def _reach(x, centres, radii):
    """The largest cosine that a vector of each cap (centre, angle) can have with each row of ``x``."""
    angle = np.arccos(np.clip(x @ centres.T, -1, 1)) - radii[None]
    return np.cos(np.maximum(angle, 0)) + SLACK


def caps(items: DataFrame, key: str, vector: str, block: int = 256, most_blocks: int = 20_000) -> DataFrame:
    """Blocks of neighbouring unit vectors: block, keys, values, centre, radius (the largest angle between centre and member).

    Vectors go to the nearest of n / ``block`` pivots (a sample by hash, at most ``most_blocks``); a block of more than four times
    ``block`` rows is dealt into several with about the same cap.
    """
    rows = settled(_unit_rows(items, key, vector).withColumn("row", F.monotonically_increasing_id()))
    n = max(1, min(most_blocks, -(-rows.count() // block)))
    sample = rows.orderBy(F.xxhash64("key"), "row").limit(n).select("v").collect()
    pivots = np.array([r["v"] for r in sample]) if sample else np.zeros((1, 1))

    def place(frames):
        for frame in frames:
            if len(frame):
                yield frame.assign(near=(np.stack(frame["v"]) @ pivots.T).argmax(1))

    kind = rows.schema["key"].dataType.simpleString()
    placed = settled(rows.mapInPandas(place, f"key {kind}, v array<double>, row long, near long"))
    parts = placed.groupBy("near").agg(F.ceil(F.count("*") / (4 * block)).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "near").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))  # one row for each pivot

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["v"])
        centre = x.mean(0)
        centre = centre / length if (length := np.linalg.norm(centre)) > 1e-12 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        number = int(own["near"].iloc[0]) * (1 << 31) + int(own["part"].iloc[0])
        return pd.DataFrame({"block": [number], "keys": [own["key"].to_numpy()], "values": [x.reshape(-1)], "centre": [centre], "radius": [radius]})

    return settled(dealt.groupBy("near", "part").applyInPandas(pack, f"block long, keys array<{kind}>, `values` array<double>, centre array<double>, radius double"))


def _keep_best(near, r, c, q, i, best, items, k: int) -> None:
    """Merges the cosines ``near`` of the pairs (row r, candidate c) into the rows' ``k`` best; no row takes its own key."""
    other = q[r] != i[c]
    r, c, near = r[other], c[other], np.round(near[other], 12)
    touched = np.unique(r)
    row = np.concatenate([np.repeat(touched, k), r])
    value = np.concatenate([best[touched].reshape(-1), near])
    key = np.concatenate([items[touched].reshape(-1), i[c]])
    place = key if key.dtype != object else np.unique(key, return_inverse=True)[1]
    order = np.lexsort((place, -value, row))
    row, value, key = row[order], value[order], key[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < k
    best[row[kept], rank[kept]], items[row[kept], rank[kept]] = value[kept], key[kept]


def _scan_strip(frames, k: int):
    """The ``k`` best of each row of one strip: its own blocks (side 0) come first, then the blocks they meet (side 1), one after the other."""
    own, rows_of, started = [], {}, False
    for frame in frames:
        for side, block, wanted, keys, values in zip(frame["side"], frame["block"], frame["wanted"], frame["keys"], frame["values"], strict=True):
            i = np.asarray(keys)
            y = np.asarray(values).reshape(len(i), -1)
            if side == 0:
                own.append((block, i, y))
                continue
            if not started:
                at = 0
                for number, held, _ in own:
                    rows_of[number] = np.arange(at, at := at + len(held))
                q, x = np.concatenate([o[1] for o in own]), np.concatenate([o[2] for o in own])
                best, items = np.full((len(q), k), -np.inf), np.repeat(q[:, None], k, axis=1)
                own, started = [], True
            rows = np.concatenate([rows_of[b] for b in wanted])
            near = x[rows] @ y.T
            # cosines are rounded to 12 digits before they are compared
            found = near >= best[rows, -1][:, None] - SLACK
            if near.shape[1] > 4 * k and found.sum() > 4 * k * len(rows):  # hardly anything is known yet
                near[q[rows][:, None] == i[None]] = -np.inf
                found &= near >= -np.partition(-near, k - 1, axis=1)[:, k - 1, None] - SLACK
            r, c = np.nonzero(found)
            if len(r):
                _keep_best(near[r, c], rows[r], c, q, i, best, items, k)
    if started:
        r, c = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"query": q[r], "item": items[r, c], "similarity": best[r, c]})


def top_similar(items: DataFrame, key: str, vector: str, k: int = 5, block: int = 256, first: int = 4, most_blocks: int = 20_000, pairs_seen: list | None = None, strip_bytes: int = 8 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """Per item the ``k`` others of largest cosine, exactly, as ``similar``; block pairs that can't hold one are skipped.

    A block's vectors lie in a cap around its centre, so the angle between a vector and the centre, less the cap's, bounds all its cosines.
    Each block first meets the ``first`` blocks of the highest bounds; then every row asks for the
    blocks whose bound still reaches its own k-th score. Only the caps (at most some
    ``most_blocks`` of them) go to every task. ``pairs_seen`` gets the numbers of block pairs met and of all.

    Blocks ask together, in strips of about ``strip_bytes`` of vectors: a block is sent once to each strip that asks for it, not
    once to each block, and a task, which reads about ``task_bytes``, keeps the ``k`` best of its strip's rows alone.
    """
    kind = items.schema[key].dataType.simpleString()
    blocks = caps(items, key, vector, block, most_blocks)
    listed = blocks.select("block", "centre", "radius", F.size("keys").alias("n")).orderBy("block").collect()
    if not listed:
        return similar(items, items, key, vector, k)
    number, centres, radii = np.array([r["block"] for r in listed]), np.array([r["centre"] for r in listed]), np.array([r["radius"] for r in listed])
    held = sum(r["n"] for r in listed) * 8 * centres.shape[1]
    strips, parts = -(-held // strip_bytes), max(4, -(-held // task_bytes))
    strip = F.pmod(F.xxhash64("block"), F.lit(strips)).cast("int")

    def open_first(frames):
        for frame in frames:
            for own, centre, radius in zip(frame["block"], frame["centre"], frame["radius"], strict=True):
                bound = _reach(np.asarray(centre)[None], centres, radii + radius)[0]
                bound[number == own] = 2  # its own block comes first
                yield pd.DataFrame({"block": own, "other": number[np.argsort(-bound, kind="stable")[:first]]})

    def meet(asked: DataFrame) -> DataFrame:
        side = ["strip", "part", "side", "block", "wanted", "keys", "values"]
        whole = blocks.select("block", "keys", "values")
        wanted = asked.groupBy(strip.alias("strip"), F.col("other").alias("block")).agg(F.collect_list("block").alias("wanted"))
        theirs = wanted.join(whole, "block").withColumns({"part": F.pmod(F.xxhash64("block", F.lit(1)), F.lit(parts)).cast("int"), "side": F.lit(1)})
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        ours = whole.withColumns({"strip": strip, "side": F.lit(0), "wanted": F.lit(None).cast("array<long>")}).withColumn("part", every)
        dealt = ours.select(*side).unionByName(theirs.select(*side)).repartitionById(strips * parts, F.col("strip") * parts + F.col("part"))
        return dealt.sortWithinPartitions("side").select(*side[2:]).mapInPandas(lambda frames: _scan_strip(frames, k), f"query {kind}, item {kind}, similarity double")

    begun = settled(blocks.select("block", "centre", "radius").mapInPandas(open_first, "block long, other long"))
    found = settled(_ranked(meet(begun), k).drop("rank"))
    beat = found.groupBy("query").agg(F.when(F.count("*") == k, F.min("similarity")).alias("beat"))
    rows = blocks.select("block", F.posexplode("keys").alias("at", "key")).join(beat, F.col("key") == F.col("query"), "left")
    scores = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("beat", F.lit(-2.0)).alias("beat")))).alias("rows"))

    def open_rest(frames):
        for frame in frames:
            for own, values, scores in zip(frame["block"], frame["values"], frame["beats"], strict=True):
                reach = _reach(np.asarray(values).reshape(len(scores), -1), centres, radii) >= np.asarray(scores)[:, None]
                yield pd.DataFrame({"block": own, "other": number[reach.any(0)]})

    rest = blocks.select("block", "values").join(scores.select("block", F.col("rows.beat").alias("beats")), "block").mapInPandas(open_rest, "block long, other long")
    rest = settled(rest.join(begun, ["block", "other"], "left_anti"))
    if pairs_seen is not None:
        pairs_seen += [begun.count() + rest.count(), len(number) ** 2]
    return _ranked(found.unionByName(meet(rest)), k)


def similar_by_best(items: DataFrame, key: str, scores: Mapping[str, Column], k: int = 5) -> DataFrame:
    """Per item (query, best, item, score, rank): the ``k`` others with the highest value of the score that is its own best, the first of equals.

    Only ``k + 1`` rows of each score reach every task, all lists as one row; they are taken by ``limit``, which sorts no whole list.
    A key's rows are counted by their best scores, and the lists are ranked inside the one row that is left of it.
    Copies of a key ask as often as they are there.
    """
    names = list(scores)
    scored = settled(items.select(F.col(key).alias("item"), F.array(*scores.values()).alias("scores")))
    first = reduce(DataFrame.unionByName, [
        scored.select(F.lit(n).alias("list"), "item", F.col("scores")[n].alias("score")).orderBy(F.desc("score"), "item").limit(k + 1) for n in range(len(names))])
    own = F.array_position("scores", F.array_max("scores")) - 1
    asked = scored.where(F.col("item").isNotNull()).groupBy(F.col("item").alias("query")).agg(*[F.count_if(own == n).alias(f"_{n}") for n in range(len(names))])
    times = F.array(*[F.least(F.col(f"_{n}"), F.lit(k)).cast("int") for n in range(len(names))])

    def earlier(a: Column, b: Column) -> Column:
        """Scores fall, nulls last; then items rise, then the lists."""
        score = F.when(a["score"].isNull() & b["score"].isNull(), 0).when(a["score"].isNull(), 1).when(b["score"].isNull(), -1).when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
        item = F.when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0)
        return F.when(score != 0, score).when(item != 0, item).otherwise(a["list"] - b["list"])

    # sorted once: what each query keeps of it stays in order
    listed = first.groupBy().agg(F.array_sort(F.collect_list(F.struct("list", "item", "score")), earlier).alias("listed"))
    kept = F.filter("listed", lambda x: (x["item"] != F.col("query")) & (F.get("times", x["list"]) > 0))
    copies = F.flatten(F.transform(kept, lambda x: F.array_repeat(x, F.get("times", x["list"]))))
    met = asked.withColumn("times", times).crossJoin(F.broadcast(listed))
    ranked = met.select("query", F.posexplode(F.slice(copies, 1, k)).alias("at", "m"))
    return ranked.select("query", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("m.list") + 1).alias("best"), "m.item", "m.score", (F.col("at") + 1).alias("rank"))


def key_similarities(columns: Sequence[str], other: str = "other_", k: int = 3) -> Column:
    """The ``k`` features nearest between a row and its counterpart's columns, closeness above .8."""
    near = [F.struct((F.abs(F.col(c) - F.col(other + c)) - 1).alias("minus"), F.lit(c).alias("feature"), F.round(1 - F.abs(F.col(c) - F.col(other + c)), 6).alias("closeness")) for c in columns]
    kept = F.filter(F.array(*near), lambda x: x["closeness"] > 0.8)
    return F.transform(F.slice(F.array_sort(kept), 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["closeness"].alias("closeness")))


def artist_profiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per artist: feature means, modal genre and platform, popularity, size, and whether on several platforms."""
    return df.groupBy("artist_name").agg(
        *[F.avg(c).alias(c) for c in columns], F.mode("genre", True).alias("genre"), F.mode("platform", True).alias("platform"), F.avg("normalized_popularity").alias("popularity"),
        F.count("*").alias("tracks"), (F.countDistinct("platform") > 1).alias("multi"))
