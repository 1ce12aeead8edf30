"""Operators that SQL doesn't express: scorers, leader groups, files, streams."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resona.functions import fuzzy, numeric
from resona.functions import text as T
from resona.operators import matching, models, tables
from resona.sources import readers, sinks
from resona.streaming import status


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratio_is_twice_the_common_subsequence(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert abs(fuzzy.ratio_of(a, b) - want) < 1e-9


def test_partial_and_set_scores():
    assert fuzzy.partial_of("abc", "xxabcxx") == 100.0
    assert fuzzy.token_set_of("a b", "b a c") == 100.0
    assert fuzzy.token_set_of("", "a") == 0.0


def test_name_cases(spark):
    rows = [("The Weeknd feat. Daft Punk", "I Feel It Coming (Explicit Version)"), ("Beyoncé", "Crazy In Love (Featuring Jay-Z)"), (None, None)]
    df = spark.createDataFrame(rows, "a string, t string").select(T.clean_artist(F.col("a")).alias("a"), T.clean_track(F.col("t")).alias("t"), T.featured_artists(F.col("a")).alias("f"))
    got = df.collect()
    assert [(r.a, r.t) for r in got] == [("weeknd", "i feel it coming"), ("beyonce", "crazy in love"), ("", "")]
    assert got[0].f.featured == ["daft punk"] and got[2].f.featured == []


def test_folding_is_compatibility_decomposition(spark):
    import random
    import unicodedata

    rng = random.Random(9)
    texts = ["Beyoncé", "ﬁancé ½ ㎏ …", "Tiếng Việt", "ｆｕｌｌ", "日本 e\u0301", "𝐁old", "plain", ""]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0xF900, 0xFFFE)])) for _ in range(12)) for _ in range(300)]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.fold_accents(F.col("t")).alias("f")).collect()]
    assert got == [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def greedy_leaders(names, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for lead in sorted(names):
        if lead not in out:
            out[lead] = lead
            out |= {n: lead for n in near.get(lead, ()) if n not in out}
    return out


@pytest.mark.parametrize("few", [0, 500_000])
def test_leader_groups_follow_the_greedy_order(spark, few):
    import random

    rng = random.Random(6)
    names = [f"n{i:03d}" for i in range(140)]
    edges = [(a, b) for a, b in combinations(names[:14], 2) if (int(a[1:]) * 7 + int(b[1:]) * 3) % 4 == 0]
    edges += [tuple(rng.sample(names[14:60], 2)) for _ in range(90)] + list(zip(names[60:100], names[61:101])) + [tuple(rng.sample(names[60:130], 2)) for _ in range(12)] + [(names[3], names[3])]
    found = matching.leader_groups(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "name", spark.createDataFrame(edges, "a string, b string"), few=few)
    got = [(r["name"], r["leader"]) for r in found.collect()]
    assert len(got) == len(names) and dict(got) == greedy_leaders(names, edges)


@pytest.mark.parametrize("few", [100, 500_000])
def test_a_long_chain_of_names_settles(spark, few):
    names = [f"n{i:05d}" for i in range(10_000)]
    edges = list(zip(names, names[1:]))
    found = matching.leader_groups(spark.createDataFrame([(n,) for n in names], "name string"), "name", spark.createDataFrame(edges, "a string, b string"), few=few)
    assert {r["name"]: r["leader"] for r in found.collect()} == greedy_leaders(names, edges)


def test_near_pairs_lose_no_match(spark, sf_dir):
    import random

    rng = random.Random(2)
    names = {r.p_name for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().collect()}
    names |= {"old plate", "cold plate", "beyonce", "beyonse", "u2", "u 2", "a b", "b a", "été là", "ete la", " ", "aaaa", "aaaaa"}
    names |= {"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 12))) for _ in range(80)}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    every = df.select(F.col("name").alias("a")).crossJoin(df.select(F.col("name").alias("b"))).where("a < b")
    for metric, least in (("ratio", 85), ("token_sort", 70), ("token_sort", 90), ("edit", 70)):
        rows = lambda pairs: {(r.a, r.b) for r in matching.scored_pairs(pairs, least, metric).collect()}  # noqa: B023, E731
        want = rows(every)
        assert want and rows(matching.near_pairs(df, df, "name", least, metric).where("a < b")) == want
    assert ("cold plate", "old plate") in rows(matching.near_pairs(df, df, "name", 85))


def test_bins_and_nulls(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (None,)], "x double")
    got = df.select(numeric.cut_bins(F.col("x"), [0, 5], ["in"]).alias("open"), numeric.cut_bins(F.col("x"), [0, 5], ["in"], include_lowest=True).alias("closed")).collect()
    assert [tuple(r) for r in got] == [(None, "in"), ("in", "in"), (None, None)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, "b")], "id int, name string")
    sinks.csv(df, f"{tmp_path}/one_clean.csv")
    assert sorted(map(tuple, readers.csv(spark, f"{tmp_path}/one_clean.csv", "id int, name string").collect())) == [(1, "é"), (2, "b")]
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed/a.csv").write_bytes("id,name\n3,é\n".encode("latin-1"))
    (tmp_path / "mixed/b.csv").write_bytes("id,name\n4,é\n".encode())
    assert sorted(map(tuple, readers.csv_any_encoding(spark, f"{tmp_path}/mixed", "id int, name string").collect())) == [(3, "é"), (4, "é")]
    both = readers.labelled(spark, {"2021": f"{tmp_path}/mixed/b.csv", "2022": f"{tmp_path}/mixed/b.csv"}, "source_year")
    assert both.count() == 2 and both.select("source_year").distinct().count() == 2
    assert readers.glob(spark, f"{tmp_path}/mixed", "b.csv").first()["normalization_source"] == "b.csv"
    assert sinks.datasets({"x": df}, f"{tmp_path}/sets") == {"x": 2}
    sinks.json_report(df, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == 2
    sinks.text_report(spark.createDataFrame([("a", 2, "second"), ("a", 1, "first")], "section string, ord int, line string"), f"{tmp_path}/text")
    assert [r.value for r in spark.read.text(f"{tmp_path}/text").collect()] == ["first", "second"]
    sinks.export(df.select(F.struct("id").alias("s")), f"{tmp_path}/export", "json")
    assert spark.read.json(f"{tmp_path}/export").columns == ["s_id"]
    assert readers.materialized(spark, f"{tmp_path}/kept", lambda: df).count() == readers.materialized(spark, f"{tmp_path}/kept", lambda: 1 / 0).count() == 2


def test_encodings_by_lines(spark, tmp_path):
    folder = tmp_path / "texts"
    (folder / "deep").mkdir(parents=True)
    (folder / "plain.csv").write_bytes(b"a,b\n1,2\n")
    (folder / "empty.csv").write_bytes(b"")
    (folder / "utf.csv").write_bytes("é,日\n".encode() * 50_000)
    (folder / "deep/late.csv").write_bytes("é,b\n".encode() * 80_000 + "é\n".encode("latin-1"))  # only the last line tells
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # files in parts
    try:
        got = {r.path.rsplit("/", 1)[-1]: r.encoding for r in readers.encodings(spark, str(folder)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"plain.csv": "UTF-8", "utf.csv": "UTF-8", "late.csv": "ISO-8859-1"}


def test_results_are_reused_while_nothing_changed(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    made = lambda least: readers.reused(spark.read.parquet(f"{tmp_path}/in").where(F.col("id") >= least), f"{tmp_path}/kept")
    names = lambda: sorted(p.name for p in (tmp_path / "kept/results").iterdir())
    assert made(4).count() == 6
    before = names()
    files = made(4).inputFiles()
    assert made(4).inputFiles() == files and names() == before  # an equal plan over equal files
    assert made(5).count() == 5 and len(names()) == 2  # another plan
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
    assert made(4).count() == 8 and len(names()) == 3  # another input
    import shutil

    shutil.rmtree(tmp_path / "kept/marks")  # saved, but never marked as whole
    assert made(4).count() == 8


def test_media_manifest(spark):
    files = spark.createDataFrame([("a/b.MP3", 10, 30.0), ("c.txt", 60 << 20, 1.0)], "path string, length long, duration double")
    got = {r.path: (r.valid, r.problems) for r in readers.media_manifest(files).collect()}
    assert got == {"a/b.MP3": (True, []), "c.txt": (False, ["extension", "size", "too short"])}


def test_top_similar_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 8))
    x[40:50] = x[:10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [])]
    got = models.top_similar(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", k=5, block=17).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 9)
    want = {(q, r + 1): i for q in range(90) for r, i in enumerate(sorted((i for i in range(90) if i != q), key=lambda i: (-near[q, i], i))[:5])}
    assert {(r["query"], r["rank"]): r["item"] for r in got} == want and len(got) == 450


def test_top_similar_skips_blocks_of_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    middles = rng.normal(size=(24, 12))
    x = middles[rng.integers(0, 24, 900)] + rng.normal(size=(900, 12)) * 0.02
    x[10] = x[400] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    seen = []
    got = {(r["query"], r["rank"]): r["item"] for r in models.top_similar(df, "id", "v", k=5, block=30, first=2, pairs_seen=seen).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 12)
    np.fill_diagonal(near, -np.inf)
    want = {(q, r + 1): int(i) for q in range(900) for r, i in enumerate(np.argsort(-near[q], kind="stable")[:5])}
    assert sum(got[k] == want[k] for k in want) >= len(want) - 4 and len(got) == len(want)  # the last digit of a tie may differ
    assert seen[0] < 0.5 * seen[1]
    assert models.top_similar(df.limit(0), "id", "v").count() == 0


def _shuffled(spark):
    listed = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))


def test_top_similar_sends_a_block_once_to_a_strip(spark):
    import numpy as np

    x = np.random.default_rng(8).normal(size=(1200, 16))
    df = spark.createDataFrame([(f"k{i:04}", v.tolist()) for i, v in enumerate(x)], "id string, v array<double>").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        got = models.top_similar(df, "id", "v", k=5, block=10, strip_bytes=40_000, task_bytes=60_000).collect()
        sent = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 12)
    np.fill_diagonal(near, -np.inf)
    want = {(f"k{q:04}", r + 1): f"k{i:04}" for q in range(1200) for r, i in enumerate(np.argsort(-near[q], kind="stable")[:5])}
    assert {(r["query"], r["rank"]): r["item"] for r in got} == want
    assert sent < 40 * x.nbytes  # some 14,000 pairs of blocks of 1,280 bytes would be 120 times and more


def _window_sorts(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Window [") + plan.count("WindowGroupLimit [")


def test_similar_by_best_ranks_keys_in_place(spark):
    rows = [(f"r{i:02}", float(i % 4), float(i % 3), None if i % 5 else 2.5) for i in range(30)] + [("r07", 3.0, 1.0, None)] * 3 + [("none", None, None, None), (None, 9.0, 0.0, None)]
    df = spark.createDataFrame(rows, "id string, x double, y double, z double").repartition(5)
    got = models.similar_by_best(df, "id", {n: F.col(n) for n in "xyz"}, k=5)
    assert _window_sorts(got) == 0  # no task sorts the rows of one score
    lists = {n: sorted(((r[0], r[1 + at]) for r in rows), key=lambda e: (e[1] is None, -(e[1] or 0), e[0] is not None, e[0] or ""))[:6] for at, n in enumerate("xyz")}
    met = {}
    for r in rows:
        known = [v for v in r[1:] if v is not None]
        if known and r[0] is not None:
            best = next(n for n, v in zip("xyz", r[1:]) if v == max(known))
            met.setdefault(r[0], []).extend((best, i, s) for i, s in lists[best] if i is not None and i != r[0])
    want = {(q, rank + 1): e for q, found in met.items() for rank, e in enumerate(sorted(found, key=lambda e: (-e[2], e[1], e[0]))[:5])}
    assert {(r.query, r.rank): (r.best, r.item, r.score) for r in got.collect()} == want


def test_top_fraction_of_one_large_group(spark):
    rows = [("big", None if i % 7 == 0 else float(i % 11), i) for i in range(2003)] + [("small", 1.0, i) for i in range(9)] + [("tiny", 1.0, 1)] + [(None, float(i), i) for i in range(8)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(6, "id")
    found = tables.top_fraction(df, "g", [F.desc_nulls_last("v"), F.col("id")])
    got = [(r.g, r.v, r.id) for r in found.collect()]
    want = []
    for g in ("big", "small", "tiny", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want += own[: len(own) // 4]
    assert sorted(got, key=repr) == sorted(want, key=repr) and found.columns == ["g", "v", "id"]
    assert "_range" in str(found._jdf.queryExecution().optimizedPlan())  # numbered by range, not by group


def test_search_scores_outlines_once(spark, monkeypatch):
    scored = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        scored.add(len(a))
        return pd.Series([fuzzy.partial_of(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype=float)

    monkeypatch.setattr(matching, "partial_ratio", counted)
    rows = [(f"{('Red ring', 'old BOLT', 'İx ring', '𝄞red')[i % 4]} {i}", None if i % 5 == 0 else f"Artist#{i % 9}", None if i % 6 == 0 else float(i % 13)) for i in range(600)]
    rows += [("red", None, 1.0), ("", "red ring", 2.0), (None, "bolt", 3.0), rows[1], rows[1]]
    asked = ["red ring", "a bolt [7]", "𝄞r", "", "tis"]
    got = matching.search(spark.createDataFrame(rows, "t string, a string, n double"), spark.createDataFrame([(q,) for q in asked], "q string"), ["t", "a"], "n", limit=7)
    want = set()
    for q in asked:
        best = []
        for t, a, n in set(rows):
            score = max(fuzzy.partial_of(q, x.lower()) if x and q else 0.0 for x in (t, a))
            if score > 60:
                best.append((-score, n is None, -(n or 0), (t is not None, t or ""), (a is not None, a or ""), t, a, n))
        want |= {(q, b[5], b[6], b[7], round(-b[0], 9), i + 1) for i, b in enumerate(sorted(best, key=lambda b: b[:5])[:7])}
    assert {(r.q, r.t, r.a, r.n, round(r.score, 9), r["rank"]) for r in got.collect()} == want
    assert 0 < scored.value < 400  # 600 and more distinct names for five queries


def test_settled_tables_are_packed_and_whole(spark):
    from pathlib import Path

    def used():
        folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    rows = [(i, f"the same long name of a song {i % 9}", [float(i), None], None if i % 2 else i / 7) for i in range(20_000)]
    df = spark.createDataFrame(rows, "i long, name string, v array<double>, x double").repartition(3)
    before = used()
    kept = tables.settled(df.withColumn("t", F.timestamp_seconds("i")).withColumn("s", F.struct("i", "name")))
    assert used() - before < 20_000 * 60
    assert kept.inputFiles() and all(f.endswith(".parquet") for f in kept.inputFiles())  # kept by column, not as rows
    assert sorted(tuple(r)[:4] for r in kept.collect()) == [(i, n, v, x) for i, n, v, x in rows] and kept.where("t = timestamp_seconds(i) AND s.i = i").count() == 20_000
    odd = tables.settled(spark.sql("SELECT 1 AS a, 2 AS A, NULL AS c"))
    assert [tuple(r) for r in odd.collect()] == [(1, 2, None)]
    assert tables.settled(df.limit(0)).schema.names == df.columns and tables.settled(df.limit(0)).isEmpty()


def test_similar_spellings_merge(spark, sf_dir):
    from resona.sources.fixtures import view

    songs = view(spark, sf_dir, "songs").limit(60).withColumn("n", F.pmod(F.hash("rec_id"), F.lit(4)))
    names = F.array(*[F.lit(x) for x in ("midnight riverside station", "midnight riverside statoin", "midnigt riverside station", "quite another song")])
    songs = songs.withColumn("song", F.element_at(names, F.col("n") + 1)).drop("n")
    songs = spark.createDataFrame(songs.collect(), songs.schema)
    sizes = {r.song: r["count"] for r in songs.groupBy("song").count().collect()}
    want = greedy_leaders(sizes, [(a, b) for a, b in combinations(sorted(sizes), 2) if fuzzy.ratio_of(a, b) >= 95])
    merged = matching.merge_similar(songs, "song", ["energy", "danceability", "valence", "acousticness", "instrumentalness"]).collect()
    assert {r.song: r.merged for r in merged} == {lead: sum(n for s, n in sizes.items() if want[s] == lead) for lead in set(want.values())} and len(merged) == 2
    best = songs.groupBy().agg(F.max("normalized_popularity")).first()[0]
    assert max(r.normalized_popularity for r in merged) == best


def test_similar_query_answers_every_item(spark, sf_dir):
    from resona.plans import registry

    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert registry.queries()["sim3_similar_pairs"](spark, sf_dir).groupBy("query").count().where("count = 5").count() == n


def test_model_persistence(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 2)) for i in range(60)], "x double, y double, label double")
    model = models.forest_classifier(df, ["x", "y"], "label", trees=3, depth=3)
    sinks.save_model(model, f"{tmp_path}/model")
    assert sinks.load_model(f"{tmp_path}/model").transform(df).count() == 60
    assert models.importances(model, ["x", "y"], spark).count() == 2


def test_stream_keeps_the_latest_status(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "pending"), (1, 2, "2024-01-01 00:05:00", "completed"), (2, 3, "2024-01-01 00:01:00", "failed")]
    df = spark.createDataFrame(rows, "song_id long, seq long, ts string, processing_status string").select("song_id", "seq", F.to_timestamp("ts").alias("status_ts"), "processing_status")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = status.latest_status(stream).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.song_id: r.progress for r in spark.table("latest").collect()} == {1: 100, 2: 0}
    once = status.once_per_song(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    status.upsert_batches(once, f"{tmp_path}/out", f"{tmp_path}/c2", "song_id", ["status_ts"]).awaitTermination(120)
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert kept.count() == 2 and status.current(kept, "song_id", ["status_ts", "seq"]).count() == 2


def test_stream_scores_uploads(spark, sf_dir, tmp_path):
    from resona.operators.scores import audio_appeal
    from resona.sources.fixtures import view

    songs = view(spark, sf_dir, "songs").withColumn("audio_appeal", audio_appeal())
    songs.limit(50).write.parquet(f"{tmp_path}/songs")
    stream = spark.readStream.schema(songs.schema).parquet(f"{tmp_path}/songs")
    status.analyze_uploads(stream, f"{tmp_path}/analysis", f"{tmp_path}/failures", f"{tmp_path}/c").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/analysis").count() + spark.read.parquet(f"{tmp_path}/failures").count() == 50


def test_stream_saves_batches_and_combines_them(spark, sf_dir, tmp_path):
    from resona.operators.scores import audio_appeal
    from resona.sources.fixtures import view

    songs = view(spark, sf_dir, "songs").withColumn("audio_appeal", audio_appeal())
    songs.limit(30).repartition(3).write.parquet(f"{tmp_path}/songs")
    stream = spark.readStream.schema(songs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/songs")
    status.batch_results(stream, f"{tmp_path}/batches", f"{tmp_path}/c").awaitTermination(120)
    final = status.combined(spark, f"{tmp_path}/batches", f"{tmp_path}/final")
    assert final.count() == final.select("rec_id").distinct().count() == songs.limit(30).count() and "batch" not in final.columns


def partial_by_force(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    return max(200.0 * lcs(short, c) / (n + len(c)) for c in {long[max(0, i) : i + n] for i in range(1 - n, len(long))} if c)


def test_search_matches_brute_force(spark):
    rows = [("old plate", "x", 3.0), ("cold plate", "plato", 2.0), ("blue ring", None, 1.0), ("zzz", "olt plxte", None)]
    catalog = spark.createDataFrame(rows, "t string, a string, p double")
    queries = spark.createDataFrame([("old plate",), ("ring",), (None,)], "q string")
    got = {(r.q, r.t): r.score for r in matching.search(catalog, queries, ["t", "a"], "p", block=1).collect()}
    want = {(q, t): best for q in ("old plate", "ring") for t, a, _ in rows if (best := max(partial_by_force(q, c) for c in (t, a) if c)) > 60}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_likely_pairs_match_brute_force(spark):
    songs = [("Brand#12", "old plate"), ("Brand#12", "cold plate"), ("Brand#13", "old plate"), ("Other", "old plate"), ("Brand#12", "plate old"), ("Brand#12", "ring")]
    got = {(r.artist_a, r.track_a, r.artist_b, r.track_b): (r.strict, r.lenient) for r in matching.likely_pairs(spark.createDataFrame(songs, "artist string, track string")).collect()}
    ratio = lambda x, y: fuzzy.ratio_of(" ".join(sorted(x.split())), " ".join(sorted(y.split())))
    want = {}
    for x, y in combinations(sorted(songs), 2):
        artist, track = ratio(x[0], y[0]), ratio(x[1], y[1])
        if artist >= 70 and track >= 70:
            want[(*x, *y)] = (artist >= 90 and track >= 85, artist * 0.6 + track * 0.4 >= 85)
    assert got == want and any(s for s, _ in want.values())


def test_integration_merges_spelling_variants(spark, sf_dir):
    from resona.plans import scoring
    from resona.sources.fixtures import view

    tracks = view(spark, sf_dir, "tracks").limit(40).withColumn("n", F.pmod(F.hash("rec_id"), F.lit(4)))
    names = F.array(*[F.lit(x) for x in ("Midnight Riverside", "Midnight Riversides", "Midnigt Riverside", "Quite Another Song")])
    tracks = tracks.withColumns({"track_name": F.element_at(names, F.col("n") + 1), "artist_name": F.lit("The Gleam")}).drop("n")
    tracks = spark.createDataFrame(tracks.collect(), tracks.schema)
    exact, fuzzy_ = scoring.flagship(tracks), scoring.flagship(tracks, least=85)
    assert exact.count() == tracks.select("track_name").distinct().count() == 4
    assert fuzzy_.count() == 2 and fuzzy_.agg(F.sum("record_count")).first()[0] == tracks.count()


def test_cosine_neighbours_of_some(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(60, None), (61, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query, r["rank"]): r.item for r in models.similar(df, df.where("id % 10 = 0"), "id", "v", k=3, block=16).collect()}
    x = np.array([v for _, v in rows[:60]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        order = sorted((i for i in range(60) if i != q), key=lambda i: -(x[q] @ x[i]))[:3]
        assert [got[q, k + 1] for k in range(3)] == order


def test_samples_follow_their_keys(spark, sf_dir):
    from resona.sources.fixtures import view

    songs = view(spark, sf_dir, "songs")
    train, test = tables.split_by_hash(songs, "rec_id")
    assert train.count() + test.count() == songs.count()
    assert tables.uniform_sample(songs, "rec_id", 10).collect() == tables.uniform_sample(songs.repartition(3), "rec_id", 10).collect()
