"""Reports as tables, documents and text; personas on given labels."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from resona.operators import models, reports
from resona.sources import sinks

_SECTIONS = [("top_tracks", 2, "b", "score", 1.5, None), ("top_tracks", 1, "c", "score", None, None), ("top_tracks", 1, "c", "genre", None, "pop"), ("summary", 1, "all", "rows", 1234.0, None)]


def _sections(spark):
    return spark.createDataFrame(_SECTIONS, "section string, place int, item string, measure string, value double, text string")


def test_document(spark, tmp_path):
    sinks.json_report(reports.as_document(_sections(spark)), str(tmp_path / "j"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "j")).collect()]
    report = json.loads(line)["report"]
    assert [i["item"] for i in report["top_tracks"]] == ["c", "b"]
    assert report["top_tracks"][0]["measures"]["genre"] == "pop" and report["summary"][0]["measures"]["rows"] == "1234.0"


def test_lines(spark, tmp_path):
    sinks.text_report(reports.as_lines(_sections(spark), "Talent"), str(tmp_path / "t"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert lines == ["Talent", "======", "", "Summary", "-------", "  all - rows: 1,234.00", "", "Top Tracks", "----------", "  c - genre: pop, score: unknown", "  b - score: 1.50"]
    assert reports.as_lines(_sections(spark).where("false"), "Talent").count() == 2


def test_recommendations(spark):
    complete = spark.createDataFrame([("energy", 79.5), ("tempo", 80.0), ("key", None)], "feature string, percent double")
    facts = spark.createDataFrame([(69.9, 11, 50)], "overall double, popularity_outliers int, mixed_genres int")
    found = {(r.category, r.priority, r.recommendation) for r in reports.recommendations(complete, facts).collect()}
    assert found == {
        ("Data Quality", "High", "Overall data quality is below 70%. Consider improving data collection processes."),
        ("Data Completeness", "Medium", "energy is only 79.5% complete. Consider additional data sources or imputation strategies."),
        ("Data Consistency", "Medium", "Found 11 songs with inconsistent popularity across platforms. Review normalization methods."),
    }


def test_personas(spark):
    rows = [(0, "t", "a", "spotify", 0.5), (0, "t", "a", "spotify", None), (0, "u", "a", "tiktok", 1.5), (11, "v", None, None, 1.0)]
    labelled = spark.createDataFrame(rows, "cluster int, track_clean string, artist_clean string, platform string, energy double")
    viral = spark.createDataFrame([("t", "a", 10.0), ("u", "a", 40.0), ("w", "a", 90.0)], "track_clean string, artist_clean string, virality_score double")
    first, second = models.personas(labelled, ["energy"], viral).orderBy("cluster").collect()
    assert (first.persona, first.size, first.percentage, first.energy_mean, first.avg_virality) == ("High-Energy Dancers", 3, 75.0, 1.0, 25.0)
    assert [tuple(p) for p in first.platforms] == [("spotify", 2), ("tiktok", 1)]
    assert (second.persona, second.energy_std, second.avg_virality, second.platforms) == ("Persona_11", None, 0.0, None)
    assert models.personas(labelled.where("false"), ["energy"], viral.withColumn("extra", F.lit(1))).count() == 0


def test_integration_report_makes_its_masters_once(spark, sf_dir):
    from resona.plans import reporting
    from resona.sources.fixtures import view

    def shuffled():
        listed = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(listed.apply(i).totalShuffleWrite() for i in range(listed.size()))

    songs = view(spark, sf_dir, "songs")
    before = shuffled()
    songs.groupBy("track_name", "artist_name", "rec_id").count().write.format("noop").mode("overwrite").save()
    once = shuffled() - before
    assert reporting.val26_integration_report(songs).count() == 39
    assert shuffled() - before - once < 5 * once
