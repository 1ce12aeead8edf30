"""Queries that must read their whole tables."""

from __future__ import annotations

from resona.plans import registry


def test_every_vector_asks_for_its_neighbours(spark, sf_dir):
    whole = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").distinct()
    found = registry.queries()["sim2_sim4_cosine_neighbours"](spark, sf_dir)
    assert found.groupBy("query").count().where("count = 5").count() == whole.count() > 100
