"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resona.llm.tables import cut


#: edges up to which a round runs as one task
FEW = 500_000


def components(edges: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); the component is its smallest node.

    Each round connects neighbours to the smallest neighbour, so stars form in
    about log(longest path) rounds. Only the edge table moves; a hub's edges are
    reduced with a partial minimum and joined back, where adaptive execution
    splits a large hub. A round's edges are cut to the shared checkpoint folder.
    Up to ``few`` edges a round is one task that broadcasts its minima; the result is the same.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    small = edges.count() <= few
    edges = edges.coalesce(1) if small else edges
    fold = (lambda df: df.coalesce(1)) if small else (lambda df: df)
    side = F.broadcast if small else (lambda df: df)  # at most twice ``few`` rows
    state = None
    for _ in range(most_rounds):
        both = fold(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(side(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = cut(fold(moved.union(least.select("a", F.col("m").alias("b")))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
