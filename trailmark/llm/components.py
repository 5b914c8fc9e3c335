"""Connected components of a link table by alternating min-label steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trailmark.llm.shared import drop_stage, stage


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node -> label (the least node of its component) of links(a, b).

    Large-star and small-star steps: edges are re-hung under the least node
    seen, which keeps their number and ends after a logarithmic number of
    rounds. A hub's edges are aggregated (min) before they meet, never listed.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node hang under the least node near it
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "links-large")
        # small star: a node and its smaller neighbours hang under the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        small = stage(small, "links-small")
        drop_stage(large)
        now = tuple(small.select(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0])
        drop_stage(edges)
        edges = small
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
