"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_kept, keep


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (a, b: long); the label is the least node reachable.

    Large-star and small-star rounds (Kiveris et al. 2014): each round is two aggregations and joins
    on the edges, written to the shared folder, until nothing changes. A hub's edges are reduced by
    a partial minimum; its join is on plain columns, which adaptive execution splits. No edge or
    component passes through the driver. Self loops and nulls are ignored.
    """
    now = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = keep(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        after = keep(small.where("u <> v").distinct(), "edges")
        drop_kept(now)
        drop_kept(large)
        now = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
