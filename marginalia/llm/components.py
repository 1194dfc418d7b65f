"""Connected components by alternating star contractions, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()


def smallest_reachable(edges: DataFrame, work: Work, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (x, y) links that is not itself the smallest of its component.

    A large-star step links each node's larger neighbours to its smallest one, a small-star step its
    smaller neighbours; both keep the components.  The rounds end when every component is a star,
    which both steps leave as it is.  No link or label is brought to the driver but two sums.
    """
    now = work.put(_oriented(edges), "stars-0")
    seen = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = work.put(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), f"least-{k}")
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = work.put(_oriented(large), f"large-{k}")
        lowest = work.put(large.groupBy("x").agg(F.min("y").alias("m")), f"lowest-{k}")
        small = large.join(lowest, "x").select("y", "m").union(lowest.select(F.col("x").alias("y"), "m"))
        after = work.put(_oriented(small.select(F.col("y").alias("x"), F.col("m").alias("y"))), f"stars-{k}")
        told = after.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        work.drop(f"least-{k}", f"large-{k}", f"lowest-{k}", f"stars-{k - 1}")
        now = after
        if tuple(told) == seen:
            break
        seen = tuple(told)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("x").alias("node"), F.col("y").alias("component"))
