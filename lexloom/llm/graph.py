"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: u, v. Ties each node's neighbours to the least of them and itself."""
    if large:
        near = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(pairs: DataFrame, name: str = "components") -> DataFrame:
    """pairs: u, v of one ordered type, without nulls. Returns node, root: root is the least node it is tied to.

    Only nodes of some pair have a row. Each round is written to the shared
    folder; it ends when a round changes nothing.
    """
    now = materialise(pairs.select("u", "v").filter("u <> v").distinct(), name)
    mark = None
    while True:  # rounds grow with the logarithm of the pairs
        now = materialise(_star(_star(now, True), False), name)
        # Equal counts and hash sums of the pairs: the same pairs.
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
