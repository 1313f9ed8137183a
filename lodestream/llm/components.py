"""Connected components of links between 64-bit node ids, by alternating large and small stars.

Every step is a minimum per node, which is pre-aggregated in each task, and a join that Spark may
split where a node has very many links; no node's links are gathered in one place. Each round's
links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop_kept, keep


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) in any order: one row (node, component) per node that has a link; the component is its smallest node."""
    links = keep(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = keep(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        small = keep(small, "links")
        for old in (links, large):
            drop_kept(old)
        links = small
        # no node has a link to a smaller and one to a larger node, and none has two smaller ones: every component is one star
        between = links.join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        if not between and not links.groupBy("u").count().where("count > 1").limit(1).count():
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
