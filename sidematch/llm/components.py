"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidematch.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (``u, v``): the smallest node it can reach.

    A round gives each node the smallest label around it, then the label of that label;
    paths shorten by half or more each time.  Labels are stored after each round.
    """
    both = materialize(links.select("u", "v").union(links.select("v", "u")).where("u <> v").distinct())
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_m")).select(
        "node", F.least("node", "_m").alias("label"), F.lit(True).alias("_moved")))
    while labels.where("_moved").limit(1).count():
        now = labels.select("node", "label")
        around = both.join(now.toDF("v", "_l"), "v").groupBy("u").agg(F.min("_l").alias("_l"))
        least = now.join(around.toDF("node", "_l"), "node").select(
            "node", F.col("label").alias("_old"), F.least("label", "_l").alias("_near"))
        labels = materialize(
            least.join(now.toDF("_near", "_far"), "_near").select(
                "node", F.col("_far").alias("label"), (F.col("_far") != F.col("_old")).alias("_moved")))
    return labels.select("node", "label")
