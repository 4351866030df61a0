"""Connected components of a link table, as joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import checkpoint


def components(links: DataFrame, a: str, b: str, rounds: int | None = None) -> DataFrame:
    """node, root for each node that has a link; root is the smallest node that it reaches.

    links: columns a and b of one ordered type, not null, in either direction, repeats allowed. Each round a node and
    its present root take the smallest root of the node's neighbours, then every node the root of its root; it ends when
    no root changes. Chains shrink by a factor each round, so rounds grow with the logarithm of their length. Joins
    read checkpointed tables, so Spark can split a root that a large part of the nodes share; what roots take is
    aggregated before. A node's links must be bounded by the caller for the first join to be even.
    After the given rounds, if any, it ends before: nodes of one root are connected then, but not the reverse.
    """
    one_way = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = checkpoint(one_way.union(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpoint(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "node"))
    done = 0
    while True:
        done += 1
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("root").alias("near"))
        seen = checkpoint(labels.join(near, labels.node == near.u).select("node", "root", "near"))
        hooks = seen.where("near < root").groupBy(F.col("root").alias("at")).agg(F.min("near").alias("hook"))
        hooked = checkpoint(seen.join(hooks, seen.node == hooks.at, "left").select("node", F.least("root", "near", "hook").alias("new"), "root"))
        jump = hooked.select(F.col("node").alias("at"), F.col("new").alias("jumped"))
        jumped = checkpoint(hooked.join(jump, hooked.new == jump.at).select("node", F.least("new", "jumped").alias("new"), "root"))
        labels = jumped.select("node", F.col("new").alias("root"))
        if done == rounds or jumped.where("new <> root").isEmpty():
            return labels
