"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fedsql.session import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node each node is linked to, directly or not; one row for each node of links.

    Each round, a node takes the least label around it and then that label's own label, so a chain of n links
    takes about log n rounds.  Rounds are checkpointed in the shared folder.  Self-links and nulls are ignored.
    """
    plain = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    both = checkpointed(plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component"))
    labels = checkpointed(labels)
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("least"))
        taken = labels.join(around, labels["node"] == around["a"]).select("node", "component", F.least("component", "least").alias("new"))
        own = labels.select(F.col("node").alias("of"), F.col("component").alias("jump"))
        after = checkpointed(taken.join(own, taken["new"] == own["of"], "left").select("node", "component", F.least("new", F.coalesce("jump", "new")).alias("new")))
        done = after.filter("component <> new").limit(1).count() == 0
        labels = after.select("node", F.col("new").alias("component"))
        if done:
            return labels
