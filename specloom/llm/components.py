"""Connected components of links, as joins: least labels with pointer jumping.

Cases: links to oneself, doubled links and both directions of one count once; null ends link nothing;
no links give no rows; a node without links is in none. A round joins every link to its end's label:
a hub's links are read by one key, so callers link a group to its first member and not pair by pair.
A round's tables are of as many partitions as the links need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Links to a task of a round, and the tasks that a round has at least: what a round writes follows the links, however many partitions a shuffle has.
TASK_LINKS, LEAST_TASKS = 100_000, 16


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the least node of the component.

    Each round takes the least label among a node's neighbours, then that label's own label, so
    rounds grow as the logarithm of a component's width. Labels are cut off from their lineage
    after each round by a checkpoint.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    tasks = LEAST_TASKS + both.count() // TASK_LINKS
    both = both.coalesce(tasks)
    labels = durable(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("root")).coalesce(tasks))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("_near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("root").alias("_far"))
        after = durable(least.join(jump, "_new", "left").select("node", F.col("root").alias("_old"), F.least("_new", "_far").alias("root")).coalesce(tasks))
        if after.where("_old <> root").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")
