"""Connected components by least labels, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import stash

HUB = 8192  #: edges of a node that meet in one place


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the edges (u, v): root is the least node that it is connected to.

    Each round takes the least label among a node and its neighbours and then that label's own label, so far ends meet in
    a number of rounds like the logarithm of the distance. Labels are summed before the shuffle. A hub's edges are dealt
    to parts, and its label is sent to each of them. The nodes that have one label meet one row of it, where adaptive
    execution splits them. Only whether there are changes comes to the driver.
    """
    pairs = edges.select("u", "v").where("u <> v")
    both = stash(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    nodes = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"), F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    labels = stash(nodes.select("node", F.least("node", "low").alias("root"), "parts"))
    hubs = labels.where("parts > 1").select(F.col("node").alias("v"), "parts")
    both = both.join(hubs, "v", "left").select("u", "v", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    while True:
        sent = labels.select(F.col("node").alias("v"), "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        near = both.join(sent, ["v", "part"]).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        step = labels.join(near, "node").select("node", "parts", F.col("root").alias("was"), F.least("root", "low").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("end"))
        after = stash(step.join(jump, "mid", "left").select("node", "parts", "was", F.least("mid", F.coalesce("end", "mid")).alias("root")))
        labels = after.select("node", "root", "parts")
        if after.where("was <> root").isEmpty():
            return labels.select("node", "root")
