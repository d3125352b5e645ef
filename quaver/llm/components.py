"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import Scratch, small

BROADCAST_ROWS = 200_000


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of all nodes of ``edges`` (a, b); comp is the least node that can be reached.

    Each round gives a node the least of its own label, its neighbours' labels and its label's label, so the
    number of rounds grows with the logarithm of the longest path in the usual case. Every round is written
    to the shared folder; neighbours' labels are combined before the shuffle, so a hub is no hot key.
    """
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), f"{name}-0")
    k = 0
    while True:
        k += 1
        of = small(labels, BROADCAST_ROWS)
        near = both.join(of.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        up = of.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        step = labels.join(near, "node").join(up, "comp").select("node", F.col("comp").alias("was"), F.least("comp", "other", "top").alias("comp"))
        step = scratch.table(step, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = step.select("node", "comp")
        if not step.filter("was <> comp").limit(1).count():
            scratch.drop(f"{name}-edges")
            return labels
