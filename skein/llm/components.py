"""Connected components of a link table, with neither links nor components on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

ONE_TASK = 1 << 17


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, comp of a few links, by union-find."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = parent[up]
            v = up
        return v

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)  # so that a root is the smallest of its component
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(v) for v in nodes], pa.int64())], ["node", "comp"])


def components(links: DataFrame, *, one_task: int = ONE_TASK) -> DataFrame:
    """links: a, b (long). Returns node, comp: the smallest node reachable. Nodes without links are absent.

    Up to `one_task` links are joined in one task. Beyond that, each round takes the smallest label among a node and its
    neighbours, then follows labels once more, so that long chains shorten by half; labels are staged tables, so a lost
    executor costs one round at most. Minima are taken with partial sums before the shuffle, so hubs are no burden to one
    task. Links of a node with itself and links with a null end join nothing; repeated ones count once; an empty table
    gives no rows.
    """
    links = staged(links.where("a <> b").select("a", "b"), "links")
    if links.count() <= one_task:
        out = staged(links.coalesce(1).mapInArrow(joined, "node long, comp long"), "labels")
        unstage(links)
        return out
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = staged(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = staged(lower, "step")
        further = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = staged(step.join(further, "comp", "left").select("node", "old", F.least("comp", "next").alias("comp")), "labels")
        changed = new.where("old <> comp").limit(1).count()
        unstage(step)
        unstage(labels)
        labels = new.select("node", "comp")
        labels.staged_path = new.staged_path
        if not changed:
            unstage(links)
            return labels
