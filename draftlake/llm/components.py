"""Connected components of a link table, as DataFrame rounds with each round's labels written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Links that one task joins before the rounds, and nodes that it holds for that.
TASK_LINKS, TASK_NODES = 1_000_000, 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each component's smallest node to its others."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    other = root != np.arange(len(names))
    return names[root[other]], names[other]


def joined(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components, at most one a node from each task, however many a group has."""

    def run(batches):
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = 0
        for t in batches:
            a, b = np.concatenate((a, t.column(0).to_numpy())), np.concatenate((b, t.column(1).to_numpy()))
            if len(a) >= 2 * held + TASK_NODES // 4:
                a, b = stars(a, b)
                held = len(a)
                if held >= TASK_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a, b, held = a[:0], b[:0], 0
        a, b = stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of links (a, b).

    What each task's links join is joined first, so that the rounds work on at most one link a node and task. Each round
    a node takes the smallest label among its neighbours' and its own, then its label's label; labels fall until none
    changes. Nulls and self-links add nothing. A round's labels are removed once the next round's exist.
    """
    found = written(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "links")
    some = joined(found.coalesce(max(1, -(-found.count() // TASK_LINKS))))
    once = written(some, "links")
    both = written(once.union(once.select("b", "a")).toDF("node", "other").distinct(), "links")
    discard(found, once)
    step = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        labels = step.select("node", "component")
        seen = both.join(labels.toDF("other", "theirs"), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "theirs").alias("near"))
        far = labels.toDF("near", "far")
        after = written(near.join(far, "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("component")), "labels")
        discard(step)
        step = after
        if step.where("component <> old").isEmpty():
            discard(both)
            return step.select("node", "component")
