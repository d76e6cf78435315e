"""Connected components over edge tables of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenforge.plans.lineage import discard, materialize
from lumenforge.plans.skew import join_groups


CHUNK = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges and the smallest that they connect it to, where that is another: fewer edges of the same components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at, 2)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        low = np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(label, end, low)
        label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _stars(batches):
    """Edges of whole numbers to edges from each node to the smallest that a chunk of them connects it to."""

    def contract(tables):
        ends = stars(*(np.concatenate([t.column(i).to_numpy() for t in tables]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield contract(held)
            held, size = [], 0
    if size:
        yield contract(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node is connected to.

    Each round every node takes the smallest label among its neighbours (minima combined map-side, so
    a hub is one row per task) and then the label of its label, which halves paths. Hubs with more than a thousandth of all edges meet
    them by broadcast, as do the roots of components with more than a thousandth of all nodes (``join_groups``). A round's labels
    are written to the shared folder and those of the round before deleted; the loop ends when none
    changed. Null ends and loops are ignored, repeated edges count once, an empty table gives no rows.
    Nodes are of any type that sorts; edges of whole numbers shrink to stars in each task before they meet.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    if dict(pairs.dtypes)["a"] == dict(pairs.dtypes)["b"] == "bigint":
        pairs = pairs.mapInArrow(_stars, "a long, b long")
    both = materialize(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"), F.count(F.lit(1)).alias("degree")), "cc-labels")
    edges = both.count()
    nodes = labels.count()
    while True:
        hubs = labels.select(F.col("node").alias("b"), "component", "degree")
        near = join_groups(both, hubs, ["b"], "degree", edges).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "degree", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        step = materialize(step, "cc-step")
        sizes = step.groupBy("now").agg(F.count(F.lit(1)).alias("size"))
        roots = materialize(sizes.join(step.select(F.col("node").alias("now"), F.col("now").alias("label")), "now"), "cc-roots")
        jumped = join_groups(step, roots, ["now"], "size", nodes).select("node", "degree", F.col("label").alias("component"), (F.col("label") != F.col("was")).alias("changed"))
        jumped = materialize(jumped, "cc-labels")
        discard(labels, step, roots)
        if jumped.filter("changed").isEmpty():
            discard(both)
            return jumped.select("node", "component")
        labels = jumped.drop("changed")
        labels._shared_path = jumped._shared_path
