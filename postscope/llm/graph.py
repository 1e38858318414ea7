"""Connected components of a table of links, by label propagation with shortcuts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) -> (node, label): the smallest node of each component.

    Every round takes the least label among the neighbours (a partial
    aggregate, so a node with very many links is summed map-side) and then
    follows the label's own label, which halves the distance to the root.  Each
    round's labels are stored, so lineage stays short.  Nodes without a link do
    not appear.  Ends when no label changes.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m")))
        low = (labels.join(near, labels["node"] == near["a"], "left")
               .select("node", "label", F.least("label", F.coalesce("m", "label")).alias("low")))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        step = staged(low.join(up, "low", "left").select(
            "node", "label", F.least("low", F.coalesce("above", "low")).alias("next")), "labels")
        done = step.filter("label <> next").limit(1).count() == 0
        labels = step.select("node", F.col("next").alias("label"))
        if done:
            return labels
    raise RuntimeError("components did not settle")


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of ``a[i]`` and ``b[i]`` in place; roots are smallest members."""
    while len(a):
        a, b = settled(root, a), settled(root, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def settled(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of ``x``."""
    x = root[x]
    while True:
        up = root[x]
        if (up == x).all():
            return x
        x = up
