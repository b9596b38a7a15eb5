"""Connected components by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recollect.llm._session import cut


#: Edges, by both directions, whose components one task finds; rows of a frame of labels.
FEW, LABELLED = 1 << 23, 1 << 16


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all edges (src, dst) with the smallest node of their component."""
    sides = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if not sides:
        return
    src, dst = (np.concatenate(side) for side in zip(*sides))
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    i, j = at[: len(src)], at[len(src) :]
    label = np.arange(len(nodes))
    while (label[i] != label[j]).any():
        x, y = label[i], label[j]
        # Each root takes the least root that an edge tells it of, then all nodes their root.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    for lo in range(0, len(nodes), LABELLED):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo : lo + LABELLED]), pa.array(nodes[label[lo : lo + LABELLED]])], ["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (src, dst); component: the smallest node reachable.

    Each round takes the least label of the neighbours, then the label's own label, so rounds grow
    as the logarithm of the longest path in practice. Labels stay in checkpoints, none on the driver: they
    grow with the input, so no round broadcasts them, and what a round changes is counted while it is written.
    Of up to FEW edges one task finds the components. Nodes are integers.
    """
    ways, size = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))), Observation()
    both = cut(edges.select(F.inline(ways)).distinct().observe(size, F.count(F.lit(1)).alias("n")))
    if size.get["n"] <= FEW:
        return cut(both.where("src < dst").coalesce(1).mapInArrow(_labelled, "node long, component long"))
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least("node", F.min("dst")).alias("component")))
    while True:
        told = both.join(labels.hint("merge"), F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("least"))
        step = labels.join(told.hint("merge"), F.col("node") == F.col("src")).select("node", F.col("component").alias("was"), F.least("component", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        new = step.join(jump.hint("merge"), "next").select("node", "was", F.least("next", "further").alias("component"))
        round_ = Observation()
        labels = cut(new.observe(round_, F.count_if(F.col("was") != F.col("component")).alias("changed")).select("node", "component"))
        if not round_.get["changed"]:
            return labels
