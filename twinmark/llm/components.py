"""Connected components of a graph given as edges.

As long as more edges are left than one task takes, rounds of joins shrink the graph: every node hooks
onto its smallest neighbour, hooks are followed to their ends, and edges move to what their ends became.
Each round at least halves the nodes that still have edges. What is left is contracted in one task, whose
memory is bounded by EDGES. Nothing is collected, and every table is cut from its lineage in the shared
folder; both sides of every join are plain exchanges, which Spark splits where one component holds a third
of the nodes. A label is the component's smallest node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinmark.llm.common import cut, ship

EDGES = 1_000_000


def smallest_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each of n nodes' components, by rounds of hooking and jumping over whole arrays."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        live = la != lb
        if not live.any():
            return label
        a, b, la, lb = a[live], b[live], la[live], lb[live]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    n = t.num_rows
    both = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[both.indices.to_numpy()]
    nodes = both.dictionary.take(order)
    yield pa.record_batch([nodes, nodes.take(pa.array(smallest_labels(code[:n], code[n:], len(nodes))))], ["node", "label"])


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, label for all nodes of edges (a, b), of any sortable type. most: edges that one task takes."""
    spark, most = edges.sparkSession, EDGES if most is None else most
    ship(spark)
    kind = edges.schema["a"].dataType.simpleString()
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while edges.count() > most:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("b")).select("root", F.least("root", "b").alias("to")))
        while True:  # each look doubles the steps followed
            nxt = hooks.select(F.col("root").alias("to"), F.col("to").alias("further"))
            seen = cut(hooks.join(nxt, "to").select("root", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
            hooks = seen.drop("moved")
            if not seen.where("moved").take(1):
                break
        if labels is None:
            labels = hooks.select(F.col("root").alias("node"), F.col("to").alias("label"))
        else:
            labels = cut(labels.join(hooks.withColumnRenamed("root", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        at = lambda end: hooks.select(F.col("root").alias(end), F.col("to").alias(f"to_{end}"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        edges = cut(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    last = edges.coalesce(1).mapInArrow(_contract, f"node {kind}, label {kind}")
    if labels is None:
        return cut(last)
    return cut(labels.join(last.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
