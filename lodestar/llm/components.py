"""Connected components of a link table, by alternating large and small stars.

Each round maps every link to the smallest neighbour of its ends; stars of all
components stand after a few rounds. Minima combine before the shuffle, the
joins are plain equi-joins (a hub's links can be split), and every round is
written to the shared folder, so lineage stays short. The driver sees one count
and one checksum a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import materialise


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its part) that join the same nodes as the given ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(links: DataFrame) -> DataFrame:
    """Replace the links that lie together by fewer that join the same nodes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = spanning(batch.column("a").to_numpy(), batch.column("b").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links.mapInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b: long): the smallest node that it reaches.

    Repeated links, links in both directions and links of a node to itself are
    allowed; the latter name no node. No links give an empty result.
    """
    edges = materialise(_contract(links.select("a", "b").filter("a <> b").withColumns({"a": F.greatest("a", "b"), "b": F.least("a", "b")})).distinct())
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if seen == state or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()
        state = seen
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least)
        edges = materialise(small.distinct())
