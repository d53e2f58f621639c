"""Connected components of a distributed graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for nodes that are not smallest themselves."""
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = index[: len(u)], index[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def contract(edges: DataFrame) -> DataFrame:
    """Replace the edges of each batch of a partition by stars with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = _roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node of each node's component, for nodes with edges other than the smallest.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until
    nothing changes; minima combine before they are shuffled. Edges of a batch
    are first contracted to stars. Nothing is gathered on the driver but counts.
    """
    spark = edges.sparkSession
    arrow_ready(spark, 200_000)
    ordered = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = scratch.cut(contract(ordered.distinct()), "edges")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            arrow_ready(spark)
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._scratch_path = e._scratch_path
            return out
        mark, before = tuple(now), e
        star = _small_star(_large_star(e).distinct()).distinct()
        e = scratch.cut(star, "edges")
        scratch.drop(before)
