"""Connected components of an edge table by local contraction and alternating star steps.

Edges are dealt by ranges of their lesser node.  Each task replaces the edges
of a stretch by one from every node to the least node that the stretch reaches
from it.  Large-star and small-star steps settle what is left: each is a
min-aggregation (combined before the shuffle) and an equi-join whose hot keys
adaptive execution may split, so no node's neighbourhood is ever gathered in
one place.  Labels are the least node of each component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Edges that a task contracts at once.
STRETCH = 1 << 20


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that some edge touches; ``root`` is the least node reachable.

    Nulls on either end and self loops add nothing.  An empty table gives an
    empty result.  Steps go on until the labels have settled.
    """
    return settled_components(edges, a, b)[0]


def settled_components(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, int]:
    """``connected_components``, and the rounds of star steps that it took."""
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    star, mark = _settle(_contracted(cut(pairs)))
    rounds = 0
    while mark[0]:
        before, rounds = mark, rounds + 1
        star, mark = _settle(_small_star(_large_star(star)))
        if mark == before:
            break
    root = F.col("y")
    return star.select(F.col("x").alias("node"), root.alias("root")).unionByName(star.select(root.alias("node"), root.alias("root")).distinct()), rounds


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes, the least node that pairs (i, j) reach from each: roots hook to lesser ones, and chains halve."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _contracted(pairs: DataFrame) -> DataFrame:
    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[ends.indices.to_numpy()]
        label = least_labels(len(order), *np.split(at, 2))
        moved = np.flatnonzero(label != np.arange(len(order)))
        nodes = ends.dictionary.take(pa.array(order))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))], ["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= STRETCH:
                yield star(held)
                held, rows = [], 0
        if held:
            yield star(held)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartitionByRange(parts, "y", "x").sortWithinPartitions("y", "x").mapInArrow(run, pairs.schema).distinct()


def _settle(star: DataFrame) -> tuple[DataFrame, tuple]:
    star = cut(star)
    seen = star.agg(
        F.count(F.lit(1)),
        F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")),
    ).first()
    return star, (seen[0], seen[1])


def _large_star(star: DataFrame) -> DataFrame:
    both = star.unionByName(star.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()


def _small_star(star: DataFrame) -> DataFrame:
    least = star.groupBy("x").agg(F.min("y").alias("m"))
    moved = star.join(least, "x").where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(least.withColumnRenamed("m", "y")).distinct()
