"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c are sqrt(2 - 2c) apart.  A fixed rotation spreads a
vector's length over all axes, which are split into blocks of a few dimensions;
a pair within the distance is, in some block, within the block's share of the
squared distance (proportional to its dimensions).  Each block is range-joined
on a grid: cells three radii wide over the first axes, a vector standing in its
own cell and, where it lies within a radius of the upper wall, in the next one;
a pair is taken in the one cell that is the greater of both homes on each axis.
The union of the blocks' pairs is verified by exact cosines in double precision.

Equal vectors of a label are one node with a count, so copies are never paired.
A cell with more than ``CELL_ROWS`` vectors is cut into chunks, and each pair
of chunks is a group of its own: every pair is still compared, in bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.operators.components import connected_components
from karyospark.operators.lineage import cut

from .bits import mix
from .grouped import key_groups, pairs_by_offset

BLOCK_DIMS = 8
GRID_DIMS = 5
CELL_RADII = 3.0
CELL_ROWS = 4096
SCHEMA = "key bigint, cid bigint, bump int, side int, at array<float>, other bigint"


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _arrow(key, cid, bump, side, at, other) -> pa.RecordBatch:
    n = len(key)
    at = np.ascontiguousarray(at, np.float32).reshape(n, -1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(cid), pa.array(bump, pa.int32()), pa.array(side, pa.int32()), lists, pa.array(other)], ["key", "cid", "bump", "side", "at", "other"]
    )


def _cells(threshold: float):
    """Rows of a block's cells, with the block's coordinates, for ``(cid, label, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            cids = batch.column("cid").to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            for dims in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dims)
                x = flat[starts[rows][:, None] + np.arange(dims)]
                x /= np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                x = x @ turn.setdefault(dims, rotation(dims))
                for b, axes in enumerate(np.array_split(np.arange(dims), -(-dims // BLOCK_DIMS))):
                    y = x[:, axes].astype(np.float32)
                    radius = np.sqrt(2 * (1 - threshold) * len(axes) / dims) + 1e-6
                    g = min(GRID_DIMS, len(axes))
                    scaled = y[:, :g].astype(np.float64) / (CELL_RADII * radius)
                    home = np.floor(scaled).astype(np.int64)
                    near_wall = home + 1 - scaled <= 1 / CELL_RADII + 1e-6
                    for bump in product((0, 1), repeat=g):
                        up = np.array(bump, bool)
                        at = np.flatnonzero(near_wall[:, up].all(1))
                        if not len(at):
                            continue
                        key = mix(labels[rows[at]].view(np.uint64), dims * 1024 + b)
                        for axis in range(g):
                            key = mix(key ^ (home[at, axis] + bump[axis]).view(np.uint64), axis)
                        code = sum(u << k for k, u in enumerate(bump))
                        coords = np.zeros((len(at), BLOCK_DIMS + 1), np.float32)
                        coords[:, : len(axes)], coords[:, -1] = y[at], radius * radius
                        yield _arrow(key.view(np.int64), cids[rows[at]], np.full(len(at), code), np.zeros(len(at)), coords, np.full(len(at), -1, np.int64))

    return run


def _within(key: np.ndarray, bump: np.ndarray, side: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of one cell within their block's budget, each taken in one cell and one pair of chunks only."""
    for i, j in pairs_by_offset(key):
        fits = (bump[i] & bump[j] == 0) & np.isin(side[i] + side[j], (0, 3))
        i, j = i[fits], j[fits]
        near = ((at[i, :-1] - at[j, :-1]) ** 2).sum(1) <= at[i, -1] + 1e-6
        if near.any():
            yield i[near], j[near]


def _range_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within their block's budget; rows of crowded cells pass through with ``other`` -1."""
    for crowded, (key, cid, bump, side, at, other) in key_groups(batches, CELL_ROWS):
        if crowded:
            yield _arrow(key, cid, bump, side, at, other)
            continue
        for i, j in _within(key, bump, side, at):
            none = np.zeros(len(i))
            yield _arrow(key[i], np.minimum(cid[i], cid[j]), none, none, at[i, :0], np.maximum(cid[i], cid[j]))


def _exact(threshold: float):
    @F.pandas_udf("boolean")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            a, b = (np.stack(x.to_list()).astype(np.float64) if len(x) else np.zeros((0, 1)) for x in (left, right))
            a, b = a / np.abs(a).max(1, keepdims=True, initial=1e-300), b / np.abs(b).max(1, keepdims=True, initial=1e-300)
            cos = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
            yield pd.Series(cos >= threshold, index=left.index)

    return udf


def candidate_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Distinct ``(a, b)`` with a < b of ``nodes(cid, label, v)`` that some block's range join finds."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_range_pairs, SCHEMA)
    first = cut(dealt(nodes.mapInArrow(_cells(threshold), SCHEMA)))
    found = first.where("other >= 0").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    crowded = first.where("other < 0")
    if not crowded.isEmpty():
        chunks = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (CELL_ROWS // 2)).cast("int").alias("n"))
        one = crowded.join(chunks, "key").withColumn("c", F.pmod(F.xxhash64("cid"), "n").cast("int"))
        # half a cell's limit a chunk on average; a chunk a little over it still makes a group under the limit
        two = one.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        side = F.when(F.col("c") == F.col("d"), 0).when(F.col("c") < F.col("d"), 1).otherwise(2)
        key = F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d"))
        again = two.select(key.alias("key"), "cid", "bump", side.cast("int").alias("side"), "at", "other")
        found = found.unionByName(_all_pairs(again, parts))
    return found.distinct()


def _all_pairs(rows: DataFrame, parts: int) -> DataFrame:
    """As before for groups that are known to be small."""

    def run(batches):
        for _, cols in key_groups(batches, 1 << 40):
            key, cid, bump, side, at, _ = cols
            for i, j in _within(key, bump, side, at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(cid[i], cid[j])), pa.array(np.maximum(cid[i], cid[j]))], ["a", "b"])

    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def embedding_links(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label, ...)``.

    Rows link where labels are equal and not null, lengths are equal and the
    cosine in double precision is at least ``threshold``.  Null, empty and zero
    vectors and such with null or non-finite components link with nothing.
    ``n_links`` counts other rows, repeated rows among them; ``component_id`` is
    the least ``vec_id`` that links reach; a row that links with nothing is its
    own component.  An empty table gives no rows; other columns are ignored.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    sound = F.col("label").isNotNull() & F.coalesce(~bad & some, F.lit(False))
    zero = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0.0 is 0.0
    rows = vectors.select("vec_id", F.when(sound, F.struct(F.col("label").cast("bigint").alias("label"), zero.alias("v"))).alias("node"))
    rows = rows.withColumn("h1", F.when(F.col("node").isNotNull(), F.xxhash64("node"))).withColumn("h2", F.xxhash64(F.lit(2), "node"))
    nodes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("node").alias("node"))
    nodes = cut(nodes.select("h1", "h2", "n", "least", "node.label", "node.v")).withColumn("cid", F.monotonically_increasing_id())  # stable: the rows are written
    pairs = candidate_pairs(nodes.select("cid", "label", "v"), threshold)
    a, b = (nodes.select(F.col("cid").alias(k), F.col("n").alias(f"n_{k}"), F.col("v").alias(f"v_{k}")) for k in "ab")
    links = cut(pairs.join(a, "a").join(b, "b").where(_exact(threshold)("v_a", "v_b")).select("a", "b", "n_a", "n_b"))
    ends = links.select(F.col("a").alias("cid"), F.col("n_b").alias("m")).unionByName(links.select(F.col("b").alias("cid"), F.col("n_a").alias("m")))
    degrees = ends.groupBy("cid").agg(F.sum("m").alias("m"))
    roots = connected_components(links).withColumnRenamed("node", "cid")
    known = nodes.join(degrees, "cid", "left").join(roots, "cid", "left").select("h1", "h2", "least", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    known = cut(known)
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(names, "root").select("h1", "h2", "n_links", "component_id")
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_subspace_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


QUERIES = {"op4_subspace_embedding_links": op4_subspace_embedding_links}
ORACLES: dict[str, str] = {}
