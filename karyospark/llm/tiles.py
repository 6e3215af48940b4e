"""Query vectors against all vectors, tile by tile, on a grid of tasks.

Queries are dealt to blocks of at most ``QUERY_ROWS``, vectors to chunks by a
hash of their id, and every pair of block and chunk is one piece of work: its
queries come first, then the chunk's vectors stream past in order of their ids.
A task holds a block of queries, their heaps and one tile; every query leaves
the few best of each chunk, and Spark merges those.  Each query is sent to all
chunks and each vector to all blocks; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karyospark.operators.lineage import cut

#: Queries that one task holds; rows of queries and of vectors in one tile.
QUERY_ROWS, TILE_QUERIES, TILE_ROWS = 32_768, 1024, 2048
#: Vectors of a chunk at least, on average: fewer leave more heaps than they save time.
CHUNK_ROWS = 512
#: Strassen's recursion ends where a side is at most this long.
LEAF = 32
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def sound(rows: DataFrame) -> DataFrame:
    """Rows with an id and a vector without null and non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(~bad, F.lit(False)))


def floors(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of doubles; what 64 bits cannot hold is the nearest number that they can."""
    x = np.floor(values.astype(np.float64) * scale)
    high, low = x >= 2.0**63, x < -(2.0**63)
    out = np.where(high | low, 0.0, x).astype(np.int64)
    out[high], out[low] = HIGHEST, LOWEST
    return out


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """A list column as integer rows, shorter ones padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = floors(column.flatten().to_numpy(zero_copy_only=False), scale)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def largest_product(a: np.ndarray, b: np.ndarray) -> float:
    """A bound on the size of every sum that the product of the two forms."""
    size = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0.0))
    return size(a) * size(b) * a.shape[1]


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``: in doubles where those hold every sum exactly, else in integers modulo 2^64."""
    if largest_product(a, b) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of int64 matrices by seven half-size products; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return _leaf(a, b)
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    m, k, n = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    out = np.empty((2 * m, 2 * n), np.int64)
    p = strassen(a11 + a22, b11 + b22)
    out[:m, :n], out[m:, n:] = p, p
    p = strassen(a21 + a22, b11)
    out[m:, :n] = p
    out[m:, n:] -= p
    p = strassen(a11, b12 - b22)
    out[:m, n:] = p
    out[m:, n:] += p
    p = strassen(a22, b21 - b11)
    out[:m, :n] += p
    out[m:, :n] += p
    p = strassen(a11 + a12, b22)
    out[:m, :n] -= p
    out[:m, n:] += p
    out[m:, n:] += strassen(a21 - a11, b11 + b12)
    out[:m, :n] += strassen(a12 - a22, b21 + b22)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``; missing components are zeros."""
    width = min(a.shape[1], b.shape[1])
    return strassen(a[:, :width], b[:, :width].T)


class Heaps:
    """The ``k`` best entries of each of ``n`` rows: higher scores first, ties by smaller ids; ``extra`` goes with an entry."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), LOWEST), np.full((n, k), HIGHEST)
        self.full, self.extra = np.zeros((n, k), bool), np.zeros((n, k), np.int64)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Entries ``scores[i, j]`` of row ``rows[i]`` and id ``ids[j]`` (rising), where ``valid``."""
        worst, worst_id = self.score[rows, -1:], self.id[rows, -1:]
        hits = valid & (~self.full[rows, -1:] | (scores > worst) | ((scores == worst) & (ids < worst_id)))
        if np.count_nonzero(hits) > 4 * self.k * len(rows):
            hits = _first(scores, hits, self.k)
        i, j = np.nonzero(hits)
        if not len(i):
            return
        met = rows[np.unique(i)]
        row = np.concatenate([rows[i], np.repeat(met, self.k)])
        score = np.concatenate([scores[i, j], self.score[met].ravel()])
        name = np.concatenate([ids[j], self.id[met].ravel()])
        more = np.concatenate([np.zeros(len(i), np.int64) if extra is None else extra[i, j], self.extra[met].ravel()])
        there = np.concatenate([np.ones(len(i), bool), self.full[met].ravel()])
        order = np.lexsort((name, ~score, ~there, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept, order = place < self.k, order[place < self.k]
        at = row[kept], place[kept]
        self.score[at], self.id[at], self.extra[at], self.full[at] = score[order], name[order], more[order], there[order]


def _first(scores: np.ndarray, hits: np.ndarray, k: int) -> np.ndarray:
    """Of each row's ``hits`` the first ``k`` by score, ties from the left."""
    if scores.shape[1] <= k:
        return hits
    held = np.where(hits, scores, LOWEST)
    least = np.partition(held, -k, axis=1)[:, -k, None]
    above = hits & (held > least)
    ties = hits & (held == least)
    return above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True)))


class Worker(Protocol):
    """Built from the rows of a block's queries; takes tiles of vectors, then says what it kept."""

    def take(self, rows: pa.RecordBatch) -> None: ...

    def results(self) -> Iterator[pa.RecordBatch]: ...


def numbered(queries: DataFrame) -> DataFrame:
    """``queries`` without repeated rows, written, with a number ``no`` and a block."""
    rows = cut(queries.distinct()).withColumn("no", F.monotonically_increasing_id())  # stable: the rows are written
    blocks = max(1, -(-rows.count() // QUERY_ROWS))
    return cut(rows.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int")))


def against_all(queries: DataFrame, rows: DataFrame, make: Callable[[pa.RecordBatch], Worker], schema: str) -> DataFrame:
    """What a worker for each block of ``queries(no, block, ...)`` and each chunk of ``rows(vec_id, ...)`` leaves.

    Columns that only one side has are null on the other.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (queries.agg(F.max("block")).first()[0] or 0) + 1
    chunks = max(1, min(-(-2 * parts // blocks), rows.count() // CHUNK_ROWS))
    key = lambda block, chunk: (block.cast("bigint") * chunks + chunk).alias("key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ask = queries.withColumn("_chunk", every(chunks)).select(key(F.col("block"), F.col("_chunk")), F.lit(0).alias("side"), *[c for c in queries.columns if c != "block"])
    meet = rows.withColumn("_block", every(blocks)).select(key(F.col("_block"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks))), F.lit(1).alias("side"), *rows.columns)
    both = ask.unionByName(meet, allowMissingColumns=True)
    return both.repartition(parts, "key").sortWithinPartitions("key", "side", "vec_id").mapInArrow(_walk(make), schema)


def _walk(make: Callable[[pa.RecordBatch], Worker]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, worker = None, [], None
        for batch in batches:
            key, side = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "side"))
            edges = np.flatnonzero(np.diff(key * 2 + side)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                if lo == hi:
                    continue
                if key[lo] != current:
                    if worker is not None:
                        yield from worker.results()
                    current, held, worker = key[lo], [], None
                part = batch.slice(lo, hi - lo)
                if not side[lo]:
                    held.append(part)
                    continue
                if worker is None and held:
                    worker, held = make(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                for at in range(0, part.num_rows if worker is not None else 0, TILE_ROWS):
                    worker.take(part.slice(at, TILE_ROWS))
        if worker is not None:
            yield from worker.results()

    return run


def query_tiles(n: int) -> Iterator[slice]:
    for lo in range(0, n, TILE_QUERIES):
        yield slice(lo, min(n, lo + TILE_QUERIES))


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def first_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of each key over all chunks with their ``rank``: higher scores, then smaller ids; a map-side limit comes first."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
