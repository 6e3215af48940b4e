"""Exact top-k search by inner product with a three-phase uniform threshold.

The dimensions are cut into m blocks; a block's partial scores are one list for
each query, and a score is the sum over the lists.

1. Every chunk of vectors gathers the best of each list with their whole scores.
   The k-th best whole score that was met anywhere is a cutoff c that k vectors
   are known to reach.
2. The cutoff goes with its query to all chunks.  A sum over m lists that
   reaches c has a part of at least c / m, so the entries from that uniform
   threshold on are sufficient: other vectors are dropped unseen.  With parts
   below the threshold counted as just below it, a vector's bound follows, and
   those whose bound misses the cutoff go as well.
3. The parts that a remaining vector still misses are added exactly; what
   reaches the cutoff enters the query's heap, and heaps merge over chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiles as T

FOUND = "no bigint, vec_id bigint, score bigint"
LISTS = 4


class _Search:
    """Partial scores of a block's queries, list by list."""

    def __init__(self, queries: pa.RecordBatch, scale: float, k: int, lists: int):
        self.no, self.own = T.ints(queries, "no"), T.ints(queries, "vec_id")
        self.codes, self.scale, self.k, self.lists = T.matrix(queries.column("embedding"), scale), scale, k, lists

    def take(self, rows: pa.RecordBatch) -> None:
        ids, codes = T.ints(rows, "vec_id"), T.matrix(rows.column("embedding"), self.scale)
        axes = np.array_split(np.arange(min(self.codes.shape[1], codes.shape[1])), self.lists)
        for at in T.query_tiles(len(self.no)):
            parts = [T.scores(self.codes[at][:, a], codes[:, a]) for a in axes]
            # sums that 64 bits may not hold count modulo 2^64, and no part bounds them
            self.offer(at, parts, ids, self.own[at, None] != ids, T.largest_product(self.codes[at], codes) < 2.0**61)

    def offer(self, at: slice, parts: list[np.ndarray], ids: np.ndarray, others: np.ndarray, bounded: bool) -> None:
        raise NotImplementedError

    def _rows(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.no[row]), pa.array(ids), pa.array(scores)], ["no", "vec_id", "score"])


class _Gathered(_Search):
    """First phase: the best of each list; of all that were met, the best ``k`` by whole score leave."""

    def __init__(self, *args):
        super().__init__(*args)
        self.heaps = [T.Heaps(len(self.no), self.k) for _ in range(self.lists)]

    def offer(self, at, parts, ids, others, bounded):
        whole, rows = np.sum(parts, axis=0), np.arange(at.start, at.stop)
        for heaps, part in zip(self.heaps, parts, strict=True):
            heaps.offer(rows, part, ids, others, whole)

    def results(self) -> Iterator[pa.RecordBatch]:
        met = []
        for heaps in self.heaps:
            row, k = np.nonzero(heaps.full)
            met.append(np.stack([row, heaps.id[row, k], heaps.extra[row, k]], 1))
        met = np.unique(np.concatenate(met), axis=0)  # a vector may stand in several lists
        met = met[np.lexsort((met[:, 1], ~met[:, 2], met[:, 0]))]
        met = met[np.arange(len(met)) - np.searchsorted(met[:, 0], met[:, 0]) < self.k]
        yield self._rows(*met.T)


def sufficient(parts: list[np.ndarray], cutoff: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Which parts reach the uniform threshold, their sums, and for which vectors these leave the cutoff in reach."""
    least = cutoff // len(parts) + (cutoff % len(parts) > 0)
    seen = [p >= least for p in parts]
    known = sum(np.where(s, p, 0) for s, p in zip(seen, parts, strict=True))
    missing = len(parts) - np.sum(seen, axis=0)
    reach = (cutoff == T.LOWEST) | (known + missing * (least - 1) >= cutoff)
    return seen, known, reach & np.any(seen, axis=0)


class _Resolved(_Search):
    """Second and third phase, with each query's cutoff (null: fewer than ``k`` were met, so all vectors count)."""

    def __init__(self, queries: pa.RecordBatch, *args):
        super().__init__(queries, *args)
        self.cutoff = queries.column("cutoff").fill_null(T.LOWEST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.heaps = T.Heaps(len(self.no), self.k)

    def offer(self, at, parts, ids, others, bounded):
        cutoff = self.cutoff[at, None]
        seen, known, enough = sufficient(parts, cutoff) if bounded else ([np.ones(p.shape, bool) for p in parts], sum(parts), True)
        enough = enough & others
        i, j = np.nonzero(enough)
        score = known[i, j] + sum(np.where(s[i, j], 0, p[i, j]) for s, p in zip(seen, parts, strict=True))
        whole = np.full(known.shape, T.LOWEST)
        whole[i, j] = score
        self.heaps.offer(np.arange(at.start, at.stop), whole, ids, enough & (whole >= cutoff))

    def results(self) -> Iterator[pa.RecordBatch]:
        row, k = np.nonzero(self.heaps.full)
        yield self._rows(row, self.heaps.id[row, k], self.heaps.score[row, k])


def cutoffs(gathered: DataFrame, k: int) -> DataFrame:
    """``(no, cutoff)``: the ``k``-th best whole score of different vectors, for queries that met as many."""
    return T.first_rows(gathered.distinct(), ["no"], k).where(F.col("rank") == k).select("no", F.col("score").alias("cutoff"))


def top_k(rows: DataFrame, query: Column, k: int = 10, scale: float = 1024.0, lists: int = LISTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``rows(vec_id, embedding, ...)`` for each ``query`` row.

    Each component x counts as floor(scale * x); a score is an integer inner
    product; ties end at ``vec_id``; a query's own row is no answer.

    Rows with a null id, vector or component, or a non-finite one, take no
    part.  Missing components of shorter vectors are zeros; floors beyond 64
    bits end there, and scores count modulo 2^64.  Rows that share an id are
    answers of their own but never those of a query with that id; equal queries
    are one.  An empty table gives no rows; other columns are ignored.
    """
    rows = T.sound(rows).select("vec_id", "embedding", F.coalesce(query, F.lit(False)).alias("_query"))
    queries = T.numbered(rows.where("_query").drop("_query"))
    rows = rows.drop("_query")
    gathered = T.against_all(queries, rows, lambda q: _Gathered(q, scale, k, lists), FOUND)
    asked = T.cut(queries.join(cutoffs(gathered, k), "no", "left"))
    found = T.first_rows(T.against_all(asked, rows, lambda q: _Resolved(q, scale, k, lists), FOUND), ["no"], k)
    return found.join(queries.select("no", F.col("vec_id").alias("query_id")), "no").select("query_id", "rank", "vec_id", "score")


def op13_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


ORACLE = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s QUALIFY "rank" <= 10"""

QUERIES = {"op13_threshold_top_k": op13_threshold_top_k}
ORACLES = {"op13_threshold_top_k": ORACLE}
