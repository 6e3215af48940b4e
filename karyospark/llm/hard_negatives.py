"""Hard-negative mining with exact integer scores.

Scores of anchors and candidates are products of int64 tiles by Strassen's
recursion (``tiles.strassen``).  A first walk over all candidates keeps each
anchor's best rows of its own label, a second one, for each of these positives,
the best rows of other labels whose scores lie in the positive's window.  Both
are heaps that merge over chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiles as T

FOUND = "no bigint, place int, vec_id bigint, score bigint"


class _Positives:
    def __init__(self, anchors: pa.RecordBatch, scale: float, k: int):
        self.no, self.own, self.label = (T.ints(anchors, c) for c in ("no", "vec_id", "label"))
        self.codes, self.scale = T.matrix(anchors.column("embedding"), scale), scale
        self.heaps = T.Heaps(len(self.no) * self.places(anchors), k)

    def places(self, anchors: pa.RecordBatch) -> int:
        """Heaps of an anchor."""
        return 1

    def take(self, rows: pa.RecordBatch) -> None:
        ids, label, codes = T.ints(rows, "vec_id"), T.ints(rows, "label"), T.matrix(rows.column("embedding"), self.scale)
        for at in T.query_tiles(len(self.no)):
            others, same = self.own[at, None] != ids, self.label[at, None] == label
            self.offer(at, T.scores(self.codes[at], codes), ids, others & same, others & ~same)

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray, same: np.ndarray, different: np.ndarray) -> None:
        self.heaps.offer(np.arange(at.start, at.stop), scores, ids, same)

    def results(self) -> Iterator[pa.RecordBatch]:
        row, k = np.nonzero(self.heaps.full)
        each = len(self.heaps.full) // len(self.no)
        yield pa.RecordBatch.from_arrays([pa.array(self.no[row // each]), pa.array((row % each).astype(np.int32)), pa.array(self.heaps.id[row, k]), pa.array(self.heaps.score[row, k])], ["no", "place", "vec_id", "score"])


class _Windows(_Positives):
    """Heap ``anchor * most + place`` holds the rows of other labels between the bounds of the anchor's positive at ``place``."""

    def __init__(self, anchors: pa.RecordBatch, scale: float, k: int, most: int):
        self.most = most
        super().__init__(anchors, scale, k)
        self.low, self.high = (self._bounds(anchors, c, none) for c, none in (("low", T.HIGHEST), ("high", T.LOWEST)))

    def places(self, anchors: pa.RecordBatch) -> int:
        return self.most

    def _bounds(self, anchors: pa.RecordBatch, name: str, none: int) -> np.ndarray:
        """One row an anchor; a positive that is not there gets a window that holds nothing."""
        column = anchors.column(name)
        lengths = np.diff(column.offsets.to_numpy())
        out = np.full((len(self.no), self.most), none)
        out[np.arange(self.most) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out

    def offer(self, at: slice, scores: np.ndarray, ids: np.ndarray, same: np.ndarray, different: np.ndarray) -> None:
        for place in range(self.most):
            low, high = self.low[at, place, None], self.high[at, place, None]
            rows = np.arange(at.start, at.stop) * self.most + place
            self.heaps.offer(rows, scores, ids, different & (scores >= low) & (scores <= high))


def _bounds(window: tuple[int, int]):
    """``(low, high)``: least and greatest integer s with window[0] * p <= 100 * s <= window[1] * p, exact for any 64-bit p."""
    p = F.col("score").cast("decimal(38,0)")
    clip = lambda c: F.greatest(F.least(c, F.lit(T.HIGHEST)), F.lit(T.LOWEST)).cast("bigint")
    # floor(x / 100) of integers without a quotient's rounding
    floor = lambda x: (x - F.pmod(x, F.lit(100).cast("decimal(38,0)"))) / 100
    return clip(-floor(-p * window[0])), clip(floor(p * window[1]))


def hard_negatives(rows: DataFrame, anchor: Column, scale: float = 256.0, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``rows(vec_id, label, embedding, ...)``.

    Each component x counts as floor(scale * x), a score is an integer inner
    product.  The positives of an ``anchor`` row are its first ``positives``
    other rows of its label, by score, ties by ``vec_id``; for each of them the
    first ``negatives`` rows of other labels are returned whose score is from
    ``window[0]`` to ``window[1]`` percent of the positive's.

    Rows with a null id, label, vector or component, or a non-finite one, take
    no part.  Missing components of shorter vectors are zeros; floors beyond 64
    bits end there, and scores count modulo 2^64.  Rows that share an id are
    candidates of their own but never partners of an anchor with that id; equal
    anchors are one.  Anchors without positives or negatives leave no rows, an
    empty table none; other columns are ignored.
    """
    rows = T.sound(rows.where(F.col("label").isNotNull())).withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
    rows = rows.select("vec_id", F.col("label").cast("bigint").alias("label"), "embedding", "_anchor")
    anchors = T.numbered(rows.where("_anchor").drop("_anchor"))
    rows = rows.drop("_anchor")
    found = T.against_all(anchors, rows, lambda a: _Positives(a, scale, positives), FOUND)
    best = T.cut(T.first_rows(found, ["no"], positives).withColumn("place", F.col("rank") - 1).drop("rank"))
    low, high = _bounds(window)
    spans = best.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("place", low.alias("low"), high.alias("high")))).alias("_w"))  # at most ``positives``
    asked = anchors.join(spans.select("no", F.col("_w.low").alias("low"), F.col("_w.high").alias("high")), "no")
    chosen = T.first_rows(T.against_all(asked, rows, lambda a: _Windows(a, scale, negatives, positives), FOUND), ["no", "place"], negatives)
    named = chosen.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(best.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), ["no", "place"])
    return named.join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_strassen_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0, scale=256.0, positives=5, negatives=5, window=(80, 100))


ORACLE = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id, a.label = b.label same, CAST(list_inner_product(a.v, b.v) AS BIGINT) score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS "rank", s.vec_id negative_id, p.score positive_score, s.score negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY "rank" <= 5"""

QUERIES = {"op12_strassen_hard_negatives": op12_strassen_hard_negatives}
ORACLES = {"op12_strassen_hard_negatives": ORACLE}
