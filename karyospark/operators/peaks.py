"""Break finding: peaks of the break statistic along a scaffold."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .lineage import cut
from .scans import BLOCK, PART, blocks, join_nullsafe, own, ranked, sorted_parts

#: Genes to either side within which only the best peak stays, per signal and over all signals.
WIDE, NARROW = 20, 5
#: Indices along a scaffold whose peaks one task settles at a time.
SPAN = 1 << 16


def signals(rows: DataFrame, species: str) -> DataFrame:
    """``(scaf, signal, ix, d)``: indices where a signal of the statistic stands above its median.

    The statistic itself, its mean over three genes, and the steps of both,
    in blocks of rows along the scaffold that overlap by three.
    """
    s = species
    base = sorted_parts(rows.select(F.col(f"{s}_scaf").alias("scaf"), F.col(f"{s}_ix").alias("ix"), F.col(f"{s}_D").alias("d")), ["scaf", "ix"])
    medians = base.groupBy("scaf").agg(F.median("d").alias("_median"))
    above = lambda c, by, median: F.when(~(F.col(by) < F.col(median)) | F.col(by).isNull(), F.col(c))
    placed = join_nullsafe(ranked(base, ["scaf"], ["ix"], "_place").drop(PART), medians, ["scaf"])
    w = W.partitionBy("scaf", BLOCK).orderBy("_place")
    three = w.rowsBetween(-1, 1)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    near = blocks(placed.withColumn("raw", above("d", "d", "_median")), "_place", 3)
    near = near.withColumn("mean", F.when(F.count("raw").over(three) == 3, F.avg("raw").over(three)))
    near = cut(own(near.withColumn("mean_step", step("mean")).withColumn("raw_step", step("raw"))))
    medians = near.groupBy("scaf").agg(F.median("mean").alias("_mean"), F.median("raw").alias("_raw"))
    near = join_nullsafe(near, medians, ["scaf"])
    near = near.withColumn("mean_step", above("mean_step", "mean", "_mean")).withColumn("raw_step", above("raw_step", "raw", "_raw"))
    long = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("v")) for n in ("mean", "mean_step", "raw_step", "raw")])
    return near.select("scaf", "ix", "d", F.inline(long)).where("v IS NOT NULL").drop("v")


def run_peaks(points: DataFrame) -> DataFrame:
    """The index with the greatest statistic in each run of two or more neighbouring indices."""
    placed = ranked(sorted_parts(points, ["scaf", "signal", "ix"]), ["scaf", "signal"], ["ix"], "_place")
    runs = placed.groupBy("scaf", "signal", (F.col("ix") - F.col("_place")).alias("_run"))
    best = runs.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("d", (-F.col("ix")).alias("minus"))).alias("b"))
    return best.where("n > 1").select("scaf", "signal", (-F.col("b.minus")).alias("ix"), F.col("b.d").alias("d"))


def settled(ix: np.ndarray, d: np.ndarray, stays: np.ndarray, window: int, low: float, high: float) -> tuple[np.ndarray, bool]:
    """Which peaks (by rising ``ix``, of a stretch from ``low`` to before ``high``) still stay, and whether all are settled.

    The rule: of the windows around all peaks, gone ones too, the one with the
    most peaks left, of equal ones the first, loses all but its best, until no
    window holds two.  Windows act on each other only within two widths, so one
    that is first among those is emptied whatever stands elsewhere.  It has to
    wait where peaks beyond the stretch, or windows that wait themselves, may
    come before it.
    """
    n, stays = len(ix), stays.copy()
    lo, hi = np.searchsorted(ix, ix - window, side="right"), np.searchsorted(ix, ix + window, side="left")
    near = np.searchsorted(ix, ix - 2 * window, side="right"), np.searchsorted(ix, ix + 2 * window, side="left")
    before = np.concatenate([[0], np.cumsum(stays)])
    held, waits = (before[hi] - before[lo]).tolist(), np.zeros(n, bool)
    outside = (ix - 3 * window < low) | (ix + 3 * window >= high)
    queue = [(-held[k], k) for k in range(n) if held[k] > 1]
    heapq.heapify(queue)
    while queue:
        full, k = heapq.heappop(queue)
        if held[k] != -full:
            continue
        if outside[k] or waits[near[0][k] : near[1][k]].any():
            waits[k] = True
            continue
        members = np.flatnonzero(stays[lo[k] : hi[k]]) + lo[k]
        best = members[np.argmax(d[members])]  # the first of equal ones
        for gone in members[members != best].tolist():
            stays[gone] = False
            for q in range(lo[gone], hi[gone]):
                held[q] -= 1
                if held[q] > 1:
                    heapq.heappush(queue, (-held[q], q))
    return stays, not waits.any()


def suppress(peaks: DataFrame, keys: list[str], window: int, span: int | None = None) -> DataFrame:
    """``peaks(keys..., ix, d)`` that stay by the rule of ``settled`` within each segment of ``keys``.

    Stretches of ``span`` indices are settled side by side, as far as each can
    be, then those half a stretch further on, until no window waits.
    """
    span = max(span or SPAN, 16 * window)  # what a stretch settles on its own is more than half of it
    ends = peaks.groupBy(*keys).agg(F.min("ix").alias("_least"), F.max("ix").alias("_most"))
    left, shift = cut(join_nullsafe(peaks, ends, keys).withColumn("_stays", F.lit(True))), 0
    schema = StructType([*left.schema.fields, StructField("_waits", BooleanType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ix", "d"]).reset_index(drop=True)
        low = int(pdf[BLOCK].iloc[0]) * span - shift
        low, high = (low if pdf._least.iloc[0] < low else -np.inf), (low + span if pdf._most.iloc[0] >= low + span else np.inf)
        stays, done = settled(pdf.ix.to_numpy(np.int64), pdf.d.to_numpy(np.float64), pdf._stays.to_numpy(bool), window, low, high)
        return pdf.drop(columns=BLOCK).assign(_stays=stays, _waits=not done)

    while True:
        rows = left.withColumn(BLOCK, F.floor((F.col("ix") + shift) / span))
        out = cut(rows.groupBy(*keys, BLOCK).applyInPandas(run, schema))
        if out.where("_waits").isEmpty():
            return out.where("_stays").select(*peaks.columns)
        left, shift = out.drop("_waits"), span // 2 - shift


def auto_breaks(rows: DataFrame, species: str, manual: DataFrame | None = None) -> DataFrame:
    """``(scaf, ix, d)``: peaks of all signals, and manual break rows ``manual(scaf, ix, d)``, the best of each narrow window."""
    peaks = suppress(run_peaks(signals(rows, species)), ["scaf", "signal"], WIDE).select("scaf", "ix", "d")
    if manual is not None:
        peaks = peaks.unionByName(manual)
    return suppress(peaks.distinct(), ["scaf"], NARROW)
