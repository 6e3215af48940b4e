"""Fisher's exact test of scaffold pairs, the break statistic, and summary tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .lineage import cut
from .scans import BLOCK, OWN, PART, at_or_below, blocks, join_nullsafe, own, ranked, sorted_parts

HALF_LN_TAU = 0.5 * math.log(2 * math.pi)
#: Fixed value: genes on either side of a possible break.
SIDE = 20


def scaffold_pair_counts(rbh: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Genes of each pair, each single scaffold and overall, in one pass (``level``: pair, a, b, all)."""
    sets = rbh.where(F.col(key_a).isNotNull() & F.col(key_b).isNotNull()).groupingSets([[key_a, key_b], [key_a], [key_b], []], key_a, key_b)
    level = F.when(F.grouping_id() == 0, "pair").when(F.grouping_id() == 1, "a").when(F.grouping_id() == 2, "b").otherwise("all")
    return sets.agg(F.count(F.lit(1)).alias("n"), level.alias("level"))


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """ln n! less Stirling's formula."""
    few = np.array([0.0, *(math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - HALF_LN_TAU for k in range(1, 16))])
    m = np.maximum(n, 16).astype(np.float64)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m * m)) / (m * m)) / (m * m)) / m
    return np.where(n < 16, few[np.clip(n, 0, 15)], series)


def ln_factorial(n: np.ndarray) -> np.ndarray:
    """ln n! of whole numbers."""
    m = np.maximum(n, 1).astype(np.float64)
    return np.where(n > 0, (m + 0.5) * np.log(m) - m + HALF_LN_TAU + _stirling_rest(n), 0.0)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, without loss where both are near."""
    near = (x - mean) / (x + mean)
    square = near * near
    odd = sum(square**k / (2 * k + 1) for k in range(1, 12))
    close = (x - mean) * near + 2 * x * near * odd
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(x > 0, x * np.log(x / mean), 0.0) + mean - x
    return np.where(np.abs(x - mean) < 0.1 * (x + mean), close, far)


def _ln_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """ln of the binomial probability by saddle-point expansion (Loader 2000), exact to rounding for any n."""
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
        inner = inner - HALF_LN_TAU - 0.5 * (np.log(x) + np.log1p(-x / n))
        out = np.where(x == 0, n * np.log1p(-p), np.where(x == n, n * np.log(p), inner))
    return np.where(n == 0, 0.0, out)


def ln_hypergeometric(x: np.ndarray, r: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln P(X = x) for a draw of ``c`` from ``n`` with ``r`` marked."""
    p, q = c / np.maximum(n, 1), (n - c) / np.maximum(n, 1)
    return np.where(c == n, 0.0, _ln_binomial(x, r, p, q) + _ln_binomial(c - x, n - r, p, q) - _ln_binomial(c, n, p, q))


def _ln_sum(x: np.ndarray, r: np.ndarray, c: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """ln of the sum of probabilities from x on (``step`` 1) or back (-1), by the ratio of neighbouring terms."""
    total, term, t = np.ones(len(x)), np.ones(len(x)), x.astype(np.float64)
    left = np.arange(len(x))
    r, c, n = (v.astype(np.float64) for v in (r, c, n))
    while len(left):
        k, u = left, t[left]
        up = (r[k] - u) * (c[k] - u)
        ratio = up / ((u + 1) * (n[k] - r[k] - c[k] + u + 1)) if step > 0 else u * (n[k] - r[k] - c[k] + u) / ((r[k] - u + 1) * (c[k] - u + 1))
        term[k] *= ratio
        total[k] += term[k]
        t[k] += step
        left = k[(term[k] > total[k] * 1e-17)]
    return ln_hypergeometric(x, *(v.astype(np.int64) for v in (r, c, n))) + np.log(total)


def ln_tail(x: np.ndarray, r: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln P(X >= x): terms are summed away from the mean, so that they fall; nothing is as long as the gene count."""
    out = np.zeros(len(x))
    low = np.maximum(0, r + c - n)
    upper = (x > low) & (x * n.astype(np.float64) >= r.astype(np.float64) * c)
    lower = (x > low) & ~upper
    if upper.any():
        out[upper] = _ln_sum(x[upper], r[upper], c[upper], n[upper], 1)
    if lower.any():
        below = _ln_sum(x[lower] - 1, r[lower], c[lower], n[lower], -1)
        out[lower] = np.log1p(-np.exp(np.minimum(below, 0.0)))
    return np.minimum(out, 0.0)


@F.pandas_udf(DoubleType())
def hypergeometric_tail(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """ln P(X >= x) for a draw of ``c`` from ``n`` with ``r`` marked; equal cases are computed once."""
    for batch in batches:
        cases, at = np.unique(np.stack([v.to_numpy(np.int64) for v in batch]), axis=1, return_inverse=True)
        yield pd.Series(ln_tail(*cases)[at.ravel()], index=batch[0].index)


def fisher_pairs(rbh: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``(key_a, key_b, n, p, neg_log10_p)`` of the observed pairs.

    One-sided (more shared genes than by chance), times the number of possible
    pairs, not capped at 1.
    """
    pairs = rbh.where(F.col(key_a).isNotNull() & F.col(key_b).isNotNull()).groupBy(key_a, key_b).agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs)
    rows = pairs.groupBy(key_a).agg(F.sum("n").alias("r"))
    cols = pairs.groupBy(key_b).agg(F.sum("n").alias("c"))
    total, n_a = rows.agg(F.sum("r"), F.count(F.lit(1))).first()
    n_b = cols.count()
    ln = hypergeometric_tail("n", "r", "c", F.lit(total or 0)) + F.log(F.lit(float(max(1, n_a * n_b))))
    tested = pairs.join(rows, key_a).join(cols, key_b).withColumn("_ln", ln)
    return tested.select(key_a, key_b, "n", F.exp("_ln").alias("p"), (-F.col("_ln") / F.log(F.lit(10.0))).alias("neg_log10_p"))


def fisher_exact(rbh: DataFrame, key_a: str, key_b: str, name: str) -> DataFrame:
    """``rbh`` with the pair's p on every row, under ``name``."""
    return rbh.join(fisher_pairs(rbh, key_a, key_b).select(key_a, key_b, F.col("p").alias(name)), [key_a, key_b], "left")


def filter_significant(rbh: DataFrame, cutoff: float = 0.05, column: str | None = None) -> DataFrame:
    """Rows with p at most ``cutoff`` in ``column``, or in the first that exists of break_FET, alpha and pval."""
    column = column or next(c for c in ("break_FET", "alpha", "pval") if c in rbh.columns)
    return rbh.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.col(column) <= cutoff))


def break_statistic(rbh: DataFrame, species: str, other: str) -> DataFrame:
    """``{species}_D`` along each piece: the distance between the shares of partner pieces in the 20 genes up to here and the 20 after.

    A side that is not whole counts as zeros; the last row of a piece is 0.
    Pieces are worked on in blocks of indices that overlap by 20 genes.
    """
    key, opp, ix = f"{species}_breakchrom", f"{other}_breakchrom", f"{species}_break_ix"
    counts = rbh.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = blocks(join_nullsafe(rbh, counts, [key]), ix, SIDE)
    kept = [c for c in rbh.columns if c != f"{species}_D"]
    schema = StructType([*(rbh.schema[c] for c in kept), StructField(f"{species}_D", DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ix)
        column = table.column(opp).combine_chunks().dictionary_encode()
        codes = pc.fill_null(column.indices, -1).to_numpy(zero_copy_only=False)
        squares = side_squares(codes, table.column(ix).to_numpy(), int(table.column("_n")[0].as_py()))
        d = pa.array(np.sqrt(squares / float(SIDE * SIDE)))
        return table.select(kept).append_column(f"{species}_D", d).filter(table.column(OWN))

    return rows.groupBy(key, BLOCK).applyInArrow(run, schema)


def side_squares(codes: np.ndarray, ix: np.ndarray, n: int) -> np.ndarray:
    """For neighbouring rows ``ix`` of a piece of ``n``: the squared distance between the counts of ``codes`` (-1: none) in the ``SIDE`` rows up to each and the ``SIDE`` after.

    Equal codes are counted by how far apart they stand, from running sums.
    A side that is not whole counts as empty, and the last row of the piece is 0.
    """
    at, size = np.arange(len(codes)), len(codes)
    left, right = ix >= SIDE - 1, ix + SIDE <= n - 1
    ll, rr, lr = np.zeros((3, size), np.int64)
    for apart in range(2 * SIDE):
        equal = (codes[: size - apart] == codes[apart:]) & (codes[: size - apart] >= 0) if apart < size else np.zeros(0, bool)
        sums = np.concatenate([[0], np.cumsum(equal)])
        # pairs whose first row lies from low to high
        pairs = lambda low, high: sums[np.clip(high + 1, 0, len(equal))] - sums[np.clip(low, 0, len(equal))]  # noqa: E731, B023
        if apart < SIDE:
            times = 2 if apart else 1
            ll += times * pairs(at - SIDE + 1, at - apart)
            rr += times * pairs(at + 1, at + SIDE - apart)
        if apart:
            lr += pairs(at + np.maximum(1 - SIDE, 1 - apart), at + np.minimum(0, SIDE - apart))
    return np.where(ix == n - 1, 0, ll * left + rr * right - 2 * lr * (left & right))


def _neighbours(rows: DataFrame, keys: list[str], order: list[str], before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the row before and after in each segment, null at its ends; ``before`` and ``after`` name new columns by old ones."""
    placed = ranked(sorted_parts(rows, [*keys, *order]), keys, order, "_place").drop(PART)
    w = W.partitionBy(*keys, BLOCK).orderBy("_place")
    near = blocks(placed, "_place", 1).withColumns({n: F.lag(c).over(w) for n, c in before.items()} | {n: F.lead(c).over(w) for n, c in after.items()})
    return own(near).drop("_place")


def d_widths(plotted: DataFrame, species: str) -> DataFrame:
    """``{species}_Dwidths``: the distance to the previous plot position on the scaffold, 0 for the first."""
    pos = f"{species}_plotpos"
    rows = _neighbours(plotted, [f"{species}_scaf"], [f"{species}_plotindex"], {"_before": pos}, {})
    return rows.withColumn(f"{species}_Dwidths", F.coalesce(F.col(pos) - F.col("_before"), F.lit(0))).drop("_before")


def d_bars(genes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bar edges between genes of ``genes(scaf, gene, start, stop)``: halfway to the neighbours, the scaffold's ends outside.

    ``sizes(scaf, len, offset)``; genes lie at offset plus position.  The only
    gene of a scaffold has edges -1, middle -1 and width 1.
    """
    rows = genes.join(sizes, "scaf").withColumn("start", F.col("start") + F.col("offset")).withColumn("stop", F.col("stop") + F.col("offset"))
    rows = _neighbours(rows, ["scaf"], ["start", "stop", "gene"], {"_before": "stop"}, {"_after": "start"})
    left = F.coalesce((F.col("_before") + F.col("start")) / 2, F.col("offset").cast("double"))
    right = F.coalesce((F.col("stop") + F.col("_after")) / 2, (F.col("offset") + F.col("len")).cast("double"))
    alone = F.col("_before").isNull() & F.col("_after").isNull()
    return rows.select(
        "scaf", "gene",
        F.when(alone, -1.0).otherwise(left).alias("left"), F.when(alone, -1.0).otherwise(right).alias("right"),
        F.when(alone, -1.0).otherwise((left + right) / 2).alias("middle"), F.when(alone, 1.0).otherwise(right - left + 1).alias("width"),
    )


def manual_break_rows(breaks: DataFrame, genes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """For each ``breaks(scaf, break_pos)`` the last gene of ``genes(scaf, gene, stop)`` that ends at or before it.

    With ``sizes(scaf, offset)`` breaks and genes lie on one axis, each at its
    scaffold's offset; a break before all genes of its scaffold then falls to
    the last gene of those before (``gene_scaf``, and ``stop`` on the axis).
    Breaks that nothing ends before are left out, as are unknown scaffolds.
    """
    if sizes is None:
        hit = breaks.join(genes, "scaf").where(F.col("stop") <= F.col("break_pos"))
        return hit.groupBy("scaf", "break_pos").agg(F.max_by("gene", F.struct("stop", "gene")).alias("gene"), F.max("stop").alias("stop"))
    offsets = sizes.select("scaf", "offset")
    ends = genes.join(offsets, "scaf").select((F.col("stop") + F.col("offset")).alias("size"), F.struct("scaf", "gene").alias("value"))
    ends = ends.groupBy("size").agg(F.max(F.struct("value.gene", "value.scaf")).alias("value"))
    placed = breaks.join(offsets, "scaf").withColumn("size", F.col("break_pos") + F.col("offset"))
    found = at_or_below(placed.select("size"), ends)
    return placed.join(found, "size").where("at IS NOT NULL").select("scaf", "break_pos", F.col("value.scaf").alias("gene_scaf"), F.col("value.gene").alias("gene"), F.col("at").alias("stop"))


def filtered_pair_groups(rbh: DataFrame, a: str, b: str, color: Column, cutoff: float = 0.05) -> DataFrame:
    """Rows of significant scaffold pairs, named and colored by pair."""
    kept = rbh.where(F.col("whole_FET") <= cutoff)
    return kept.withColumn("gene_group", F.concat_ws("_", f"{a}_scaf", f"{b}_scaf")).withColumn("color", color)


def summary_pieces(rbh: DataFrame, a: str, b: str, column: str = "break_FET", key: str = "breakchrom", cutoff: float = 0.1) -> DataFrame:
    """Genes by pair of pieces (or scaffolds) and p, as printed: p in two decimals, larger counts first."""
    x, y = f"{a}_{key}", f"{b}_{key}"
    rows = rbh.where(F.col(column) <= cutoff).groupBy(x, y, column).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(x, y, F.format_string("%.2e", column).alias("p"), "n").orderBy(F.col("n").desc(), F.col(x).desc(), F.col(y).desc())


def summary_groups(rbh: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Genes by scaffold pair, p and gene group of at least ``least`` genes, with the group's most frequent color."""
    x, y = f"{a}_scaf", f"{b}_scaf"
    rows = rbh.where(F.col("whole_FET") <= 1).groupBy(x, y, "whole_FET", "gene_group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(modal_color(rbh), "gene_group").select(x, y, F.format_string("%.2e", "whole_FET").alias("p"), "gene_group", "n", "color")


def modal_color(rbh: DataFrame) -> DataFrame:
    """The most frequent color of each gene group, ties by color."""
    counts = rbh.groupBy("gene_group", "color").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("gene_group").agg(F.min_by("color", F.struct(-F.col("_n"), F.col("color"))).alias("color"))


def alg_decay(rbh: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Per linkage group: genes in significant pairs (conserved), elsewhere (scattered) and all."""
    return rbh.groupBy("gene_group").agg(
        F.count_if(F.col("whole_FET") <= cutoff).alias("conserved"), F.count_if(F.col("whole_FET") > cutoff).alias("scattered"), F.count(F.lit(1)).alias("total")
    )


def alg_decay_detail(rbh: DataFrame, sample: str, cutoff: float = 0.05) -> DataFrame:
    return rbh.groupBy("gene_group", F.col(f"{sample}_scaf").alias("scaf")).agg(F.count_if(F.col("whole_FET") <= cutoff).alias("conserved"), F.count_if(F.col("whole_FET") > cutoff).alias("scattered"))
