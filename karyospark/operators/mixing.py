"""How mixed two gene groups are on a scaffold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hits import number_rows
from .lineage import cut
from .scans import ranked, sorted_parts
from .stats import ln_factorial

LEAST_GENES = 3
#: Genes that are counted in one piece.
PART_GENES = 1 << 16


def mixing_ranges(genes: DataFrame, sizes: DataFrame, least: int = LEAST_GENES) -> DataFrame:
    """Pairs of groups with at least ``least`` genes each on a scaffold: counts, ranges, overlap in bases and percent.

    ``genes(species, scaf, gene, pos, gene_group)``; ``sizes(species, scaf, len)``.
    """
    ends = genes.groupBy("species", "scaf", "gene_group").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).where(F.col("n") >= least)
    side = lambda k: ends.select("species", "scaf", *[F.col(c).alias(f"{c}_{k}") for c in ("gene_group", "n", "lo", "hi")])
    pairs = side("a").join(side("b"), ["species", "scaf"]).where("gene_group_a < gene_group_b")
    covered = F.greatest(F.lit(0), F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b"))
    return pairs.withColumn("bases_covered", covered).join(sizes, ["species", "scaf"]).withColumn("percent", 100 * F.col("bases_covered") / F.col("len"))


PAIR_KEYS = ["species", "scaf", "gene_group_a", "gene_group_b"]


def _pairs(genes: DataFrame, least: int) -> DataFrame:
    """Pairs of groups with enough genes on a scaffold, and how many they have."""
    counts = genes.groupBy("species", "scaf", "gene_group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    side = lambda k: counts.select("species", "scaf", F.col("gene_group").alias(f"gene_group_{k}"), F.col("n").alias(f"n_{k}"))
    return cut(side("a").join(side("b"), ["species", "scaf"]).where("gene_group_a < gene_group_b"))


def _ends(pairs: DataFrame) -> DataFrame:
    """A row for either group of a pair, with its letter."""
    ends = [pairs.select(*PAIR_KEYS, F.col(f"gene_group_{k}").alias("gene_group"), F.lit(letter).alias("letter")) for k, letter in (("a", "A"), ("b", "B"))]
    return ends[0].unionByName(ends[1])


def pair_letters(genes: DataFrame, least: int = LEAST_GENES, part: int = PART_GENES) -> DataFrame:
    """``(PAIR_KEYS, part, place, letter)``: for each pair of groups its genes along the scaffold, A or B, in parts of ``part`` genes.

    Places (from 0) come from one sort over range partitions, so a scaffold's
    genes need not meet in one task.
    """
    rows = genes.select("species", "scaf", "gene", "pos", "gene_group").join(_ends(_pairs(genes, least)), ["species", "scaf", "gene_group"])
    ranked = cut(number_rows(rows.select(*PAIR_KEYS, "pos", "gene", "letter"), [*PAIR_KEYS, "pos", "gene", "letter"], "_rank"))
    first = ranked.groupBy(*PAIR_KEYS).agg(F.min("_rank").alias("_first"))
    placed = ranked.join(first, PAIR_KEYS).withColumn("place", F.col("_rank") - F.col("_first"))
    return placed.select(*PAIR_KEYS, F.floor(F.col("place") / part).alias("part"), "place", "letter")


def gene_strings(genes: DataFrame, least: int = LEAST_GENES, part: int = PART_GENES) -> DataFrame:
    """``(PAIR_KEYS, part, genestring)``: the letters of ``pair_letters``; a pair's string is its parts one after the other."""
    letters = F.sort_array(F.collect_list(F.struct("place", "letter")))
    parts = pair_letters(genes, least, part).groupBy(*PAIR_KEYS, "part").agg(letters.alias("_l"))
    return parts.select(*PAIR_KEYS, "part", F.array_join(F.transform("_l", lambda x: x["letter"]), "").alias("genestring"))


def pair_runs(codes: np.ndarray, groups: int) -> np.ndarray:
    """``runs[a, b]``: runs of group b along ``codes`` where only genes of a stand between (0 for absent groups; the diagonal means nothing).

    Two genes of b that follow each other are in different runs if the count of
    a's genes before them differs, which one look at b's genes tells.
    """
    runs = np.zeros((groups, groups), np.int64)
    order = np.argsort(codes, kind="stable")
    ours = codes[order]
    first = np.diff(ours, prepend=-1) != 0
    for a in np.unique(codes).tolist():
        before = np.cumsum(codes == a)[order]
        runs[a] = np.bincount(ours[first | (np.diff(before, prepend=0) != 0)], minlength=groups)
    return runs


STATE = "species string, scaf string, part bigint, gene_group_a string, gene_group_b string, first bigint, last bigint, inside bigint"


def _part_state(pdf: pd.DataFrame) -> pd.DataFrame:
    """First and last place of each group of a part, and the changes within it of each pair that meets there."""
    pdf = pdf.sort_values("_place")
    names, codes = np.unique(pdf.gene_group.to_numpy(str), return_inverse=True)
    place, n = pdf._place.to_numpy(np.int64), len(names)
    first, last = np.zeros((2, n), np.int64)
    last[codes] = place  # the last of equal places stays
    first[codes[::-1]] = place[::-1]
    runs = pair_runs(codes, n)
    a, b = np.triu_indices(n, 1)
    groups = pd.DataFrame({"gene_group_a": names, "gene_group_b": None, "first": first, "last": last, "inside": 0})
    pairs = pd.DataFrame({"gene_group_a": names[a], "gene_group_b": names[b], "first": 0, "last": 0, "inside": runs[a, b] + runs[b, a] - 1})
    out = pd.concat([groups, pairs]) if n > 1 else groups
    for k, c in enumerate(("species", "scaf", "part")):
        out.insert(k, c, pdf[c].iloc[0])
    return out


def mixing_value(genes: DataFrame, least: int = LEAST_GENES, compress: bool = False, part: int = PART_GENES) -> DataFrame:
    """``(PAIR_KEYS, n_a, n_b, changes, m)``: changes between the two groups along the scaffold, against their expected number.

    1 is as mixed as by chance, 0 is apart; null where nothing is expected.
    With ``compress`` a run of one group counts as one gene.  Genes are ranked
    once and cut into parts of ``part``.  A part yields where each group stands
    first and last, and each pair's changes; parts of a pair merge in order by
    the group that is last in one and first in the next.
    """
    place = ["species", "scaf"]
    pairs = _pairs(genes, least)
    ends = _ends(pairs)
    kept = genes.select(*place, "pos", "gene", "gene_group").join(ends.select(*place, "gene_group").distinct(), [*place, "gene_group"], "left_semi")
    order = ["pos", "gene", "gene_group"]
    placed = ranked(sorted_parts(kept, [*place, *order]), place, order, "_place").withColumn("part", F.floor(F.col("_place") / part))
    states = cut(placed.select(*place, "part", "_place", "gene_group").groupBy(*place, "part").applyInPandas(_part_state, STATE))
    alone = states.where("gene_group_b IS NULL").select(*place, "part", F.col("gene_group_a").alias("gene_group"), "first", "last")
    sides = alone.join(ends, [*place, "gene_group"]).groupBy(*PAIR_KEYS, "part").agg(F.min_by("letter", "first").alias("head"), F.max_by("letter", "last").alias("tail"))
    inside = states.where("gene_group_b IS NOT NULL").select(*PAIR_KEYS, "part", "inside")
    meets = (F.col("head") != F.lag("tail").over(W.partitionBy(*PAIR_KEYS).orderBy("part"))).cast("bigint")
    merged = sides.join(inside, [*PAIR_KEYS, "part"], "left").withColumn("_meets", F.coalesce(meets, F.lit(0))).groupBy(*PAIR_KEYS).agg(
        F.sum(F.coalesce("inside", F.lit(0)) + F.col("_meets")).alias("changes"), F.min_by("head", "part").alias("_head")
    )
    out = pairs.join(merged, PAIR_KEYS)
    if compress:
        runs = F.col("changes") + 1
        more, fewer = F.floor((runs + 1) / 2), F.floor(runs / 2)
        out = out.withColumn("n_a", F.when(F.col("_head") == "A", more).otherwise(fewer)).withColumn("n_b", runs - F.col("n_a"))
    expected = 2 * F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")) - 1
    return out.select(*PAIR_KEYS, "n_a", "n_b", "changes").withColumn("m", (F.col("changes") - 1) / F.nullif(expected, F.lit(0.0)))


def _runs(n_a: int, n_b: int) -> np.ndarray:
    """Numbers of runs from 2 on, as far from the expected one as their chance can be told from 0 (the spread is below sqrt(n) / 2)."""
    n = n_a + n_b
    mean, far = 2 * n_a * n_b / n + 1, 40 * math.sqrt(n) + 100
    return np.arange(max(2, math.floor(mean - far)), min(n, math.ceil(mean + far)) + 1)


def _runs_ln(n_a: int, n_b: int, r: np.ndarray) -> np.ndarray:
    """ln P of r runs when n_a and n_b letters stand in random order."""

    def ln_choose(n: int, k: np.ndarray) -> np.ndarray:
        within = np.clip(k, 0, max(n, 0))
        ways = ln_factorial(np.array(max(n, 0))) - ln_factorial(within) - ln_factorial(max(n, 0) - within)
        return np.where((k >= 0) & (k <= n), ways, -np.inf)

    half = r // 2
    even = np.log(2) + ln_choose(n_a - 1, half - 1) + ln_choose(n_b - 1, half - 1)
    odd = np.logaddexp(ln_choose(n_a - 1, half) + ln_choose(n_b - 1, half - 1), ln_choose(n_a - 1, half - 1) + ln_choose(n_b - 1, half))
    return np.where(r % 2 == 0, even, odd) - ln_choose(n_a + n_b, np.array(n_a))


def _compressed_null(runs: int, r: np.ndarray, ln: np.ndarray) -> tuple[float | None, float | None]:
    """``(mode, P(m_random <= m))`` where the shuffled string is compressed before it is measured.

    An even number of runs from 4 on gives m = 2 exactly, an odd one r gives
    2 r (r - 2) / (r r - 2 r - 1), which falls towards 2; two runs give no value.
    """
    p = np.exp(ln)
    even, odd = p[(r % 2 == 0) & (r > 2)].sum(), np.where(r % 2 == 1, p, 0.0)
    most = int(r[np.argmax(np.round(odd, 12))])
    if not even and not odd.any():
        return None, None
    mode = 2.0 if even >= odd.max() else 2 * most * (most - 2) / (most * most - 2 * most - 1)
    return mode, None if runs <= 2 else min(1.0, float(even + (odd[r >= runs].sum() if runs % 2 else 0.0)))


def mixing_null(mixed: DataFrame, compress: bool = False) -> DataFrame:
    """Exact null of ``m`` for the rows of ``mixing_value``: ``mode``, ``p_value_unmixed`` and percent of the way to the mode.

    ``changes`` is the number of runs less one, whose distribution is known, so
    nothing is simulated; of n genes some sqrt(n) numbers of runs are looked at.  With ``compress``, for compressed rows, random strings
    are compressed as well.
    """

    @F.pandas_udf("mode double, p_value_unmixed double")
    def null(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b, changes in batches:
            rows = []
            with np.errstate(invalid="ignore", divide="ignore"):
                for n_a, n_b, t in zip(a.astype(int), b.astype(int), changes.astype(int), strict=True):
                    r = _runs(n_a, n_b)
                    ln = _runs_ln(n_a, n_b, r)
                    if compress:
                        rows.append(_compressed_null(t + 1, r, ln))
                        continue
                    expected = 2 * n_a * n_b / (n_a + n_b) - 1
                    top = int(r[np.argmax(np.round(ln, 9))]) - 2
                    rows.append((top / expected if expected else None, min(1.0, float(np.exp(ln[r <= t + 1]).sum()))))
            yield pd.DataFrame(rows, columns=["mode", "p_value_unmixed"], index=a.index)

    out = mixed.withColumn("_null", null("n_a", "n_b", "changes"))
    way = F.least(F.lit(1.0), F.col("m") / F.nullif(F.col("_null.mode"), F.lit(0.0))) * 100
    return out.withColumn("mode", F.col("_null.mode")).withColumn("p_value_unmixed", F.col("_null.p_value_unmixed")).withColumn("m_percent_of_way_to_mode", way).drop("_null")
