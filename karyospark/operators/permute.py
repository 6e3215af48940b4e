"""Permutation runs of scaffold tuples whose observations are reduced where they are drawn.

A run's state has few rows, whatever its number of trials:
``(kind, {sp}_scaf..., size, n)`` with the kinds

* ``size``: trials in which some tuple has exactly this size,
* ``most``: trials whose largest tuple has this size,
* ``tuple``: trials in which this tuple has exactly this size,
* ``trials``: all trials.

States are sums, so those of tasks, and of runs over other trials, merge by
adding ``n``: a run is continued by merging what was written with what follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import permuted_by_rank
from .hits import number_rows
from .lineage import cut
from .scans import at_least

#: Most scaffold tuples for which counts are drawn (so scaffolds of a species are fewer), and most orthologs that numpy draws among.
DRAWN_TUPLES = 1_000_000
DRAWN_ROWS = 1_000_000_000
#: Orthologs a cell of the table up to which shuffling them costs less than drawing counts.
SHUFFLED = 8
#: Observations that a task holds before it adds up equal ones.
HELD = 1 << 21


class Tally:
    """How often each integer was added."""

    def __init__(self):
        self.keys, self.times, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(np.ones(len(keys), np.int64))
        self.held += len(keys)
        if self.held > HELD:
            keys, times = self.sums()
            self.keys, self.times = [keys], [times]
            # what stays counts half, so that ever more different keys are not added up ever more often
            self.held = len(keys) // 2

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, at, np.concatenate(self.times))
        return keys, times


def _dealt(rng: np.random.Generator, counts: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, columns, sizes)`` of a random table with these row and column sums.

    Few orthologs for the table's size are shuffled; otherwise the fewer of
    rows and columns draw one by one from what the others have left.
    """
    total, cells = int(counts.sum()), len(counts) * len(margin)
    if total < SHUFFLED * cells:
        small = np.min_scalar_type(len(margin))
        cols = rng.permutation(np.repeat(np.arange(len(margin), dtype=small), margin))
        table = np.bincount(np.repeat(np.arange(len(counts)) * len(margin), counts) + cols, minlength=cells)
        at = np.flatnonzero(table)
        return at // len(margin), at % len(margin), table[at]
    if len(counts) < len(margin):
        cols, rows, sizes = _dealt(rng, margin, counts)
        order = np.lexsort((cols, rows))
        return rows[order], cols[order], sizes[order]
    left, table = counts.copy(), np.zeros((len(margin), len(counts)), np.int64)
    for k, n in enumerate(margin.tolist()):
        table[k] = left if k == len(margin) - 1 else rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= table[k]
    rows, cols = np.nonzero(table.T)
    return rows, cols, table.T[rows, cols]


def draw_counts(rng: np.random.Generator, margins: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """``(codes by species, counts)`` of the tuples of one random pairing of columns with these scaffold counts.

    Shuffling a column among the orthologs deals its scaffolds' counts over the
    tuples so far without replacement; so the counts are drawn, and no ortholog
    is moved.
    """
    codes, counts = [np.arange(len(margins[0]))], margins[0]
    for margin in margins[1:]:
        row, col, counts = _dealt(rng, counts, margin)
        codes = [*(c[row] for c in codes), col]
    return codes, counts


def _draws(margins: list[np.ndarray], seed: int, tuples: bool):
    radix = np.cumprod([1, *(len(m) for m in margins[:0:-1])])[::-1]
    span = int(margins[0].sum()) + 1  # sizes are less

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {"size": Tally(), "most": Tally(), "tuple": Tally(), "trials": Tally()}
        for batch in batches:
            for trial in batch.column(0).to_pylist():
                codes, counts = draw_counts(np.random.default_rng([seed, trial]), margins)
                found["size"].add(np.unique(counts))
                found["most"].add(counts.max(initial=0, keepdims=True))
                found["trials"].add(np.zeros(1, np.int64))
                if tuples:
                    found["tuple"].add(sum(c * r for c, r in zip(codes, radix, strict=True)) * span + counts)
        for kind, tally in found.items():
            keys, times = tally.sums()
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys // span), pa.array(keys % span), pa.array(times)], ["kind", "code", "size", "n"])

    return run


def drawn_state(rbh: DataFrame, species: list[str], permutations: int, first: int = 0, seed: int = 0, tuples: bool = True, drawn_tuples: int = DRAWN_TUPLES) -> DataFrame:
    """State of trials ``first`` to ``first + permutations - 1``, each with every species' column shuffled on its own.

    Only counts of single scaffolds leave the table: a trial draws the counts
    of its tuples from them, under its own seed.  Where the scaffolds could
    make more than ``drawn_tuples`` tuples, columns are shuffled by ranks of
    hashes on all executors; both are exact, but their trials differ.  Without
    ``tuples`` that kind is left out.  Rows with a null scaffold take no part.
    """
    spark, keys = rbh.sparkSession, [f"{s}_scaf" for s in species]
    whole = rbh.select("rbh", *keys).dropna(subset=keys)
    ends = [F.struct(F.lit(k).alias("k"), F.col(key).alias("scaf")) for k, key in enumerate(keys)]
    margins = number_rows(whole.select(F.inline(F.array(*ends))).groupBy("k", "scaf").agg(F.count(F.lit(1)).alias("n")), ["k", "scaf"])
    margins = cut(margins.select("k", "number", "scaf", "n"))
    sums = {r.k: r for r in margins.groupBy("k").agg(F.count(F.lit(1)).alias("kinds"), F.min("number").alias("first"), F.sum("n").alias("total")).collect()}
    kinds = [sums[k].kinds if k in sums else 0 for k in range(len(keys))]
    if math.prod(kinds) > drawn_tuples or (sums and sums[0].total > DRAWN_ROWS):
        counts = permuted_by_rank(whole, species, permutations, first=first)
        return state_of(counts, species, permutations, tuples)
    sizes = np.array([r.n for r in margins.orderBy("number").select("n").collect()], np.int64)  # numbers only, drawn_tuples of them at most for two species and more
    jobs = max(1, min(permutations, 2 * spark.sparkContext.defaultParallelism))
    draws = _draws(np.split(sizes, np.cumsum(kinds)[:-1]), seed, tuples)
    out = spark.range(first, first + permutations, 1, jobs).mapInArrow(draws, "kind string, code bigint, size bigint, n bigint").groupBy("kind", "code", "size").agg(F.sum("n").alias("n"))
    if not tuples:
        return out.select("kind", *[F.lit(None).cast(whole.schema[key].dataType).alias(key) for key in keys], "size", "n")
    out = out.withColumn("code", F.when(F.col("kind") == "tuple", F.col("code")))
    for k in range(len(keys) - 1, -1, -1):
        name = margins.where(F.col("k") == k).select((F.col("number") - F.lit(sums[k].first if k in sums else 0)).alias("_code"), F.col("scaf").alias(keys[k]))
        most = F.lit(max(1, kinds[k]))
        out = out.withColumn("_of", F.col("code") % most).join(name, F.col("_of") == F.col("_code"), "left").withColumn("code", F.floor(F.col("code") / most)).drop("_of", "_code")
    return out.select("kind", *keys, "size", "n")


def state_of(counts: DataFrame, species: list[str], permutations: int, tuples: bool = True) -> DataFrame:
    """State of ``permutations`` trials given as ``counts(trial, {sp}_scaf..., count)``."""
    keys = [f"{s}_scaf" for s in species]
    none = [F.lit(None).cast(counts.schema[k].dataType).alias(k) for k in keys]
    n = F.count(F.lit(1)).alias("n")
    size = F.col("count").alias("size")
    sizes = counts.select("trial", size).distinct().groupBy("size").agg(n)
    most = counts.groupBy("trial").agg(F.max("count").alias("size")).groupBy("size").agg(n)
    trials = counts.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("size"), F.lit(permutations).cast("bigint").alias("n"))
    parts = [df.select(F.lit(kind).alias("kind"), *none, "size", "n") for kind, df in (("size", sizes), ("most", most), ("trials", trials))]
    if tuples:
        parts.append(counts.groupBy(*keys, size).agg(n).select(F.lit("tuple").alias("kind"), *keys, "size", "n"))
    return reduce(DataFrame.unionByName, parts)


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all trials of ``states``, which must be runs over different trials."""
    together = reduce(DataFrame.unionByName, states)
    return together.groupBy(*[c for c in together.columns if c != "n"]).agg(F.sum("n").alias("n"))


def trials_of(state: DataFrame) -> int:
    return state.where("kind = 'trials'").agg(F.sum("n")).first()[0] or 0


def size_observations(state: DataFrame) -> DataFrame:
    """``(size, n)``: trials in which some tuple has exactly this size."""
    return state.where("kind = 'size'").select("size", "n")


def combo_observations(state: DataFrame, species: list[str]) -> DataFrame:
    """``({sp}_scaf..., size, n)``: trials in which a tuple that ever occurs has exactly this size, 0 included."""
    keys = [f"{s}_scaf" for s in species]
    seen = state.where("kind = 'tuple'").select(*keys, "size", "n")
    zero = seen.groupBy(*keys).agg((F.lit(trials_of(state)) - F.sum("n")).alias("n")).select(*keys, F.lit(0).cast("bigint").alias("size"), F.col("n").cast("bigint"))
    return seen.unionByName(zero.where("n > 0"))


def combo_significance(groups: DataFrame, state: DataFrame, species: list[str]) -> DataFrame:
    """``groups`` with ``p``, that their own scaffolds share as many genes by chance, and ``p_family``, that any scaffolds do.

    What no trial shows has 1 / trials.
    """
    keys, trials = [f"{s}_scaf" for s in species], trials_of(state)
    drawn = state.where("kind = 'tuple'").select(*keys, F.col("size").alias("_drawn"), "n")
    own = groups.select(*keys, F.col("count").alias("_own")).join(drawn, keys).where("_drawn >= _own").groupBy(*keys).agg(F.sum("n").alias("_hits"))
    above = at_least(groups.select(F.col("count").alias("size")), state.where("kind = 'most'").select("size", "n"))
    out = groups.join(own, keys, "left").join(above.select(F.col("size").alias("count"), F.col("n").alias("_above")), "count", "left")
    share = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.lit(trials), F.lit(1 / trials))
    return out.withColumn("p", share("_hits")).withColumn("p_family", share("_above")).drop("_hits", "_above")
