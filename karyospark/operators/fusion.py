"""Fusions that resolve a four-species phylogeny, with a randomised null.

``og`` is the outgroup.  Under "A is sister", A splits a chromosome that B and
C fuse.  All steps take further key columns (``by``), so all trials of the null
run in the same jobs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karyospark.functions.scalars import ranges_overlap

from .groups import dealt_places
from .hits import number_rows
from .lineage import cut

LEAST_COUNT = 5
METRICS = ["max_single", "max_grouping", "total", "n_groupings", "mean"]


def fusion_groups(rbh: DataFrame, species: list[str], by: tuple[str, ...] = (), least: int = LEAST_COUNT) -> DataFrame:
    """Scaffold tuples of at least ``least`` orthologs with their counts and position ranges."""
    ends = [f(f"{s}_pos").alias(f"{s}_{n}") for s in species for f, n in ((F.min, "lo"), (F.max, "hi"))]
    keys = [f"{s}_scaf" for s in species]
    return rbh.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("count"), *ends).where(F.col("count") >= least)


def _n(*keys: str) -> Column:
    return F.count(F.lit(1)).over(W.partitionBy(*keys))


def fusion_candidates(groups: DataFrame, b: str, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose scaffolds of B and C occur together at least twice."""
    return groups.withColumn("_n", _n(*by, f"{b}_scaf", f"{c}_scaf")).where("_n >= 2").drop("_n")


def resolve_outgroup_dups(rows: DataFrame, og: str, a: str, b: str, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose outgroup scaffold is settled within their (B, C).

    Where an outgroup scaffold comes twice beside exactly one single, its rows
    with the single's A go; beside several singles all its rows go; what is
    still double goes as well.
    """
    pair = [*by, f"{b}_scaf", f"{c}_scaf"]
    w = W.partitionBy(*pair)
    one = rows.withColumn("_dup", _n(*pair, f"{og}_scaf") > 1)
    one = one.withColumn("_dups", F.count_if("_dup").over(w)).withColumn("_singles", F.count_if(~F.col("_dup")).over(w)).withColumn("_a", F.max(F.when(~F.col("_dup"), F.col(f"{a}_scaf"))).over(w))
    doubtful = F.col("_dup") & (F.col("_dups") > 1) & ((F.col("_singles") > 1) | ((F.col("_singles") == 1) & (F.col(f"{a}_scaf") == F.col("_a"))))
    left = one.where(~doubtful).drop("_dup", "_dups", "_singles", "_a")
    return left.withColumn("_n", _n(*pair, f"{og}_scaf")).where("_n = 1").drop("_n")


def fusion_pairs(rows: DataFrame, og: str, a: str, b: str, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows in one (B, C) and whether they are mixed: A's scaffolds differ, neither row is noise beside the other, and positions overlap in B or C."""
    pair = [*by, f"{b}_scaf", f"{c}_scaf"]
    own = [f"{og}_scaf", f"{a}_scaf", "count", *[f"{s}_{e}" for s in (b, c) for e in ("lo", "hi")]]
    side = lambda k: rows.select(*pair, *[F.col(x).alias(f"{x}_{k}") for x in own])
    both = side(1).join(side(2), pair).where(F.struct(f"{og}_scaf_1", f"{a}_scaf_1") < F.struct(f"{og}_scaf_2", f"{a}_scaf_2"))
    most, least = F.greatest("count_1", "count_2"), F.least("count_1", "count_2")
    odd = (most > 7 * least) & (least <= 10)
    overlap = [ranges_overlap(*[F.col(f"{s}_{e}_{k}") for k in (1, 2) for e in ("lo", "hi")]) for s in (b, c)]
    return both.withColumn("mixed", (F.col(f"{a}_scaf_1") != F.col(f"{a}_scaf_2")) & ~odd & (overlap[0] | overlap[1]))


def fusion_tables(pairs: DataFrame, og: str, a: str, b: str, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows that take part in mixed pairs, and in unmixed pairs: scaffolds, ``count`` and ``mixed``, each once."""
    pair = [*by, f"{b}_scaf", f"{c}_scaf"]
    side = lambda k: pairs.select(*pair, "mixed", *[F.col(f"{x}_{k}").alias(x) for x in (f"{og}_scaf", f"{a}_scaf", "count")])
    return side(1).unionByName(side(2)).distinct()


def hypothesis(groups: DataFrame, og: str, a: str, b: str, c: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``fusion_tables`` from groups, with A as sister."""
    rows = resolve_outgroup_dups(fusion_candidates(groups, b, c, by), og, a, b, c, by)
    return fusion_tables(fusion_pairs(rows, og, a, b, c, by), og, a, b, c, by)


def fusion_stats(tables: DataFrame, b: str, c: str) -> DataFrame:
    """Counts of each (B, C) grouping, sorted, by mixed or not."""
    return tables.groupBy(f"{b}_scaf", f"{c}_scaf", "mixed").agg(F.sort_array(F.collect_list("count")).alias("counts"))


def fusion_members(tables: DataFrame, rbh: DataFrame, species: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per ortholog that a row of ``fusion_tables`` rests on: the table's columns and ``rbh``.

    Names stay rows, as a scaffold tuple may hold any share of the orthologs.
    """
    keys = [*by, *[f"{s}_scaf" for s in species]]
    return tables.join(rbh.select(*keys, "rbh"), keys)


def derived_fissions(groups: DataFrame, species: list[str]) -> DataFrame:
    """Rows that share all scaffolds but that of one ingroup species, once for each such species."""
    parts = []
    for s in species[1:]:
        keys = [f"{x}_scaf" for x in species if x != s]
        parts.append(groups.withColumn("_n", _n(*keys)).where("_n > 1").drop("_n").withColumn("fission_in", F.lit(s)))
    return reduce(DataFrame.unionByName, parts)


def polytomies(groups: DataFrame, species: list[str]) -> DataFrame:
    """Rows whose three ingroup scaffolds occur with more than one outgroup scaffold."""
    return groups.withColumn("_n", _n(*[f"{s}_scaf" for s in species[1:]])).where("_n > 1").drop("_n")


def annotate_support(groups: DataFrame, species: list[str]) -> DataFrame:
    """``data_support``: what each row speaks for, joined in a fixed order; ``singleton`` where nothing."""
    og, ins = species[0], species[1:]
    keys = [f"{s}_scaf" for s in species]
    out, labels = groups, []
    for suffix, mixed in (("sis", True), ("FU", False)):
        for a in ins:
            b, c = [s for s in ins if s != a]
            flag = f"_{a}_{suffix}"
            rows = hypothesis(groups, og, a, b, c).where(F.col("mixed") == mixed).select(*keys).distinct().withColumn(flag, F.lit(True))
            out = out.join(rows, keys, "left")
            labels.append((flag, f"{a}_{suffix}"))
    for a in ins:
        flag = f"_{a}_fis"
        out = out.withColumn(flag, _n(*[f"{s}_scaf" for s in species if s != a]) > 1)
        labels.append((flag, f"{a}_DerFissOrOGfus"))
    out = out.withColumn("_poly", _n(*[f"{s}_scaf" for s in ins]) > 1)
    labels.append(("_poly", f"{'_'.join(ins)}_polytomy"))
    text = F.concat_ws("_", *[F.when(F.col(flag), name) for flag, name in labels])
    return out.withColumn("data_support", F.when(text == "", "singleton").otherwise(text)).drop(*[flag for flag, _ in labels])


def fusion_summary(groups: DataFrame, species: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The five METRICS of each hypothesis (``hyp`` is the sister) from its mixed rows; hypotheses without rows are left out."""
    og, ins = species[0], species[1:]
    parts = []
    for a in ins:
        b, c = [s for s in ins if s != a]
        rows = hypothesis(groups, og, a, b, c, by).where("mixed")
        per = rows.groupBy(*by, f"{b}_scaf", f"{c}_scaf").agg(F.max("count").alias("most"), F.sum("count").alias("sum"), F.count(F.lit(1)).alias("n"))
        most = per.groupBy(*by).agg(
            F.max("most").alias("max_single"),
            F.max("sum").alias("max_grouping"),
            F.sum("sum").alias("total"),
            F.count(F.lit(1)).alias("n_groupings"),
            (F.sum("sum") / F.sum("n")).alias("mean"),
        )
        parts.append(most.where("n_groupings > 0").withColumn("hyp", F.lit(a)))
    return reduce(DataFrame.unionByName, parts)


def fill_summary(summary: DataFrame, keys: DataFrame, species: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``summary`` with zeros for the hypotheses that have no row, for every row of ``keys``."""
    full = keys.withColumn("hyp", F.explode(F.array(*[F.lit(s) for s in species[1:]])))
    return full.join(summary, [*by, "hyp"], "left").na.fill(0).where("total IS NOT NULL")


def fusion_null(rbh: DataFrame, species: list[str], permuted: str, trials: int) -> DataFrame:
    """``fusion_summary`` by trial with one species' scaffolds shuffled among its genes (positions stay)."""
    return placed_null(placed(rbh, species), species, permuted, trials)


def placed(rbh: DataFrame, species: list[str]) -> DataFrame:
    """What the null needs of each ortholog, with its rank by id as ``_place``; one table for all permuted species."""
    return number_rows(rbh.select("rbh", *[f"{s}_{c}" for s in species for c in ("scaf", "pos")]), ["rbh"], "_place")


def placed_null(by_id: DataFrame, species: list[str], permuted: str, trials: int) -> DataFrame:
    """``fusion_null`` of a ``placed`` table: rows meet by their ranks."""
    column = f"{permuted}_scaf"
    moved = dealt_places(by_id, "rbh", trials).join(by_id.select("_place", column), "_place").select(F.col("trial").cast("int").alias("trial"), F.col("_row").alias("_place"), column)
    rows = by_id.where("rbh IS NOT NULL").drop(column, "rbh").join(moved, "_place")
    groups = cut(fusion_groups(rows, species, ("trial",)))
    found = fusion_summary(groups, species, ("trial",)).where("trial IS NOT NULL")
    every = by_id.sparkSession.range(trials).select(F.col("id").cast("int").alias("trial"))
    return fill_summary(found, every, species, ("trial",))


def empirical_p(trials: DataFrame, observed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By hypothesis (and ``by``) and metric: the share of trials that reach the observed value and are not 0 (null: too low to measure), and of two metrics at once."""
    keys = [*(by or []), "hyp"]
    both = trials.join(F.broadcast(observed.select("hyp", *[F.col(m).alias(f"_{m}") for m in METRICS])), "hyp")  # three rows
    hit = lambda m: (F.col(m) >= F.col(f"_{m}")) & (F.col(m) != 0)
    named = [(m, hit(m)) for m in METRICS] + [(f"{a}+{b}", hit(a) & hit(b)) for a, b in combinations(METRICS, 2)]
    shares = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"), *[F.count_if(h).alias(m) for m, h in named])
    long = shares.select(*keys, "n_trials", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("hits")) for m, _ in named])))
    return long.withColumn("p", F.when(F.col("hits") > 0, F.col("hits") / F.col("n_trials")))


def trial_histograms(trials: DataFrame) -> DataFrame:
    """How many trials have each value of each metric."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    return trials.select("hyp", F.inline(rows)).groupBy("hyp", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
