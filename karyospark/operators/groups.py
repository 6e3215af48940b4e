"""Ortholog groups by scaffold tuple: grouping, false-discovery rates, names, unwrapping, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karyospark.functions.color import assign_color

from .hits import number_rows
from .lineage import cut
from .scans import at_or_below, ranked, sorted_parts


#: Orthologs whose values one row of a group table holds.
LIST_ROWS = 10_000


def group_by_scaffolds(rbh: DataFrame, species: list[str], rows: int | None = None) -> DataFrame:
    """Scaffold tuples with their ``count``, and the other columns as arrays in order of ``rbh``; single orthologs stay.

    A group's arrays come in parts of ``rows`` orthologs, numbered from 0 by
    ``part``: a tuple may hold any share of all orthologs, a row may not.
    """
    keys = [f"{s}_scaf" for s in species]
    rest = ["rbh", *[c for c in rbh.columns if c not in keys and c != "rbh"]]
    placed = sorted_parts(rbh.dropna(subset=keys), [*keys, "rbh"])
    part = F.floor(F.col("_place") / (rows or LIST_ROWS)).alias("part")
    parts = ranked(placed, keys, ["rbh"], "_place").groupBy(*keys, part).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_rows"))
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return parts.join(counts, keys).select(*keys, "count", "part", *[F.col(f"_rows.{c}").alias(c) for c in rest])


def group_sizes(rbh: DataFrame, species: list[str]) -> DataFrame:
    """``{sp}_scaf`` and ``count`` only: what most callers need, without gathering lists."""
    keys = [f"{s}_scaf" for s in species]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rbh.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def attach_alpha(groups: DataFrame, fdr: DataFrame) -> DataFrame:
    """``alpha`` of the group's size from ``fdr(size, alpha)``; where it is 0 or missing, that of the next smaller size with one, as ``less_than``.

    Null where no smaller size has a rate.  The table need only hold sizes with
    a rate: groups' sizes are looked up among its steps, whatever lies between.
    """
    steps = fdr.where("alpha > 0").select("size", F.col("alpha").alias("value"))
    known = at_or_below(groups.select(F.col("count").alias("size")), steps).select(F.col("size").alias("count"), "at", F.col("value").alias("alpha"))
    kind = F.when(F.col("at") == F.col("count"), "equal_to").otherwise("less_than")
    return groups.join(known, "count", "left").withColumn("alpha_type", kind).drop("at").select(*groups.columns, "alpha", "alpha_type")


def name_groups(groups: DataFrame, species: list[str], cutoff: float = 0.05) -> DataFrame:
    """``gene_group`` numbered by size, ties by scaffolds; a color for significant groups, black for others."""
    keys = [f"{s}_scaf" for s in species]
    ranked = number_rows(groups.withColumn("_minus", -F.col("count")), ["_minus", *keys], "_rank").drop("_minus")
    name = F.concat(F.lit("_".join(species) + "_"), F.col("_rank"))
    ranked = ranked.withColumn("gene_group", name).drop("_rank")
    return ranked.withColumn("color", F.when(F.col("alpha") <= cutoff, assign_color(F.col("gene_group"))).otherwise("#000000"))


def order_group_columns(groups: DataFrame, species: list[str]) -> DataFrame:
    """The order of a group table: what describes the group, the species' columns sorted, the rest sorted."""
    first = [c for c in ("rbh", "gene_group", "color", "count", "alpha", "alpha_type") if c in groups.columns]
    of_species = sorted(c for c in groups.columns if c.split("_")[0] in species and c not in first)
    return groups.select(*first, *of_species, *sorted(set(groups.columns) - {*first, *of_species}))


def order_profile_columns(rbh: DataFrame, original: list[str], added: list[str]) -> DataFrame:
    """The order of an ortholog table with species added by profile: ``rbh``, annotations, the old species, the new ones."""
    of = lambda names: sorted(c for c in rbh.columns if c != "rbh" and c.split("_")[0] in names)
    old, new = of(original), of(added)
    return rbh.select("rbh", *sorted(set(rbh.columns) - {"rbh", *old, *new}), *old, *new)


def unwrap_groups(groups: DataFrame) -> DataFrame:
    """One row per ortholog again: arrays side by side, other columns repeated, without ``count`` and ``part``."""
    arrays = [c for c, t in groups.dtypes if t.startswith("array")]
    rest = [c for c in groups.columns if c not in arrays and c not in ("count", "part")]
    return groups.select(*rest, F.inline(F.arrays_zip(*arrays)))


def colors_long(rbh: DataFrame, species: list[str]) -> DataFrame:
    """``(species, scaf, pos, gene, color, gene_group, rbh)`` of non-null genes."""
    rows = [F.struct(F.lit(s).alias("species"), F.col(f"{s}_scaf").alias("scaf"), F.col(f"{s}_pos").alias("pos"), F.col(f"{s}_gene").alias("gene")) for s in species]
    return rbh.select(F.inline(F.array(*rows)), "color", "gene_group", "rbh").where("gene IS NOT NULL")


def merge_rbh(tables: list[DataFrame], anchors: list[str]) -> DataFrame:
    """Ortholog tables that share ``anchors`` as one: first value per column in table order, then one row per gene.

    Rows with a null anchor gene go.  For each anchor, then each other species,
    of the rows with one gene that with the fewest nulls stays (ties by anchor
    genes); rows without the species' gene all stay.
    """
    keys = [f"{a}_gene" for a in anchors]
    tables = [t.drop("rbh").withColumn("_table", F.lit(k)) for k, t in enumerate(tables)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    values = [c for c in union.columns if c not in keys and c != "_table"]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    order = F.struct("_table", *[F.col(c).cast("string") for c in values])
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in values]
    merged = union.where(whole).groupBy(*keys).agg(*firsts)
    merged = cut(merged.withColumn("nancount", reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in merged.columns])))
    species = sorted(c[:-5] for c in merged.columns if c.endswith("_gene"))
    for s in [*anchors, *[s for s in species if s not in anchors]]:
        gene = f"{s}_gene"
        best = F.row_number().over(W.partitionBy(gene).orderBy("nancount", *keys))
        kept = merged.where(F.col(gene).isNotNull()).withColumn("_r", best).where("_r = 1").drop("_r")
        merged = cut(kept if s in anchors else kept.unionByName(merged.where(F.col(gene).isNull())))
    return number_rows(merged, keys, "_n").withColumn("rbh", F.concat(F.lit(f"mer_{'_'.join(species)}_"), "_n")).drop("_n")


def fdr_table(observations: DataFrame, permutations: int, most: int | None = None) -> DataFrame:
    """``(size, n, alpha)``: how many permutations showed a size, and their share; observed sizes, or all from 1 to ``most``."""
    seen = observations.groupBy("size").agg(F.sum("n").alias("n"))
    if most is not None:
        sizes = observations.sparkSession.range(1, most + 1).withColumnRenamed("id", "size")
        seen = sizes.join(seen, "size", "left").na.fill(0, ["n"])
    return seen.withColumn("alpha", F.col("n") / F.lit(permutations))


def permuted_by_rank(rbh: DataFrame, species: list[str], permutations: int, row_id: str = "rbh", first: int = 0) -> DataFrame:
    """``(trial, {sp}_scaf..., count)``: tuple sizes with each column but the first dealt by ``shuffle_column``, with the species in the hash."""
    keys = [f"{s}_scaf" for s in species]
    by_id = number_rows(rbh.select(row_id, *keys), [row_id], "_place")
    out = by_id.where(F.col(row_id).isNotNull()).select(F.col("_place").alias("_row"), keys[0]).withColumn("trial", F.explode(F.sequence(F.lit(first), F.lit(first + permutations - 1)).cast("array<bigint>")))
    for s, key in zip(species[1:], keys[1:], strict=True):
        out = out.join(dealt_places(by_id, row_id, permutations, s, first).join(by_id.select("_place", key), "_place").drop("_place"), ["trial", "_row"])
    return out.groupBy("trial", *keys).agg(F.count(F.lit(1)).alias("count"))


def tail_probabilities(observations: DataFrame, keys: list[str], permutations: int) -> DataFrame:
    """``p``: the share of permutations in which a combination has this size or more, never below 1 / permutations."""
    w = W.partitionBy(*keys).orderBy(F.col("size").desc())
    return observations.withColumn("p", F.greatest(F.sum("n").over(w) / F.lit(permutations), F.lit(1 / permutations)))


def shuffle_column(df: DataFrame, column: str, row_id: str, trials: int, salt: str | None = None, first: int = 0) -> DataFrame:
    """``(trial, row_id, column)``: ``trials`` permutations of ``column`` from ``first`` on, the same in every engine.

    In each trial the k-th row by a hash of trial (and ``salt``) and id gets the
    value of the k-th row by id.  All trials are ranked by one sort over range
    partitions; every trial has as many rows.
    """
    by_id = number_rows(df.select(row_id, column), [row_id], "_place")
    moved = dealt_places(by_id, row_id, trials, salt, first).join(by_id.select("_place", column), "_place").drop("_place")
    return moved.join(by_id.select(F.col("_place").alias("_row"), row_id), "_row").select(F.col("trial").cast("int").alias("trial"), row_id, column)


def dealt_places(by_id: DataFrame, row_id: str, trials: int, salt: str | None = None, first: int = 0) -> DataFrame:
    """``(trial, _row, _place)``: in each trial the row with this place by id gets what stands at ``_place`` by id (see ``shuffle_column``).

    ``by_id`` has ids and ``_place``, their rank from 1.  Hashes travel once, as
    bytes; of the sorted rows only the place is written, and a rank tells its trial.
    """
    n = by_id.count()
    both = by_id.select(row_id, F.col("_place").alias("_row")).withColumn("trial", F.explode(F.sequence(F.lit(first), F.lit(first + trials - 1))))
    name = F.concat_ws(":", F.col("trial").cast("string"), *([F.lit(salt)] if salt else []), F.col(row_id).cast("string"))
    hashed = both.select("trial", F.unhex(F.md5(name)).alias("_key"), "_row")
    ranked = number_rows(hashed, ["trial", "_key", "_row"], "_rank", keep=["_row"])
    of_trial = F.floor((F.col("_rank") - 1) / max(n, 1)).cast("bigint")
    return ranked.select((of_trial + first).alias("trial"), "_row", (F.col("_rank") - of_trial * n).alias("_place"))
