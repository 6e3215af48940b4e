"""Orders of scaffolds for plots, and linkage-group matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .coords import chrom_order_by_size


def ranked_order(df: DataFrame, *order) -> DataFrame:
    """``(scaf, rank)`` from 0; a row a scaffold."""
    return df.select("scaf", (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint").alias("rank"))


def chrom_order_optimized(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Order of the other species: each scaffold goes where its best partner by p stands, then by p, then by name.

    ``pairs(ref_scaf, scaf, p)``; ``reference(scaf, rank)``.
    """
    placed = pairs.join(reference.select(F.col("scaf").alias("ref_scaf"), F.col("rank").alias("_at")), "ref_scaf")
    best = placed.groupBy("scaf").agg(F.min(F.struct("p", "_at")).alias("b"))
    return ranked_order(best, "b._at", "b.p", "scaf")


def chrom_order_modes(mode: str, rbh: DataFrame, species: list[str], pairs: dict[tuple[str, str], DataFrame], custom: dict[str, DataFrame] | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """Orders of all species from top to bottom.

    ``optimal-size``: every species by size.  ``optimal-top``: the first by
    size, the others by their neighbour above.  ``optimal-chr-or``: the first
    species with a custom order leads in both directions; ``optimal-random``:
    the first in hashed order.  ``custom``: as given, else by size.
    """
    size = {s: chrom_order_by_size(rbh, s).select("scaf", "rank") for s in species}
    custom = custom or {}
    if mode == "optimal-size":
        return size
    if mode == "custom":
        return {s: custom.get(s, size[s]) for s in species}
    lead = next((k for k, s in enumerate(species) if s in custom), 0) if mode == "optimal-chr-or" else 0
    first = custom.get(species[lead], size[species[lead]]) if mode == "optimal-chr-or" else size[species[lead]]
    if mode == "optimal-random":
        first = ranked_order(size[species[lead]], F.md5(F.concat(F.lit(f"{seed}:"), "scaf")), "scaf")
    out = {species[lead]: first}
    for k in [*range(lead + 1, len(species)), *range(lead - 1, -1, -1)]:
        beside = species[k - 1] if k > lead else species[k + 1]
        out[species[k]] = custom.get(species[k]) if species[k] in custom else chrom_order_optimized(pairs[beside, species[k]], out[beside])
    return out


def y_order_by_x(rbh: DataFrame, x: str, y: str, x_order: DataFrame) -> DataFrame:
    """Scaffolds of y by the place of their most frequent x scaffold, then by the x position of the first gene there."""
    counts = rbh.groupBy(f"{y}_scaf", f"{x}_scaf").agg(F.count(F.lit(1)).alias("n"), F.min_by(f"{x}_pos", F.struct(f"{y}_pos", f"{y}_gene")).alias("first"))
    modal = counts.groupBy(F.col(f"{y}_scaf").alias("scaf")).agg(F.min_by(F.struct(F.col(f"{x}_scaf").alias("x"), F.col("first")), F.struct(-F.col("n"), f"{x}_scaf")).alias("m"))
    placed = modal.join(x_order.select(F.col("scaf").alias("_x"), F.col("rank").alias("_at")), F.col("m.x") == F.col("_x"))
    return ranked_order(placed, "_at", "m.first", "scaf")


def scaffold_components(pairs: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """``(name, component)`` of scaffolds ``x:...`` and ``y:...`` that significant pairs link."""
    edges = pairs.where(F.col("p") <= cutoff).select(F.concat(F.lit("x:"), "x_scaf").alias("a"), F.concat(F.lit("y:"), "y_scaf").alias("b"))
    return connected_components(edges).select(F.col("node").alias("name"), F.col("root").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    """How many components have each number of members."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def dotplot_order(pairs: DataFrame, x_sizes: DataFrame, y_index: DataFrame, cutoff: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Orders of x and y in which linked scaffolds stand together.

    ``pairs(x_scaf, y_scaf, p)`` of all observed pairs; ``x_sizes(scaf, rank)``
    by gene count; ``y_index(x_scaf, y_scaf, mean_ix)``.  Components stand in
    the order of their largest x; a y without significant partner joins its
    best x, an x without is alone.  Within a component x go by size, and y by
    the first x that has them, then by their mean place on it.
    """
    names = scaffold_components(pairs, cutoff)
    of = lambda side: names.where(F.col("name").startswith(f"{side}:")).select(F.expr("substring(name, 3)").alias("scaf"), "component")
    xs = x_sizes.join(of("x"), "scaf", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("alone:"), "scaf")))
    lead = xs.groupBy("component").agg(F.min("rank").alias("_lead"))
    xs = xs.join(lead, "component")
    x_order = ranked_order(xs, "_lead", "rank")
    y = pairs.groupBy("y_scaf").agg(F.min_by("x_scaf", F.struct("p", "x_scaf")).alias("_best")).join(of("y"), F.col("y_scaf") == F.col("scaf"), "left").select("y_scaf", "_best", "component")
    y = y.join(xs.select(F.col("scaf").alias("_best"), F.col("component").alias("_joined")), "_best", "left").withColumn("component", F.coalesce("component", "_joined"))
    places = pairs.join(x_order.select(F.col("scaf").alias("x_scaf"), F.col("rank").alias("_x")), "x_scaf").join(xs.select(F.col("scaf").alias("x_scaf"), "component", "_lead"), "x_scaf")
    places = places.join(y.select("y_scaf", F.col("component").alias("_own")), "y_scaf").where(F.col("component") == F.col("_own")).join(y_index, ["x_scaf", "y_scaf"])
    first = places.groupBy(F.col("y_scaf").alias("scaf")).agg(F.min(F.struct("_x", "mean_ix")).alias("f"))
    return x_order, ranked_order(first, "f._x", "f.mean_ix", "scaf")


def match_species_to_lg(genes: DataFrame, lg: DataFrame, species: list[str]) -> str | None:
    """The linkage-group species whose genes a plot shows: the only one found, or the first with ten times the second's, or one of a tie."""
    found = lg.select(F.inline(F.array(*[F.struct(F.lit(s).alias("species"), F.col(f"{s}_gene").alias("gene")) for s in species]))).join(genes.select("gene").distinct(), "gene", "left_semi")
    counts = sorted(((r["n"], r["species"]) for r in found.groupBy("species").agg(F.count_distinct("gene").alias("n")).collect()), key=lambda r: (-r[0], r[1]))  # a row a species
    if not counts:
        return None
    if len(counts) == 1 or counts[0][0] >= 10 * counts[1][0] or counts[0][0] == counts[1][0]:
        return counts[0][1]
    return None


#: Rows of the two tables that a task of ``color_by_lg`` gets, whatever the tables' size.
TASK_ROWS = 1 << 19


def color_by_ids_or_hits(long: DataFrame, by_id: DataFrame, by_hit: DataFrame, species: list[str]) -> DataFrame:
    """``color_by_lg`` from the ids of linkage-group members if any gene is one, else from profile hits."""
    known = not long.join(by_id, "gene", "left_semi").isEmpty()
    return color_by_lg(long, by_id if known else by_hit, species)


def color_by_lg(long: DataFrame, names: DataFrame, species: list[str]) -> DataFrame:
    """``gene_group`` and ``color`` per ortholog: of the last species whose gene has a group or a color, else ``None`` and black.

    ``long(rbh, species, gene)``; ``names(gene, gene_group, color)`` from ids or from hits.
    Rows are dealt to counted parts, so that a task sorts no more of a larger table.
    """
    parts = 1 + max(long.count(), names.count()) // TASK_ROWS
    at = F.element_at(F.create_map(*[x for k, s in enumerate(species) for x in (F.lit(s), F.lit(k))]), F.col("species"))
    found = long.select("rbh", "species", "gene").repartition(parts, "gene").join(names.select("gene", "gene_group", "color").repartition(parts, "gene"), "gene", "left")
    rows = found.drop("gene").repartition(parts, "rbh")
    group = F.max_by("gene_group", F.when(F.col("gene_group").isNotNull() & (F.col("gene_group") != "None"), at))
    color = F.max_by("color", F.when(F.col("color").isNotNull() & (F.lower("color") != "#000000"), at))
    return rows.groupBy("rbh").agg(F.coalesce(group, F.lit("None")).alias("gene_group"), F.coalesce(color, F.lit("#000000")).alias("color"))
