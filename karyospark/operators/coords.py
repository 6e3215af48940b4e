"""Coordinates, breaks, indices and plot positions of ortholog tables.

An ortholog table is wide (``rbh, gene_group, color, {sp}_gene, {sp}_scaf,
{sp}_pos``); ``to_long`` and ``to_wide`` change its shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scans import PART, ranked, sorted_parts

#: Fixed value: the end of an open last interval.
LAST = 9_999_999_999


def species_of(rbh: DataFrame, suffix: str = "_scaf") -> list[str]:
    """Species by their column suffix."""
    return sorted(c[: -len(suffix)] for c in rbh.columns if c.endswith(suffix))


def to_long(rbh: DataFrame, species: list[str]) -> DataFrame:
    """``(rbh, species, gene, scaf, pos)`` for non-null genes."""
    rows = [F.struct(F.lit(s).alias("species"), F.col(f"{s}_gene").alias("gene"), F.col(f"{s}_scaf").alias("scaf"), F.col(f"{s}_pos").alias("pos")) for s in species]
    return rbh.select("rbh", F.inline(F.array(*rows))).where("gene IS NOT NULL")


def to_wide(long: DataFrame, species: list[str]) -> DataFrame:
    """One row per ``rbh`` with ``{sp}_gene/_scaf/_pos``."""
    one = lambda s, c: F.first(F.when(F.col("species") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}")
    return long.groupBy("rbh").agg(*[one(s, c) for s in species for c in ("gene", "scaf", "pos")])


def annotate_coords(genes: DataFrame, chrom: DataFrame, species: list[str]) -> DataFrame:
    """``genes(rbh, {sp}_gene)`` with ``{sp}_scaf`` and ``{sp}_pos`` (the start); null where unknown."""
    rows = [F.struct(F.lit(s).alias("species"), F.col(f"{s}_gene").alias("gene")) for s in species]
    long = genes.select("rbh", F.inline(F.array(*rows)))
    places = chrom.select("species", F.col("protein").alias("gene"), "scaf", F.col("start").alias("pos"))
    return to_wide(long.join(places, ["species", "gene"], "left"), species)


def annotate_gene_group(rbh: DataFrame, groups: DataFrame, species: list[str]) -> DataFrame:
    """``gene_group`` by the members found in ``groups(gene, gene_group)``; the last species by order wins, else ``None``."""
    order = F.create_map(*[x for k, s in enumerate(species) for x in (F.lit(s), F.lit(k))])
    found = to_long(rbh, species).join(groups, "gene").groupBy("rbh").agg(F.max_by("gene_group", F.element_at(order, F.col("species"))).alias("gene_group"))
    return rbh.drop("gene_group").join(found, "rbh", "left").withColumn("gene_group", F.coalesce("gene_group", F.lit("None")))


def break_intervals(breaks: DataFrame) -> DataFrame:
    """``(species, scaf, lo, hi, label)``: half-open pieces between manual breaks, the last one open."""
    edges = breaks.select("species", "scaf", F.col("break_pos").cast("bigint").alias("lo")).unionByName(breaks.select("species", "scaf").distinct().withColumn("lo", F.lit(0).cast("bigint"))).distinct()
    hi = F.lead("lo").over(W.partitionBy("species", "scaf").orderBy("lo"))
    edges = edges.withColumn("hi", F.coalesce(hi, F.lit(LAST)))
    label = F.concat("scaf", F.lit(":"), "lo", F.lit("-"), F.when(F.col("hi") == LAST, "end").otherwise(F.col("hi").cast("string")))
    return edges.withColumn("label", label)


def assign_breakchrom(rbh: DataFrame, breaks: DataFrame, species: str) -> DataFrame:
    """``{species}_breakchrom``: the piece of its scaffold that a gene lies in; ``scaf:0-end`` without breaks."""
    pieces = break_intervals(breaks).where(F.col("species") == species).select(F.col("scaf").alias("_scaf"), "lo", "hi", "label")
    scaf, pos = F.col(f"{species}_scaf"), F.col(f"{species}_pos")
    # manual breaks are typed by hand: a few per scaffold
    joined = rbh.join(pieces, (scaf == F.col("_scaf")) & (F.col("lo") <= pos) & (pos < F.col("hi")), "left")
    return joined.withColumn(f"{species}_breakchrom", F.coalesce("label", F.concat(scaf, F.lit(":0-end")))).drop("_scaf", "lo", "hi", "label")


def gene_index(rbh: DataFrame, species: str) -> DataFrame:
    """``{sp}_ix`` and ``{sp}_break_ix``: 0-based ranks in the scaffold and in its piece, by position, then gene.

    One sort over range partitions gives both, as a piece lies in one scaffold.
    """
    s = species
    order = [f"{s}_pos", f"{s}_gene"]
    placed = sorted_parts(rbh, [f"{s}_scaf", *order])
    rows = ranked(placed, [f"{s}_scaf"], order, f"{s}_ix")
    return ranked(placed, [f"{s}_breakchrom"], order, f"{s}_break_ix", rows).drop(PART)


def scaffold_offsets(sizes: DataFrame) -> DataFrame:
    """``sizes(species, scaf, len, rank)`` with the running ``offset``, the ``tick`` at the middle and the species' ``total``."""
    w = W.partitionBy("species").orderBy("rank")
    before = F.coalesce(F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("offset", before).withColumn("tick", F.col("offset") + F.col("len") / 2).withColumn("total", F.sum("len").over(W.partitionBy("species")))


def chrom_order_by_size(rbh: DataFrame, species: str) -> DataFrame:
    """``(scaf, n, rank)``: scaffolds by their number of genes, ties by name, from 0."""
    counts = rbh.where(F.col(f"{species}_scaf").isNotNull()).groupBy(F.col(f"{species}_scaf").alias("scaf")).agg(F.count(F.lit(1)).alias("n"))
    # one row a scaffold
    return counts.withColumn("rank", (F.row_number().over(W.orderBy(F.col("n").desc(), "scaf")) - 1).cast("bigint"))


def plot_coordinates(rbh: DataFrame, species: str, order: DataFrame, sizes: DataFrame) -> DataFrame:
    """``{sp}_plotindex`` (0-based over scaffolds in order) and ``{sp}_plotpos`` (scaffold offset plus position).

    The global index is the rank in the scaffold, from sorted parts, plus the
    genes of the scaffolds before it.
    """
    s = species
    w = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    placed = order.join(sizes.where(F.col("species") == s).select("scaf", "len"), "scaf")
    starts = placed.select(F.col("scaf").alias(f"{s}_scaf"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_genes"), F.coalesce(F.sum("len").over(w), F.lit(0)).alias("_offset"))
    order = [f"{s}_pos", f"{s}_gene"]
    inside = ranked(sorted_parts(rbh, [f"{s}_scaf", *order]), [f"{s}_scaf"], order, "_inside").drop(PART)
    out = inside.join(starts, f"{s}_scaf")
    return out.withColumn(f"{s}_plotindex", F.col("_genes") + F.col("_inside")).withColumn(f"{s}_plotpos", F.col("_offset") + F.col(f"{s}_pos")).drop("_genes", "_offset", "_inside")


def axis_annotations(plotted: DataFrame, species: str) -> DataFrame:
    """Per scaffold least, greatest and middle plot index, and the divider after it (null after the last)."""
    s = species
    ends = plotted.groupBy(F.col(f"{s}_scaf").alias("scaf")).agg(F.min(f"{s}_plotindex").alias("first"), F.max(f"{s}_plotindex").alias("last"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy("first")  # one row a scaffold
    divider = F.when(F.lead("first").over(w).isNotNull(), F.col("last") + 0.5)
    return ends.withColumn("middle", F.col("first") + (F.col("last") - F.col("first")) / 2).withColumn("divider", divider).withColumn("genes_so_far", F.sum("n").over(w))


def break_lines(plotted: DataFrame, species: str) -> DataFrame:
    """Plot indices where a piece ends inside its scaffold."""
    s = species
    ends = plotted.where(~F.col(f"{s}_breakchrom").endswith("end")).groupBy(F.col(f"{s}_scaf").alias("scaf"), F.col(f"{s}_breakchrom").alias("breakchrom"))
    last = plotted.groupBy(F.col(f"{s}_scaf").alias("scaf")).agg(F.max(f"{s}_plotindex").alias("_last"))
    return ends.agg(F.max(f"{s}_plotindex").alias("last")).join(last, "scaf").where("last <> _last").select("scaf", "breakchrom", (F.col("last") + 0.5).alias("line"))


def filter_scaffolds(rbh: DataFrame, sizes: DataFrame, species: list[str]) -> DataFrame:
    """Rows whose scaffolds are all in the size table."""
    for s in species:
        rbh = rbh.join(sizes.where(F.col("species") == s).select(F.col("scaf").alias(f"{s}_scaf")), f"{s}_scaf", "left_semi")
    return rbh


def filter_min_scaf_size(sizes: DataFrame, least: int = 5000, only: list[str] | None = None) -> DataFrame:
    """Scaffolds of at least this length, or just those listed."""
    return sizes.where(F.col("scaf").isin(only)) if only else sizes.where(F.col("len") >= least)


def pseudo_chromsizes(rbh: DataFrame, species: str) -> DataFrame:
    """Scaffold sizes where no genome exists: the greatest position."""
    return rbh.groupBy(F.col(f"{species}_scaf").alias("scaf")).agg(F.max(f"{species}_pos").alias("len")).select(F.lit(species).alias("species"), "scaf", "len")
