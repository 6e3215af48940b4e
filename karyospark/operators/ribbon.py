"""Coordinates of ribbon diagrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ribbon_gene_index(tables: list[DataFrame], species: str) -> DataFrame:
    """``(scaf, gene, pos, ix)``: the species' genes in all tables, each once, ranked on their scaffold."""
    s = species
    rows = [t.select(F.col(f"{s}_scaf").alias("scaf"), F.col(f"{s}_gene").alias("gene"), F.col(f"{s}_pos").alias("pos")) for t in tables if f"{s}_gene" in t.columns]
    genes = reduce(DataFrame.unionByName, rows).where("gene IS NOT NULL").groupBy("gene").agg(F.min(F.struct("scaf", "pos")).alias("p")).select("p.scaf", "gene", "p.pos")
    return genes.withColumn("ix", (F.row_number().over(W.partitionBy("scaf").orderBy("pos", "gene")) - 1).cast("bigint"))


def ribbon_chrom_layout(chroms: DataFrame) -> DataFrame:
    """``chroms(species, scaf, rank, bp, genes)`` with shares of the width and offsets from 0 to 1, in both units.

    Gaps take 0.12 of the width below ten chromosomes, 0.5 above fifty, and in
    between in proportion; a single chromosome has none.
    """
    every, w = W.partitionBy("species"), W.partitionBy("species").orderBy("rank")
    n = F.count(F.lit(1)).over(every)
    gap = F.when(n < 10, 0.12).when(n > 50, 0.5).otherwise(0.12 + (n - 10) / 40 * 0.38)
    gap = F.when(n == 1, 0.0).otherwise(gap)
    each = F.when(n > 1, gap / (n - 1)).otherwise(0.0)
    ix = F.row_number().over(w) - 1
    out = chroms
    for unit in ("bp", "genes"):
        share = F.col(unit) / F.nullif(F.sum(unit).over(every), F.lit(0)) * (1 - gap)
        before = F.coalesce(F.sum(unit).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) / F.nullif(F.sum(unit).over(every), F.lit(0)) * (1 - gap)
        out = out.withColumn(f"{unit}_share", share).withColumn(f"{unit}_offset", before + each * ix)
    return out


def ribbon_segments(rbh: DataFrame, top: str, bottom: str, layout: DataFrame, index: dict[str, DataFrame], p: str = "whole_FET", plot_all: bool = False, cutoff: float = 0.05) -> DataFrame:
    """Top and bottom x of each ortholog between two neighbouring species, in both units, and its opacity."""
    rows = rbh if plot_all else rbh.where(F.col(p) <= cutoff)
    for s in (top, bottom):
        place = layout.where(F.col("species") == s).select(F.col("scaf").alias(f"{s}_scaf"), *[F.col(c).alias(f"_{c}") for c in ("bp", "genes", "bp_share", "bp_offset", "genes_share", "genes_offset")])
        ranks = index[s].select(F.col("gene").alias(f"{s}_gene"), F.col("ix").alias("_ix"))
        rows = rows.join(place, f"{s}_scaf").join(ranks, f"{s}_gene")
        rows = rows.withColumn(f"{s}_x_bp", F.col("_bp_offset") + F.col(f"{s}_pos") / F.col("_bp") * F.col("_bp_share")).withColumn(f"{s}_x_genes", F.col("_genes_offset") + F.col("_ix") / F.col("_genes") * F.col("_genes_share"))
        rows = rows.drop("_bp", "_genes", "_bp_share", "_bp_offset", "_genes_share", "_genes_offset", "_ix")
    return rows.withColumn("opacity", F.when(F.col(p) <= cutoff, 0.8).otherwise(0.1))


def match_ribbon_tables(tables: dict[tuple[str, str], DataFrame], species: list[str]) -> list[DataFrame]:
    """The table of each two neighbouring species, kept under their sorted names."""
    missing = [tuple(sorted(p)) for p in zip(species, species[1:], strict=False) if tuple(sorted(p)) not in tables]
    if missing:
        raise ValueError(f"no table for {missing}")
    return [tables[tuple(sorted(p))] for p in zip(species, species[1:], strict=False)]
