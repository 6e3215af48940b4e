"""Checks of inputs: each gives a table of violations, empty where all is well."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from karyospark.functions.color import is_valid_hex

EXAMPLES = 3


def examples(column: Column) -> Column:
    """The first few distinct values."""
    return F.slice(F.sort_array(F.collect_set(column)), 1, EXAMPLES)


def _violations(rows: DataFrame, rules: dict[str, Column], shown: str) -> DataFrame:
    """``(rule, n, examples)``; examples are the least values, combined before the shuffle by rank in partitions."""
    broken = rows.select(F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())).alias("rule"), F.col(shown).alias("_shown"))
    least = broken.distinct().withColumn("_r", F.row_number().over(W.partitionBy("rule").orderBy("_shown"))).where(F.col("_r") <= EXAMPLES)
    top = least.groupBy("rule").agg(F.sort_array(F.collect_list("_shown")).alias("examples"))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(top, "rule")


def validate_chrom(lines: DataFrame) -> DataFrame:
    """Rules over the five text fields of gene coordinates."""
    fields = ["protein", "scaf", "strand", "start", "stop"]
    edge = [F.col(c).rlike(r"\A\s|\s\z") for c in fields]
    header = [F.lower(c).isin("pid", "scaf", "strand", "start", "stop") for c in fields]
    any_of = lambda cs: cs[0] | cs[1] | cs[2] | cs[3] | cs[4]
    rules = {
        "blank at an edge": any_of(edge),
        "header": any_of(header),
        "strand": ~F.col("strand").isin("+", "-", "."),
        "start is no number": ~F.col("start").rlike(r"\A[0-9]+\z"),
        "stop is no number": ~F.col("stop").rlike(r"\A[0-9]+\z"),
    }
    return _violations(lines, rules, "protein")


def refuse(violations: DataFrame, shown: str, what: str) -> None:
    """Raises with the first few values of ``shown`` where there are violations."""
    found = [str(r[0]) for r in violations.select(shown).distinct().orderBy(shown).limit(EXAMPLES).collect()]
    if found:
        raise ValueError(f"{what}, such as {', '.join(found)}")


def require_columns(table: DataFrame, columns: list[str]) -> None:
    """Raises where a column is missing."""
    if missing := [c for c in columns if c not in table.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def check_proteins(records: DataFrame, duplicates: str = "fail") -> None:
    """Raises where an id comes twice, and where two ids have one sequence unless ``duplicates`` is ``pass``."""
    if duplicates not in ("fail", "pass"):
        raise ValueError(f"duplicate proteins may fail or pass, not {duplicates}")
    refuse(duplicate_ids(records), "id", "protein ids come more than once")
    if duplicates == "fail":
        refuse(duplicate_sequences(records), "id", "proteins have an earlier one's sequence")


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Header ids that come more than once."""
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_sequences(records: DataFrame) -> DataFrame:
    """Ids whose sequence an earlier id has, with that id; sequences are shuffled as digests only."""
    hashed = records.select("id", F.sha2("seq", 256).alias("digest"))
    first = F.min("id").over(W.partitionBy("digest"))
    return hashed.withColumn("first_id", first).where("id <> first_id").select("id", "first_id")


def validate_chrom_refs(chrom: DataFrame, proteins: DataFrame, genome: DataFrame) -> DataFrame:
    """Proteins and scaffolds of the coordinates that the sequence files lack."""
    no_protein = chrom.join(proteins, chrom.protein == proteins.id, "left_anti").select(F.lit("protein").alias("kind"), F.col("protein").alias("name"))
    no_scaffold = chrom.join(genome, chrom.scaf == genome.id, "left_anti").select(F.lit("scaffold").alias("kind"), F.col("scaf").alias("name"))
    return no_protein.unionByName(no_scaffold).distinct()


def filter_proteins_to_chrom(records: DataFrame, chrom: DataFrame, order: str = "id") -> DataFrame:
    """Records whose id has coordinates, the first of each id by ``order``, without description."""
    kept = records.join(chrom, records.id == chrom.protein, "left_semi")
    return kept.groupBy("id").agg(F.min_by("seq", order).alias("seq"))


def validate_lg_db(rbh: DataFrame, profiles: DataFrame) -> DataFrame:
    """Names on one side only: ``(name, missing_in)``.  Raises where ``rbh`` has no names, groups or colors."""
    require_columns(rbh, ["rbh", "gene_group", "color"])
    a, b = rbh.select(F.col("rbh").alias("name")), profiles.select("name")
    return a.join(b, "name", "left_anti").withColumn("missing_in", F.lit("profiles")).unionByName(b.join(a, "name", "left_anti").withColumn("missing_in", F.lit("rbh"))).distinct()


def validate_rbh_annotations(rbh: DataFrame, found: DataFrame, species: list[str], missing_ok: bool = True) -> DataFrame:
    """Rows without group or color, with an invalid color, or with another number of sequences than genes.

    ``found(rbh, n)`` counts sequences; without ``missing_ok`` each species must have one.
    """
    genes = sum((F.col(f"{s}_gene").isNotNull().cast("int") for s in species), F.lit(0)) if missing_ok else F.lit(len(species))
    rows = rbh.join(found, "rbh", "left")
    rules = {"no gene_group": F.col("gene_group").isNull(), "no color": F.col("color").isNull(), "invalid color": ~is_valid_hex(F.col("color")), "sequences": F.coalesce("n", F.lit(0)) != genes}
    return _violations(rows, rules, "rbh")


def duplicate_species_columns(rbh: DataFrame, species: list[str]) -> list[str]:
    """Species to drop: their gene column equals an earlier species' in every row (nulls are unequal)."""
    pairs = list(combinations(sorted(species), 2))
    same = rbh.agg(*[F.bool_and(F.coalesce(F.col(f"{a}_gene") == F.col(f"{b}_gene"), F.lit(False))).alias(f"{a}|{b}") for a, b in pairs]).first()
    return sorted({b for a, b in pairs if same[f"{a}|{b}"]})


def drop_duplicate_species_columns(rbh: DataFrame, species: list[str]) -> DataFrame:
    return rbh.drop(*[f"{s}_{c}" for s in duplicate_species_columns(rbh, species) for c in ("gene", "scaf", "pos")])


def analysis_pairs(species: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Unordered pairs of ``species.species``, or those that touch ``only``."""
    a, b = species.select(F.col("species").alias("a")), species.select(F.col("species").alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b"))  # a row a species
    return pairs.where(F.col("a").isin(only) | F.col("b").isin(only)) if only else pairs
