"""Text formats of gene-order work: hits, profile tables, coordinates, FASTA, GFF, ortholog tables.

All schemas are fixed; ids that look like numbers stay strings.  ``""``,
``nan``, ``NaN`` and ``None`` read as null, except in ``gene_group``, where
``None`` is the name of having no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HIT_SCHEMA = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
CHROM_SCHEMA = "protein string, scaf string, strand string, start bigint, stop bigint"
PROFILE_FIELDS = 19
NULLS = ["", "nan", "NaN", "None"]


def read_blast6(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated hits without a header; every line counts."""
    return spark.read.csv(path, sep="\t", header=False, schema=HIT_SCHEMA, mode="FAILFAST")


def read_hmm_tblout(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_hmm_tblout(spark.read.text(path))


def parse_hmm_tblout(lines: DataFrame) -> DataFrame:
    """Profile hits of ``lines.value`` as hit rows; lines other than blanks and comments must have 19 fields."""
    fields = F.split(F.trim(F.translate("value", "\t", " ")), " +")
    rows = lines.where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(fields.alias("f"), "value")
    wrong = F.raise_error(F.concat(F.lit("a profile hit without 19 fields: "), F.col("value")))
    field = lambda k: F.when(F.size("f") >= PROFILE_FIELDS, F.col("f")[k]).otherwise(wrong.cast("string"))
    zero = F.lit(0)
    return rows.select(
        F.regexp_replace(field(2), r"\.aligned", "").alias("qseqid"), field(0).alias("sseqid"), F.lit(50.0).alias("pident"), F.lit(50).alias("length"),
        *[zero.alias(c) for c in ("mismatch", "gapopen", "qstart", "qend", "sstart", "send")], field(4).cast("double").alias("evalue"), field(5).cast("double").alias("bitscore"),
    )


def read_chrom(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Gene coordinates with ``middle``; of lines that share a protein the last one stays."""
    return chrom_with_middle(with_line(spark.read.csv(path, sep="\t", header=False, schema=CHROM_SCHEMA)), "line")


def with_line(rows: DataFrame) -> DataFrame:
    """Rows just read from text files with ``line``, which grows along each file, files by name."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("line"))


def chrom_with_middle(chrom: DataFrame, line: str | None = None) -> DataFrame:
    """Gene coordinates with ``middle``; of rows that share a protein the last by ``line``, or by position, stays."""
    rest = [c for c in chrom.columns if c not in ("protein", line)]
    order = [F.col(line)] if line else []
    last = chrom.groupBy("protein").agg(F.max(F.struct(*order, "scaf", "start", "stop", *[c for c in rest if c not in ("scaf", "start", "stop")])).alias("r"))
    return last.select("protein", *[F.col(f"r.{c}").alias(c) for c in rest]).withColumn("middle", F.floor(F.col("start") + (F.col("stop") - F.col("start")) / 2))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(id, desc, seq)``, one record a row; records without sequence go."""
    return parse_fasta(spark.read.text(path, lineSep="\n>"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """Records from ``value`` (header line, then sequence lines), the leading ``>`` being optional."""
    value = F.regexp_replace("value", r"\A>", "")
    head = F.regexp_extract(value, r"\A([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace(value, r"\A[^\n]*", ""), r"\s", "")
    out = records.select(F.regexp_extract(head, r"\A(\S*)", 1).alias("id"), F.btrim(F.regexp_replace(head, r"\A\S*", ""), F.lit(" \t\r")).alias("desc"), seq.alias("seq"))
    return out.where((F.col("seq") != "") & (F.col("id") != ""))


def fasta_text(records: DataFrame, wrap: int | None = 80) -> DataFrame:
    """``value``: a record as text, its sequence in lines of ``wrap`` letters (0 or None: one line)."""
    head = F.concat(F.lit(">"), F.col("id"), F.when(F.coalesce("desc", F.lit("")) != "", F.concat(F.lit(" "), F.col("desc"))).otherwise("")) if "desc" in records.columns else F.concat(F.lit(">"), "id")
    body = F.regexp_replace("seq", f"(.{{{wrap}}})(?!\\z)", "$1\n") if wrap else F.col("seq")
    return records.select(F.concat(head, F.lit("\n"), body).alias("value"))


def write_fasta(records: DataFrame, path: str, wrap: int | None = 80) -> None:
    fasta_text(records, wrap).write.text(path)


def parse_ncbi_gff(lines: DataFrame) -> DataFrame:
    """Gene coordinates of ``lines(value, line)``: coding lines with a protein id; scaffold and strand are of the first line."""
    f = F.split("value", "\t", -1)
    rows = lines.select("line", f.alias("f")).where((F.size("f") > 7) & (F.get("f", F.lit(2)) == "CDS") & F.get("f", F.lit(8)).contains("protein_id="))
    rows = rows.select("line", F.regexp_extract(F.col("f")[8], r"(?:^|;)protein_id=([^;]*)", 1).alias("protein"), F.col("f")[0].alias("scaf"), F.col("f")[6].alias("strand"), F.col("f")[3].cast("bigint").alias("start"), F.col("f")[4].cast("bigint").alias("stop"))
    return rows.groupBy("protein").agg(F.min_by("scaf", "line").alias("scaf"), F.min_by("strand", "line").alias("strand"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def read_ncbi_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path)
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return parse_ncbi_gff(lines.select("value", order.alias("line")))


def chromsizes(records: DataFrame, species: str) -> DataFrame:
    """``(species, scaf, len)`` of genome records."""
    return records.groupBy(F.col("id").alias("scaf")).agg(F.sum(F.length("seq")).alias("len")).select(F.lit(species).alias("species"), "scaf", "len")


def _null(column: Column) -> Column:
    return F.when(~F.trim(column).isin(NULLS), column)


def read_rbh(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """An ortholog table with header; all columns strings but positions."""
    return normalise_rbh(spark.read.csv(path, sep="\t", header=True, inferSchema=False))


def normalise_rbh(rows: DataFrame) -> DataFrame:
    cols = [F.coalesce(F.col(c), F.lit("None")).alias(c) if c == "gene_group" else _null(F.col(c).cast("string")).alias(c) for c in rows.columns]
    out = rows.select(*cols)
    return out.select(*[F.expr(f"try_cast(try_cast(`{c}` as double) as bigint)").alias(c) if c.endswith("_pos") else F.col(c) for c in out.columns])


def write_rbh(rbh: DataFrame, path: str) -> None:
    rbh.write.csv(path, sep="\t", header=True)


def write_groupby(groups: DataFrame, path: str) -> None:
    """Groups as text: arrays as JSON."""
    groups.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in groups.dtypes]).write.csv(path, sep="\t", header=True, escape='"')


def read_groupby(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    return parse_groupby(spark.read.csv(path, sep="\t", header=True, escape='"', inferSchema=False), lists)


def parse_groupby(rows: DataFrame, lists: list[str]) -> DataFrame:
    """List columns from text: quoted lists of either quote; ``nan`` inside is null; a bare value stands ``count`` times."""
    rows = rows.withColumn("count", F.col("count").cast("bigint"))

    def parsed(c: str) -> Column:
        text = F.trim(F.col(c))
        json = F.regexp_replace(F.regexp_replace(text, "'", '"'), r"(?<=[\[,])\s*(nan|None)\s*(?=[,\]])", "null")
        return F.when(text.startswith("["), F.from_json(json, "array<string>")).otherwise(F.array_repeat(text, F.col("count").cast("int")))

    return rows.select(*[parsed(c).alias(c) if c in lists else F.col(c) for c in rows.columns])


def read_genome_coords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", header=False, schema="scaf string, len bigint, cumsum bigint, plotstart bigint")


def genome_coords(sizes: DataFrame) -> DataFrame:
    """``sizes(scaf, len, rank)`` as ``(scaf, len, cumsum, plotstart)``."""
    total = F.sum("len").over(W.orderBy("rank"))  # a row a scaffold
    return sizes.select("scaf", "len", total.alias("cumsum"), (total - F.col("len")).alias("plotstart"))


def rbh_to_fasta_bundle(long: DataFrame, proteins: DataFrame, buckets: int = 64) -> DataFrame:
    """``(rbh, bucket, n, value)``: the member sequences of each ortholog as FASTA text, named ``{rbh}_{species}``.

    ``long(rbh, species, gene)``, ``proteins(species, gene, seq)``.  Write it with
    ``partitionBy("bucket")``: one file an ortholog would be too many.
    """
    rows = long.join(proteins, ["species", "gene"]).withColumn("value", F.concat(F.lit(">"), "rbh", F.lit("_"), "species", F.lit("\n"), "seq"))
    texts = rows.groupBy("rbh").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("value"))
    return texts.withColumn("bucket", F.pmod(F.xxhash64("rbh"), F.lit(buckets)).cast("int"))
