"""Small test genomes from large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the repeated word of synthetic genomes.
WORD = "GATTACA"


def downsample_genes(chrom: DataFrame, percent: int = 10) -> DataFrame:
    """Coordinates of a hashed share of the proteins, moved together: lengths a hundredth (10 at least), one after the other."""
    kept = chrom.where((F.conv(F.substring(F.md5("protein"), 1, 8), 16, 10).cast("bigint") % 100) < percent)
    length = F.floor((F.col("stop") - F.col("start")) / 100).cast("bigint")
    rows = kept.withColumn("_len", F.when(length == 0, 10).otherwise(length))
    stop = F.sum("_len").over(W.partitionBy("scaf").orderBy("start", "protein").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_stop", stop).select("protein", "scaf", "strand", (F.col("_stop") - F.col("_len")).alias("start"), F.col("_stop").alias("stop"))


def synthetic_genome(chrom: DataFrame) -> DataFrame:
    """A record per scaffold, long enough for its genes."""
    sizes = chrom.groupBy(F.col("scaf").alias("id")).agg(F.max("stop").alias("size"))
    return sizes.select("id", F.lit("").alias("desc"), F.expr(f"repeat('{WORD}', cast(floor(size / {len(WORD)}) + 2 as int))").alias("seq"))
