"""Mixing sources to target weights by Poisson replication.

A source's target share divided by its share of the corpus is the mean number
of copies of its documents.  Each document inverts the Poisson distribution of
that mean at its own uniform number, a hash of ``doc_id`` and the seed: so
documents decide alone, runs repeat exactly, and no source is gathered or
ranked.  Copies are then dealt over all partitions and ordered inside them by a
hash of document, copy and seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.operators.lineage import cut

TEMPERATURE = 0.5
SEED = 17
HEX_DIGITS = 13
BROADCAST_BYTES = 32 << 20


def _uniform(text: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None) -> DataFrame:
    """``(source, n, rate, least, cdf)``: documents, mean copies and the Poisson distribution from ``least`` copies on.

    ``weights`` are relative; a source that is not named gets weight 0.
    Without them a source of n documents weighs ``n ** temperature``.  ``total``
    is the expected number of copies, by default the number of documents.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        named = [F.when(F.col("source") == k, F.lit(float(w))) for k, w in weights.items()]
        weight = F.coalesce(*named, F.lit(0.0))
    counts = counts.withColumn("weight", weight)
    n, whole = counts.agg(F.sum("n"), F.sum("weight")).first()
    aim = float(total if total is not None else n or 0)
    rate = F.lit(aim) * F.col("weight") / F.lit(whole or 1.0) / F.col("n")
    return counts.withColumn("rate", rate).select("source", "n", "rate", _poisson("rate").alias("poisson")).select("source", "n", "rate", "poisson.*")


def _poisson(rate: str) -> Column:
    """``(least, cdf)``: the Poisson distribution from the count ``least`` on, as ``poisson_cdf`` has it."""

    @F.pandas_udf("least bigint, cdf array<double>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rates in batches:
            rows = [poisson_cdf(r) for r in rates]
            yield pd.DataFrame(rows, columns=["least", "cdf"], index=rates.index)

    return udf(rate)


def poisson_cdf(rate: float) -> tuple[int, np.ndarray]:
    """The least count of the table, and the distribution from there to where it is 1: 12 standard deviations and 20 about the mean.

    Probabilities are relative to the greatest one, as logarithms, so they do
    not vanish where ``exp(-rate)`` does.
    """
    spread = 12 * math.sqrt(rate) + 20
    least, most = max(0, int(rate - spread)), int(rate + spread)
    if rate <= 0:
        return 0, np.ones(1)
    log = np.concatenate([[0.0], np.cumsum(np.log(rate / np.arange(least + 1, most + 1)))])
    total = np.cumsum(np.exp(log - log.max()))
    return least, total / total[-1]


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: int | None = None, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, one row per copy, and ``rate``, ``copy`` (from 1) and ``mix_key``.

    Within each output partition rows stand in order of ``mix_key``, and
    partitions are dealt by it, so reading the output in order reads a global
    shuffle.  Null sources are one source; null ids share one number, as do
    rows with equal ids (their copies are equal in number).  A source with mean
    below 1 loses documents by design; text is never looked at.  An empty table
    gives no rows.  Input columns of the three new names are replaced.
    """
    names = [c for c in docs.columns if c not in ("rate", "copy", "mix_key")]
    rates = cut(source_rates(docs, weights, temperature, total).select("source", "rate", "least", "cdf"))
    size = rates.agg(F.sum(F.size("cdf") * 8 + F.coalesce(F.length("source"), F.lit(0)) + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rates = F.broadcast(rates)  # else a plain join, whose hot sources adaptive execution splits
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*names).alias("row"), F.col("source").alias("of"), text_id.alias("name"))
    drawn = rows.join(rates, rows.of.eqNullSafe(rates.source)).withColumn("u", _uniform(F.concat_ws(":", "name", F.lit(str(seed)))))
    times = (F.col("least") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).cast("int")
    copies = drawn.withColumn("times", times).where("times > 0").select("row", "name", "rate", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", "name", F.col("copy").cast("string"), F.lit(f"order {seed}"))), 1, 15), 16, 10).cast("bigint")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.select("row.*", "rate", "copy", key.alias("mix_key")).repartition(parts, "mix_key").sortWithinPartitions("mix_key")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", F.round("rate", 9).alias("rate"), "copy", "mix_key", F.sha2("text", 256).alias("text_sha256"))


SQL = f"""
WITH n AS (SELECT source, count(*) n, sqrt(count(*)) w FROM documents GROUP BY source),
     r AS (SELECT source, (SELECT sum(n) FROM n) * w / (SELECT sum(w) FROM n) / n AS rate FROM n),
     c AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) cdf FROM r, (SELECT unnest(range(0, CAST((SELECT ceil(max(rate) + 12 * sqrt(max(rate)) + 20) FROM r) AS BIGINT))) AS k) t),
     u AS (SELECT *, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), 1, {HEX_DIGITS})) AS BIGINT) / 4503599627370496.0 u FROM documents),
     t AS (SELECT u.doc_id, u.source, u.text, r.rate, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) times FROM u JOIN r ON r.source IS NOT DISTINCT FROM u.source),
     e AS (SELECT *, CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM t)
SELECT doc_id, source, round(rate, 9) rate, copy, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':' || copy || ':order {SEED}'), 1, 15)) AS BIGINT) mix_key, sha256(text) text_sha256
FROM e"""

QUERIES = {"op8_poisson_mixing": op8_poisson_mixing}
ORACLES = {"op8_poisson_mixing": SQL}
