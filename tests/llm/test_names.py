"""Operators that hand on all columns do so whatever those are called."""

from pyspark.sql import functions as F

from karyospark.llm import bpe, licences, line_dedup, mixing, quality, url_filters

NAMES = "row id drop cut judged lines wrapped both hits u times of name cdf keys hs allow block best h1 shard salt probes n item _text".split()


def test_clashing_names(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("A long line that every document holds, word for word.\nown "), "id").alias("text"), F.lit("s").alias("source"), *[F.lit(n).alias(n) for n in NAMES])
    urls = docs.withColumn("url", F.lit("http://a.net/x"))
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    results = [
        line_dedup.dedup_lines(docs),
        mixing.mix_sources(docs),
        quality.classify(docs, quality.fit(docs)),
        licences.recognise_licences(docs),
        url_filters.judge_urls(urls, rules),
        bpe.encode_documents(docs),
    ]
    for out in results:
        assert set(NAMES) <= set(out.columns)
        first = out.first()
        assert all(first[n] == n for n in NAMES)
    assert results[0].where("n_dropped = 1").count() == 39
