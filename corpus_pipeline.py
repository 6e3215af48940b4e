"""A training corpus from raw documents, in five stages.

Each stage reads what its predecessor wrote and returns a DataFrame; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import bpe, line_dedup, mixing, quality, simhash
from karyospark.operators.lineage import shared_dir


#: Whole texts are large rows: few of them go to a Python worker at once.
ROWS_A_BATCH = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _row() -> Column:
    """A document whole, so that no operator's columns meet its own."""
    return F.struct("*").alias("row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps.

    Null, empty and blank texts go; equal texts fare alike; long ones are read
    whole; a score at the threshold is kept.  An empty table gives none.
    """
    model = quality.fit(docs.select("doc_id", "text"))
    return quality.classify(docs.select("text", _row()), model).where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents keep; ``n_chars`` follows, and texts that lose all their lines go.

    Texts that lose nothing stay as they are, null and empty ones too.  Rows
    without ``doc_id`` lose nothing, and rows that share one lose alike.
    """
    cut = line_dedup.dedup_lines(docs.select("doc_id", "text", _row()), min_chars=40, min_docs=5)
    lost = F.col("n_dropped") > 0
    left = cut.where(~lost | (F.length(F.btrim("text", F.lit(line_dedup.BLANKS))) > 0))
    row = F.col("row").withField("text", F.when(lost, F.col("text")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(lost, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars")))
    return left.select(row.alias("row")).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a five-word shingle similarity of 0.8: the one with the least id.

    Null, empty and blank texts are one group.  Ids name documents: rows that
    share one stay or go together, and rows without one stay, for nothing tells
    which of them is the first.
    """
    groups = simhash.similar_documents(docs, words_a_shingle=5, similarity=0.8)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document by its source's target weight, in shuffled order.

    Null sources are one source; rows that share an id, or have none, get
    equally many copies.  Texts are never looked at.
    """
    return mixing.mix_sources(docs.select("doc_id", "source", _row())).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and a digest of the bytes that decoding them gives back.

    Null and empty texts have no ids; every copy is a row; an empty table gives
    none.  Only the id, language and source of a document go with its ids.
    """
    return bpe.encode_documents(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: No stage is expressible in SQL as a whole; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder as Parquet and read again.

    An empty table gives no rows.  While stages run, Python workers take
    ``ROWS_A_BATCH`` rows at once; the session's setting comes back afterwards.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(ROWS_A_BATCH))
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
