"""Corpus-wide line dedup through sharded minimal perfect hashes.

Each document hands out its distinct long lines as 128-bit hashes, which are
counted (combined before the shuffle) and dealt into small shards.  A shard
becomes one row: a minimal perfect hash over all its distinct line hashes and,
by the numbers that it gives, arrays of fingerprints (the other 64 bits),
document counts and last holders.  Documents then probe the arrays by hash, and
the count array decides what is dropped: probes meet their shard's row, never a
table of lines.  A shard with many probes is copied to several groups, and its
probes are spread over them, so a line that a third of all documents hold is no
heavier for any task than other lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.operators.lineage import cut

from .bits import MinimalPerfectHash

# What counts as blank at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def long_line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, h1, h2)``, once for each distinct long line of a row."""
    keys = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key), lambda k: F.length(k) >= min_chars)
    pair = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(keys, pair))).alias("h")).select("doc_id", "h.h1", "h.h2")


def build_line_index(probes: DataFrame, n_shards: int) -> DataFrame:
    """``(shard, probes, mph, fingerprints, counts, holders, spare)`` over all distinct line hashes.

    ``probes`` in a row is how many lookups of its lines the documents will make.
    Hashes whose first half another one has already taken stand in ``spare``.
    """
    lines = probes.groupBy("h1", "h2").agg(F.count_if(F.col("doc_id").isNotNull()).alias("n"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("holder"), F.count(F.lit(1)).alias("probes"))

    def shard_row(pdf: pd.DataFrame) -> pd.DataFrame:
        again = pdf.duplicated("h1")
        spare, own = pdf[again], pdf[~again]
        keys = own.h1.to_numpy().view(np.uint64)
        mph = MinimalPerfectHash.build(keys)
        at = mph.lookup(keys)
        arrays = []
        for name in ("h2", "n", "holder"):
            values = np.empty(len(own), np.int64)
            values[at] = own[name].to_numpy()
            arrays.append(values.tobytes())
        return pd.DataFrame([[pdf.shard.iloc[0], int(pdf.probes.sum()), mph.to_bytes(), *arrays, spare[["h1", "h2", "n", "holder"]].to_numpy(np.int64).tobytes()]])

    schema = "shard int, probes bigint, mph binary, fingerprints binary, counts binary, holders binary, spare binary"
    return lines.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(shard_row, schema)


def _shard(n_shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("h1", 20), F.lit(n_shards)).cast("int")


def probe_line_index(probes: DataFrame, index: DataFrame, min_docs: int, n_shards: int) -> DataFrame:
    """``(doc_id, h1, h2)`` of the lines that ``min_docs`` documents hold and that another document keeps."""
    sizes = cut(index.select("shard", "probes"))
    total, rows = sizes.agg(F.sum("probes"), F.count(F.lit(1))).first()
    fair = max(64, (total or 0) // max(rows, 1))
    groups = sizes.select("shard", F.ceil(F.col("probes") / fair).cast("int").alias("groups"))
    crowded = groups.where("groups > 1")
    salted = probes.withColumn("shard", _shard(n_shards)).join(_small(crowded, rows), "shard", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups")
    copies = index.join(_small(groups, rows), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups", "probes")

    def probe(mine: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(mine):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc_id", "h1", "h2")})
        row = shard.iloc[0]
        fingerprints, counts, holders = (np.frombuffer(row[c], np.int64) for c in ("fingerprints", "counts", "holders"))
        h2 = mine.h2.to_numpy()
        at = MinimalPerfectHash.from_bytes(row.mph).lookup(mine.h1.to_numpy().view(np.uint64))
        known = (at >= 0) & (fingerprints[at] == h2)
        n, holder = np.where(known, counts[at], 0), np.where(known, holders[at], 0)
        for s1, s2, spare_n, spare_holder in np.frombuffer(row.spare, np.int64).reshape(-1, 4).tolist():
            same = (mine.h1.to_numpy() == s1) & (h2 == s2)
            n[same], holder[same] = spare_n, spare_holder
        return mine.loc[(n >= min_docs) & (holder != mine.doc_id.to_numpy()), ["doc_id", "h1", "h2"]]

    identified = salted.where("doc_id IS NOT NULL")
    return identified.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "doc_id bigint, h1 bigint, h2 bigint")


def _small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """Broadcast where the counted rows (one int or two each) stay under ``most``; a plain join beyond."""
    return F.broadcast(df) if rows <= most else df


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keys_a_shard: int = 1 << 16) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut down, and ``n_lines``, ``n_dropped``, ``original_text``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and
    with A-Z lower-cased.  Keys of at least ``min_chars`` code points found in
    at least ``min_docs`` documents lose all their lines except in the largest
    ``doc_id`` that holds them; the other lines stay, joined by ``\\n``.  Null
    and empty texts are one empty line; ``text`` is then empty.  Rows that share
    a ``doc_id`` keep or lose lines alike, and each counts as a document; rows
    without one count for nothing and lose nothing.  Input columns of the new
    names are replaced.  Lines of any length and number are treated alike; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    probes = cut(long_line_hashes(docs, min_chars))
    n_probes = probes.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(8 * parts, -(-n_probes // keys_a_shard))
    index = cut(build_line_index(probes, n_shards))
    halves = F.flatten(F.transform(F.collect_set(F.struct("h1", "h2")), lambda h: F.array(h["h1"], h["h2"])))
    drops = probe_line_index(probes, index, min_docs, n_shards).groupBy("doc_id").agg(halves.alias("drop"))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "original_text")]
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.struct(*names).alias("row"))
    joined = rows.join(drops.withColumnRenamed("doc_id", "id"), "id", "left")
    done = joined.select("row", "text", _cut_udf(min_chars)(F.coalesce("text", F.lit("")), "drop").alias("cut"))
    return done.select("row.*", F.col("cut.text").alias("text"), "cut.n_lines", "cut.n_dropped", F.col("text").alias("original_text"))


def _cut_udf(min_chars: int):
    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def cut_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drops in batches:
            rows = [_cut_one(t, d, min_chars) for t, d in zip(texts, drops, strict=True)]
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"], index=texts.index)

    return cut_text


def _cut_one(text: str, drop, min_chars: int) -> tuple[str, int, int]:
    """``drop`` holds both halves of each hash, one after the other."""
    if drop is None or not len(drop):
        return text, text.count("\n") + 1, 0
    gone, lines = dict(zip(drop[::2].tolist(), drop[1::2].tolist(), strict=True)), text.split("\n")
    twice = None
    if 2 * len(gone) < len(drop):  # two hashes share their first half
        twice = set(zip(drop[::2].tolist(), drop[1::2].tolist(), strict=True))

    def goes(line: str) -> bool:
        key = line.strip(BLANKS)
        if len(key) < min_chars:
            return False
        raw = key.translate(_FOLD).encode()
        first = _signed(raw, 42)
        if first not in gone:
            return False
        second = _signed(raw, SECOND_SEED)
        return gone[first] == second if twice is None else (first, second) in twice

    kept = [x for x in lines if not goes(x)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


#: The seed of the second half: the hash of the number that stands before the key.
SECOND_SEED = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def _signed(raw: bytes, seed: int) -> int:
    h = xxhash.xxh64_intdigest(raw, seed)
    return h - (1 << 64) if h >> 63 else h


def op2_mph_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i FROM documents),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k FROM l),
     f AS (SELECT k, max(doc_id) holder FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     j AS (SELECT k.*, coalesce(f.holder <> k.doc_id, false) gone FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) kept_sha256
FROM j GROUP BY doc_id"""

QUERIES = {"op2_mph_line_dedup": op2_mph_line_dedup}
ORACLES = {"op2_mph_line_dedup": SQL}
