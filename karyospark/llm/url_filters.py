"""Exact URL lists from cascades of Bloom filters.

A list of keys (a host, or a host and the start of a path) is stored in shards
by key hash.  In each shard level 0 encodes the listed keys, level 1 the keys
of the corpus that level 0 lets through although they are not listed, level 2
the listed keys that level 1 lets through, and so on until no key is wrong.
The corpus's complete key universe takes part in the building, so testing any
of its keys is exact, and judging a page needs no join: the filters travel to
the pages in groups of shards of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.operators.lineage import cut

from .bits import BloomBits

# The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

KEYS_A_SHARD = 1 << 20
BROADCAST_BYTES = 64 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where no ``://`` stands."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All keys ``struct(host, path)`` a URL can match: host suffixes of the given label counts with path starts of the given lengths."""
    parts = F.split(host, r"\.", -1)
    suffixes = F.filter(
        F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")) for n in labels]), lambda s: s.isNotNull()
    )
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda s: s.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def _hash(key: Column) -> Column:
    """``struct(h, g)``: 128 bits of a key of any type."""
    return F.struct(F.xxhash64(F.lit("url"), key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g"))


def _pairs(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["h", "g"]].to_numpy(np.int64).view(np.uint64)


def build_cascade(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """``(shard, n_shards, levels array<binary>)`` for the distinct keys of ``listed.key`` over ``universe.key``.

    Listed keys outside the universe are encoded as well.  Null keys add
    nothing; an empty list gives no rows, and then nothing is listed.
    """
    hashes = cut(listed.where("key IS NOT NULL").select(_hash(F.col("key")).alias("k")).select("k.*").distinct())
    n_listed = hashes.count()
    n_shards = max(1, -(-n_listed // KEYS_A_SHARD))
    known = cut(universe.where("key IS NOT NULL").select(_hash(F.col("key")).alias("k")).select("k.*").distinct())
    rate = min(0.5, 0.7 * max(n_listed, 1) / max(known.count(), 1))
    at = lambda df: df.withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        level = BloomBits.build(_pairs(pdf), rate, 0)
        return pd.DataFrame({"shard": pdf.shard.iloc[:1], "n_shards": n_shards, "levels": [[level.to_bytes()]]})

    level0 = cut(at(hashes).groupBy("shard").applyInPandas(first, "shard int, n_shards int, levels array<binary>"))
    passed = mark_members(known.select("h", "g", F.array(F.struct("h", "g")).alias("hs")), [("hit", level0)]).where(F.element_at("hit", 1)).select("h", "g")
    wrong = passed.join(hashes, ["h", "g"], "left_anti")

    def rest(mine: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"shard": [], "n_shards": [], "levels": []})
        inside, outside = _pairs(mine), _pairs(other)
        levels = [BloomBits.build(inside, rate, 0)]
        encoded, against = outside, inside
        while len(encoded):
            level = BloomBits.build(encoded, 0.5, len(levels))
            levels.append(level)
            encoded, against = against[level.test(against)], encoded
        return pd.DataFrame({"shard": mine.shard.iloc[:1].to_numpy(), "n_shards": n_shards, "levels": [[x.to_bytes() for x in levels]]})

    return at(hashes).groupBy("shard").cogroup(at(wrong).groupBy("shard")).applyInPandas(rest, "shard int, n_shards int, levels array<binary>")


def in_cascade(levels: list[BloomBits], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the depth of the first level that stops it, odd for a listed key."""
    depth = np.full(len(keys), len(levels))
    todo = np.arange(len(keys))
    for k, level in enumerate(levels):
        ok = level.test(keys[todo])
        depth[todo[~ok]] = k
        todo = todo[ok]
    return depth % 2 == 1


def mark_members(df: DataFrame, cascades: list[tuple[str, DataFrame]], column: str = "hs") -> DataFrame:
    """``df`` with one ``array<boolean>`` per cascade: which hashes (h, g) of ``column`` are listed.

    Shards are broadcast in groups of at most ``BROADCAST_BYTES``; each group
    settles the keys of its own shards in one pass without a shuffle.
    """
    for name, cascade in cascades:
        sizes = cascade.select("n_shards", F.aggregate("levels", F.lit(0), lambda n, x: n + F.length(x)).alias("size"))
        total, n_shards = sizes.agg(F.sum("size"), F.max("n_shards")).first()
        flags = F.transform(F.col(column), lambda _: F.lit(False))
        df = df.withColumn(name, flags)
        groups = -(-(total or 0) // BROADCAST_BYTES)
        for g in range(groups):
            part = cascade.where(F.pmod("shard", F.lit(groups)) == g).collect()  # at most about BROADCAST_BYTES
            sent = df.sparkSession.sparkContext.broadcast({r.shard: [bytes(x) for x in r.levels] for r in part})
            df = _mark(df, F.flatten(F.transform(column, lambda x: F.array(x["h"], x["g"]))), name, sent, n_shards)
    return df


def _mark(df: DataFrame, halves: Column, name: str, sent, n_shards: int) -> DataFrame:
    @F.pandas_udf("array<boolean>")
    def probe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shards = {k: [BloomBits.from_bytes(x) for x in v] for k, v in sent.value.items()}
        for hashes, flags in batches:
            lengths = np.array([len(x) for x in flags], np.int64)
            keys = np.concatenate([np.asarray(x, np.int64) for x in hashes] if lengths.sum() else [np.zeros(0, np.int64)]).reshape(-1, 2)
            out = np.concatenate([np.asarray(x, bool) for x in flags]) if lengths.sum() else np.zeros(0, bool)
            of = keys[:, 0] % n_shards
            for shard, levels in shards.items():
                at = np.flatnonzero(of == shard)
                out[at] = in_cascade(levels, keys[at].view(np.uint64))
            yield pd.Series(np.split(out, np.cumsum(lengths)[:-1]) if len(lengths) else [], index=hashes.index)

    return df.withColumn(name, probe(halves, name))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """All columns of ``pages`` and ``host``, ``path``, ``rule``, ``verdict``.

    ``rules(host, path, verdict)`` may be of any length.  A rule fits its host
    and all its subdomains where the URL's path starts with the rule's path;
    the longest fitting rule (host and path together, then the longer host)
    wins, ``block`` before ``allow`` between equal ones.  URLs that no listed
    key fits get ``default`` and a null rule.  Null URLs and URLs without
    ``://`` have empty host and path.  Hosts are compared by whole labels.
    Input columns of the four new names are replaced.
    """
    listed = cut(rules.where("host IS NOT NULL").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict"))
    shape = listed.agg(
        F.sort_array(F.collect_set(F.size(F.split("host", r"\.", -1)))), F.sort_array(F.collect_set(F.length("path")))
    ).first()  # sets of small numbers: labels of a host, characters of a path
    host, path = url_parts(F.col("url"))
    row = F.struct(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("row")
    parts = pages.select(row, host.alias("host"), path.alias("path"))
    if not shape[0]:
        return parts.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), list(shape[0]), list(shape[1])))
    universe = keyed.select(F.explode("keys").alias("key"))
    key = F.struct("host", "path")
    cascades = [(v, cut(build_cascade(listed.where(F.col("verdict") == v).select(key.alias("key")), universe))) for v in ("allow", "block")]
    marked = mark_members(keyed.withColumn("hs", F.transform("keys", _hash)), cascades)
    hits = F.filter(
        F.zip_with(
            F.col("keys"), F.arrays_zip("allow", "block"),
            lambda k, f: F.struct(
                (F.length(k["host"]) + F.length(k["path"])).alias("n"), F.length(k["host"]).alias("m"), f["block"].alias("block"), (f["allow"] | f["block"]).alias("listed"), F.concat(k["host"], k["path"]).alias("rule")
            ),
        ),
        lambda s: s["listed"],
    )
    best = marked.select("row", "host", "path", F.array_max(hits).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    return best.select("row.*", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op5_bloom_cascade_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0], r[1])} THEN '{k(r)}'" for r in longest)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM r)
SELECT page_id, host, path, {case(lambda r: r[0] + r[1])} END rule, {case(lambda r: r[2])} ELSE 'allow' END verdict FROM h"""


QUERIES = {"op5_bloom_cascade_urls": op5_bloom_cascade_urls}
ORACLES = {"op5_bloom_cascade_urls": _sql()}
