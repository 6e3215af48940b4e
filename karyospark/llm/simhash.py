"""SimHash near-dedup with pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to reference
fingerprints.  Two fingerprints within ``d`` bits differ by at most ``d`` in
every coordinate.  One set of references makes this a join: beside a base they
are the base with one bit turned, in six groups of neighbouring bits, so that a
group's coordinates (taken from the base's) change only where a fingerprint
changes in the group's bits.  Three differing bits touch at most three groups;
so any linked pair has the same coordinates in some three of the six, and the
twenty choices of three are the join's keys, about 32 bits each.  Pairs that
meet under a key are discarded by the largest coordinate difference over the
other, random references, and survivors are verified bit by bit.

A key that holds more than ``BUCKET_ROWS`` distinct fingerprints is not
compared but cut again: the same choice is made over the bits that it leaves
open, until at most 2**8 fingerprints can share a key.  A bucket hands on only
the edges of a spanning forest, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.operators.components import connected_components
from karyospark.operators.lineage import cut

from .bits import mix
from .grouped import key_groups, least_labels, pairs_by_offset

MAX_BITS = 3
GROUPS, KEPT = 6, 3
BUCKET_ROWS = 4096
CHOICES = list(combinations(range(GROUPS), KEPT))
BASE = mix(np.array([7], np.uint64))[0]
ONE = np.uint64(1)
UNIT_PIVOTS = BASE ^ (ONE << np.arange(64, dtype=np.uint64))
FAR_PIVOTS = mix(np.arange(24, dtype=np.uint64), 99)


def distance_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per fingerprint and one column per reference."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :])


def simhash(text: str | None, words_a_shingle: int = 3) -> int:
    """64-bit SimHash (signed) of a text's word shingles; 0 where it has no word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_a_shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest, totals = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), 1 << 16):
        part = zip(starts[lo : lo + (1 << 16)], ends[lo : lo + (1 << 16)], strict=True)
        hashes = np.array([digest(joined[s:e], 42) for s, e in part], np.uint64)
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    packed = np.packbits(2 * totals > len(starts), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(text: Column, words_a_shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, words_a_shingle) for t in texts], index=texts.index, dtype="int64")

    return udf(text)


def _cuts(positions: list[int]) -> list[list[int]]:
    return [list(x) for x in np.array_split(positions, GROUPS)]


def _packed(table: np.ndarray, base: np.ndarray, positions: list[int]) -> np.ndarray:
    """The coordinates of these unit references, from the base's, as one number."""
    nearer = table[:, positions] < base
    weights = ONE << np.arange(len(positions), dtype=np.uint64)
    return (nearer * weights[None, :]).sum(1, dtype=np.uint64)


def _keys(fps: np.ndarray, paths: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(row numbers, keys, paths)`` of the next level for rows whose path of earlier choices is given."""
    table, base = distance_table(fps, UNIT_PIVOTS), distance_table(fps, np.array([BASE]))
    for path in np.unique(paths):
        at = np.flatnonzero(paths == path)
        chosen, left, code = [], list(range(64)), int(path)
        for depth in range(level):
            groups = _cuts(left)
            choice = CHOICES[code // 20**depth % 20]
            chosen += [p for g in choice for p in groups[g]]
            left = [p for g in range(GROUPS) if g not in choice for p in groups[g]]
        groups = _cuts(left)
        for n, choice in enumerate(CHOICES):
            bits = chosen + [p for g in choice for p in groups[g]]
            value = _packed(table[at], base[at], bits)
            code = int(path) + n * 20**level
            yield at, mix(value, code * 4 + level).view(np.int64), np.full(len(at), code, np.int64)


def _with_keys(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, paths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "path"))
            for lo in range(0, len(fps), 4096):
                part = fps[lo : lo + 4096]
                for at, key, path in _keys(part.view(np.uint64), paths[lo : lo + 4096], level):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at]), pa.array(path)], ["key", "fp", "path"])

    return run


def _compare(max_bits: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for crowded, (key, fps, paths) in key_groups(batches, limit):
            if crowded:
                yield _out(fps, fps, paths)
                continue
            bits = fps.view(np.uint64)
            alone = np.ones(len(key), bool)
            same = key[1:] == key[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            key, bits, fps = key[~alone], bits[~alone], fps[~alone]
            table = distance_table(bits, FAR_PIVOTS).astype(np.int8)
            label, found, n = np.arange(len(key)), [], 0
            for i, j in pairs_by_offset(key):
                for p in range(0, table.shape[1], 6):  # few coordinates settle most pairs
                    near = np.abs(table[i, p : p + 6] - table[j, p : p + 6]).max(1) <= max_bits if len(i) else np.zeros(0, bool)
                    i, j = i[near], j[near]
                near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
                found.append((i[near], j[near]))
                n += int(near.sum())
                if n > 1 << 20:
                    label, found, n = _forest(label, found), [], 0
            label = _forest(label, found)
            moved = label != np.arange(len(label))
            if moved.any():
                yield _out(fps[moved], fps[label[moved]], np.full(int(moved.sum()), -1, np.int64))

    return run


def _forest(label: np.ndarray, found: list) -> np.ndarray:
    own = np.flatnonzero(label != np.arange(len(label)))
    i = np.concatenate([own, *(x[0] for x in found)])
    j = np.concatenate([label[own], *(x[1] for x in found)])
    return least_labels(len(label), i, j)


def _out(a: np.ndarray, b: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(path)], ["a", "b", "path"])


def near_fingerprint_edges(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)`` edges between distinct ``distinct.fp`` that connect exactly what links of ``max_bits`` connect."""
    assert max_bits <= GROUPS - KEPT, "six groups with three kept find pairs of at most three differing bits"
    spark = distinct.sparkSession
    todo = distinct.select("fp", F.lit(0).cast("bigint").alias("path"))
    edges = None
    for level in range(3):
        keyed = todo.mapInArrow(_with_keys(level), "key bigint, fp bigint, path bigint")
        dealt = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
        limit = bucket_rows if level < 2 else 1 << 20  # the last keys leave 8 bits open
        out = cut(dealt.mapInArrow(_compare(max_bits, limit), "a bigint, b bigint, path bigint"))
        new = out.where("path < 0").select("a", "b")
        edges = new if edges is None else edges.unionByName(new)
        todo = out.where("path >= 0").select(F.col("a").alias("fp"), "path").distinct()
        if todo.isEmpty():
            break
    return edges.distinct()


def near_duplicates(docs: DataFrame, words_a_shingle: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Words are runs without ``[\\x20\\x09-\\x0D]`` of the whole text with A-Z
    lower-cased; a text with fewer words than a shingle is one shingle; a null,
    empty or blank text has fingerprint zero, linked like any other.  Texts with
    equal fingerprints are one node.  ``component_id`` is the least ``doc_id``
    that links reach, null only where all those ids are null.  Repeated rows
    come back as often as they came.  Other columns are ignored.
    """
    prints = cut(docs.select("doc_id", fingerprints(F.col("text"), words_a_shingle).alias("fp")))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_fingerprint_edges(distinct.select("fp"), max_bits))
    members = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    members = cut(members)
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.join(roots, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op3_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity ---------------------------------------------------
#
# A shingle similarity of 0.8 turns about 15 of 100 SimHash bits, too many for
# three differing bits of 64.  Here fingerprints have 256 bits, keys are the
# coordinates at some of the unit references (their number follows the count of
# fingerprints, the number of keys follows the wanted recall), and the tables of
# distances to references are made inside a key's bucket, with members as
# references: all members within the radius of one reference are linked at once,
# and of the pairs that are still apart those are verified whose coordinates
# differ by no more than the radius.
#
# Bits only find candidates.  The radius lies four standard deviations above the
# expected distance, and the sets of shingles of all members of a candidate
# group are compared; links are pairs whose sets are as similar as asked.

WIDE = 4
LEAST_KEY_BITS = 14
BUCKET_LOG2 = 4
MISSED = 0.02
RADIUS_DEVIATIONS = 4
GROUP_SHINGLES = 1 << 18
SMALL_BUCKET = 64
REFERENCES = 8
PAIRS_AT_ONCE = 1 << 16
WIDE_SCHEMA = "key bigint, gid bigint, side int, f0 bigint, f1 bigint, f2 bigint, f3 bigint"


def bit_share(similarity: float) -> float:
    """Expected share of differing bits of two texts with this Jaccard similarity and equal lengths."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_radius(similarity: float) -> int:
    """Differing bits that all but a few in 100,000 pairs of this similarity stay within."""
    share, bits = bit_share(similarity), 64 * WIDE
    return int(np.ceil(bits * share + RADIUS_DEVIATIONS * np.sqrt(bits * share * (1 - share))))


def wide_tables(similarity: float, key_bits: int) -> int:
    """Keys a row, so that a pair at the similarity shares none with probability ``MISSED``, over the spread of its differing bits."""
    share, bits = bit_share(similarity), 64 * WIDE
    d = np.arange(bits - key_bits + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, bits + 1)))])
    weight = np.exp(logs[bits] - logs[d] - logs[bits - d] + d * np.log(share) + (bits - d) * np.log1p(-share))
    meets = np.exp(logs[bits - d] - logs[bits - d - key_bits] - logs[bits] + logs[bits - key_bits])
    tables = 1
    while (weight * (1 - meets) ** tables).sum() > MISSED:
        tables += 1
    return tables


def shingle_set(text: str | None, words_a_shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; empty where it has no word."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(words_a_shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    ends = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def wide_simhash(hashes: np.ndarray) -> list[int]:
    """256-bit SimHash of a set of shingles as four signed numbers; zeros for the empty set."""
    totals = np.zeros(64 * WIDE, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        several = np.stack([mix(part, r) for r in range(WIDE)], 1)
        totals += np.unpackbits(several.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * totals > len(hashes), bitorder="little").view(np.int64).tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _wide_fingerprints(text: Column, words_a_shingle: int) -> Column:
    """The fingerprint, 128 hash bits that name the set of shingles, and its size."""
    names = [*(f"f{r}" for r in range(WIDE)), "s0", "s1", "size"]

    @F.pandas_udf(", ".join(f"{n} bigint" for n in names))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                hashes = shingle_set(t, words_a_shingle)
                raw = hashes.tobytes()
                rows.append([*wide_simhash(hashes), *(_signed(xxhash.xxh64_intdigest(raw, seed)) for seed in (1, 2)), len(hashes)])
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(names)), columns=names, index=texts.index)

    return udf(text)


def _shingle_sets(text: Column, words_a_shingle: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, words_a_shingle).view(np.int64) for t in texts], index=texts.index, dtype=object)

    return udf(text)


def _wide_batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    names = ["key", "gid", "side", "f0", "f1", "f2", "f3"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "side" else pa.int64()) for n, c in zip(names, cols, strict=True)], names)


def _wide_keys(key_bits: int, tables: int):
    rng = np.random.default_rng(11)
    places = [np.sort(rng.choice(64 * WIDE, key_bits, replace=False)) for _ in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gid, *fs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("gid", "f0", "f1", "f2", "f3"))
            bits = np.unpackbits(np.stack(fs, 1).view(np.uint8).reshape(len(gid), -1), axis=1, bitorder="little") if len(gid) else np.zeros((0, 256), np.uint8)
            for t, at in enumerate(places):
                value = np.zeros(len(gid), np.uint64)
                for p in at:
                    value = value << ONE | bits[:, p]
                yield _wide_batch([mix(value, 1000 + t).view(np.int64), gid, np.zeros(len(gid), np.int32), *fs])

    return run


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def link_bucket(fps: np.ndarray, radius: int) -> np.ndarray:
    """Least linked row of each row of one bucket (rows x 4 numbers), by reference tables."""
    n = len(fps)
    covered, tables, i, j = np.zeros(n, bool), [], [], []
    while not covered.all() and len(tables) < REFERENCES:
        pivot = int(np.argmin(covered))
        d = _apart(fps, fps[pivot])
        near = np.flatnonzero(d <= radius)
        i.append(np.full(len(near), pivot))
        j.append(near)
        covered[near] = True
        tables.append(d)
    label = least_labels(n, np.concatenate(i), np.concatenate(j))
    table = np.stack(tables, 1).astype(np.int16)
    step = max(1, PAIRS_AT_ONCE // n)
    for lo in range(0, n, step):
        if (label == label[0]).all():
            break
        rows = np.arange(lo, min(n, lo + step))
        a, b = np.nonzero(label[rows][:, None] != label[None, :])
        a = rows[a]
        later = a < b
        a, b = a[later], b[later]
        near = np.abs(table[a] - table[b]).max(1) <= radius if len(a) else np.zeros(0, bool)
        a, b = a[near], b[near]
        near = _apart(fps[a], fps[b]) <= radius
        if near.any():
            own = np.arange(n)
            label = least_labels(n, np.concatenate([own, a[near]]), np.concatenate([label, b[near]]))
    return label


def _wide_compare(radius: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for crowded, cols in key_groups(batches, limit):
            if crowded:
                yield _wide_batch(cols)
                continue
            key, gid, _, *fs = cols
            fps = np.stack(fs, 1).view(np.uint64)
            edges = np.flatnonzero(np.diff(key)) + 1
            starts = np.concatenate([[0], edges])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            label, found = np.arange(len(key)), []
            small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
            at = np.flatnonzero(small)
            for i, j in pairs_by_offset(key[at]):
                i, j = at[i], at[j]
                near = _apart(fps[i], fps[j]) <= radius
                found.append((i[near], j[near]))
            label = _forest(label, found) if found else label
            for s, m in zip(starts[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist(), strict=True):
                label[s : s + m] = s + link_bucket(fps[s : s + m], radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):  # an edge: side -1, the other end in place of the key
                yield _wide_batch([gid[label[moved]], gid[moved], np.full(len(moved), -1, np.int32), *([np.zeros(len(moved), np.int64)] * WIDE)])

    return run


def link_sets(fps: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Least linked row of each row, by the Jaccard similarity of nonempty sets that lie one after the other in ``hashes``."""
    n, label = len(sizes), np.arange(len(sizes))
    codes, starts = np.unique(hashes, return_inverse=True)[1], np.cumsum(sizes) - sizes
    mark = np.zeros(len(hashes), bool)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[label[j] != label[i]]
        j = j[np.minimum(sizes[j], sizes[i]) / np.maximum(sizes[j], sizes[i]) >= similarity]
        j = j[_apart(fps[j], fps[i]) <= radius]
        if not len(j):
            continue
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = True
        offset = np.cumsum(sizes[j]) - sizes[j]
        at = np.repeat(starts[j] - offset, sizes[j]) + np.arange(sizes[j].sum())
        both = np.add.reduceat(mark[codes[at]], offset, dtype=np.int64)
        mark[own] = False
        j = j[both / (sizes[i] + sizes[j] - both) >= similarity]
        if len(j):
            old = np.unique(np.append(label[j], label[i]))
            label[np.isin(label, old)] = old[0]
            if not label.any():
                break
    return label


def _set_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of equal ``key`` from key-sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and key[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key[lo]
    if held:
        yield pa.Table.from_batches(held)


def _compare_sets(radius: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], 0
        for group in _set_groups(batches):
            if group.num_rows < 2:
                continue
            gid = group.column("gid").to_numpy()
            fps = np.stack([group.column(f"f{r}").to_numpy() for r in range(WIDE)], 1).view(np.uint64)
            hashes = np.concatenate([c.flatten().to_numpy() for c in group.column("hashes").chunks])
            label = link_sets(fps, group.column("size").to_numpy(), hashes, radius, similarity)
            moved = np.flatnonzero(label != np.arange(len(label)))
            a.append(gid[label[moved]])
            b.append(gid[moved])
            n += len(moved)
            if n > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _verified_edges(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, words_a_shingle: int, radius: int, similarity: float) -> DataFrame:
    """``(a, b)`` between ``nodes.gid`` that connect the pairs within one candidate group whose sets are similar.

    A group's sets meet in one place while they hold ``GROUP_SHINGLES`` shingles
    together, else in pairs of chunks.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"f{r}" for r in range(WIDE)]
    members = cut(nodes.where("size > 0").join(candidates, nodes.gid == candidates.node).select("gid", "root", "size", *names, F.col("rep.id").alias("rep_id"), F.col("rep.text").alias("rep_text")))
    chunks = members.groupBy("root").agg(F.ceil(F.sum("size") / GROUP_SHINGLES).cast("int").alias("n"))
    dealt = members.join(chunks, "root").withColumn("c", F.pmod(F.xxhash64("gid"), "n").cast("int"))
    texts = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("name"))
    whole = dealt.join(texts, (F.col("name") == F.col("rep_text")) & F.col("id").eqNullSafe(F.col("rep_id")))
    sets = whole.select("gid", "root", "n", "c", "size", *names, _shingle_sets(F.col("text"), words_a_shingle).alias("hashes"))
    met = sets.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("key", F.xxhash64("root", F.least("c", "d"), F.greatest("c", "d")))
    met = met.select("key", "gid", "size", *names, "hashes").repartition(parts, "key").sortWithinPartitions("key")
    return met.mapInArrow(_compare_sets(radius, similarity), "a bigint, b bigint")


def similar_documents(docs: DataFrame, words_a_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)`` for every row: groups linked by pairs whose sets of shingles have a Jaccard similarity of ``similarity``.

    Words are those of ``near_duplicates``; null, empty and blank texts are one
    group, and texts with equal sets are one node.  Candidates are found by
    fingerprints of the sets: a pair at the similarity itself is missed with
    probability ``MISSED``, closer ones less.  Every link is verified on the
    whole sets, so no pair below the similarity links.  Whole texts and all rows
    take part; rows of a bucket above ``BUCKET_ROWS`` are compared in pairs of
    chunks.  Repeated rows come back as often as they came.
    """
    spark = docs.sparkSession
    names = [f"f{r}" for r in range(WIDE)]
    prints = docs.select("doc_id", F.xxhash64("text").alias("name"), _wide_fingerprints(F.col("text"), words_a_shingle).alias("f"))
    prints = cut(prints.select("doc_id", "name", "f.*"))
    rep = F.max(F.struct(F.col("doc_id").alias("id"), F.col("name").alias("text"))).alias("rep")  # one row that has the text
    distinct = cut(prints.groupBy("s0", "s1", "size", *names).agg(F.min("doc_id").alias("least"), rep).withColumn("gid", F.monotonically_increasing_id()))
    n = max(2, distinct.count())
    key_bits = max(LEAST_KEY_BITS, int(np.ceil(np.log2(n))) - BUCKET_LOG2)
    tables, radius = wide_tables(similarity, key_bits), wide_radius(similarity)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "key").sortWithinPartitions("key")
    first = cut(dealt(distinct.select("gid", *names).mapInArrow(_wide_keys(key_bits, tables), WIDE_SCHEMA)).mapInArrow(_wide_compare(radius, BUCKET_ROWS), WIDE_SCHEMA))
    edges = first.where("side < 0").select(F.col("key").alias("a"), F.col("gid").alias("b"))
    crowded = first.where("side >= 0")
    if not crowded.isEmpty():
        chunks = crowded.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (BUCKET_ROWS // 4)).cast("int").alias("n"))
        one = crowded.join(chunks, "key").withColumn("c", F.pmod(F.xxhash64("gid"), "n").cast("int"))
        two = one.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("key", F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")))
        again = dealt(two.select("key", "gid", "side", *names)).mapInArrow(_wide_compare(radius, 1 << 30), WIDE_SCHEMA)  # about BUCKET_ROWS // 2 rows a group
        edges = edges.unionByName(again.select(F.col("key").alias("a"), F.col("gid").alias("b")))
    candidates = connected_components(edges.distinct())
    linked = connected_components(_verified_edges(docs, distinct, candidates, words_a_shingle, radius, similarity))
    members = cut(distinct.join(linked, distinct.gid == linked.node, "left").select("s0", "s1", "least", F.coalesce("root", "gid").alias("root")))
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = members.join(roots, "root").select("s0", "s1", "component_id")
    return prints.join(classes, ["s0", "s1"]).select("doc_id", "component_id")


QUERIES = {"op3_pivot_simhash": op3_pivot_simhash}
ORACLES: dict[str, str] = {}
