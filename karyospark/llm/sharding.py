"""Consistent-hash ring with virtual nodes and bounded loads.

Each shard owns several arcs of a ring of ``ring_slots`` equal slots.  A row's
place on the ring is the hash of its ``doc_id``; it goes to the first shard
clockwise that is not full.  Rows of one slot share one clockwise order of
shards, so which rows overflow follows from the row count of each slot alone:
the counts (at most ``ring_slots`` of them, a parameter) are turned into ranges
of ranks per slot, and each row looks up the range that its rank falls in.
Ranks come from counts of small cells plus a window inside a cell.  A cell is
a slot and some bits of the hash of the whole row, so rows that share an id, or
have none, are ranked in many windows; no window spans a shard or a slot.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL_BITS = 8
#: Most equal rows that one array numbers.
RUN = 65_536


def ring_preferences(n_shards: int, vnodes: int, ring_slots: int) -> list[list[int]]:
    """For each slot, all shards in the order in which a clockwise walk meets them."""
    owner: dict[int, tuple[str, int]] = {}
    for shard in range(n_shards):
        for replica in range(vnodes):
            mark = hashlib.md5(f"shard-{shard}-node-{replica}".encode()).hexdigest()
            slot = int(mark[:12], 16) % ring_slots
            owner[slot] = min(owner.get(slot, (mark, shard)), (mark, shard))
    walk = [owner[slot][1] for slot in sorted(owner)]
    walk += [s for s in range(n_shards) if s not in walk]
    places = sorted(owner)
    orders, at = [], 0
    for slot in range(ring_slots):
        while at < len(places) and places[at] < slot:
            at += 1
        orders.append(list(dict.fromkeys(walk[(at + k) % len(walk)] for k in range(len(walk)))) if slot == 0 or places[at - 1] == slot - 1 else orders[-1])
    return orders


def bounded_ranges(counts: dict[int, int], orders: list[list[int]], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``(ring_slot, lo, hi, shard, base)``: rows of rank lo..hi-1 in the slot fill the shard from place ``base``.

    In round k every slot offers what it still holds to the k-th shard of its
    clockwise order; slots are served in ring order until the shard is full.
    """
    left, used, ranges = dict(counts), [0] * len(caps), []
    for k in range(len(caps)):
        for slot in sorted(left):
            if not left[slot]:
                continue
            shard = orders[slot][k]
            if take := min(left[slot], caps[shard] - used[shard]):
                lo = counts[slot] - left[slot]
                ranges.append((slot, lo, lo + take, shard, used[shard]))
                used[shard] += take
                left[slot] -= take
    assert not any(left.values()), "the capacities hold fewer rows than there are"
    return ranges


def shard_capacities(total: int, n_shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard: equal shares, at most one apart, plus ``slack`` of a share."""
    extra = int(slack * total / n_shards)
    return [total // n_shards + (s < total % n_shards) + extra for s in range(n_shards)]


def assign_shards(docs: DataFrame, n_shards: int = 8, vnodes: int = 64, ring_slots: int = 4096, slack: float = 0.0) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs(doc_id, text, ...)``.

    With ``slack=0`` the bound is tight and shard counts differ by at most one;
    with slack fewer rows move when a shard is added.  ``size`` is the text's
    UTF-8 bytes plus 1; a null text counts as empty (size 1, checksum 0).
    A row without id stands on the ring by its text; repeated rows are counted
    once before the shuffle, then laid out side by side in runs of RUN.  Texts of
    any length count by size and checksum alone.  Columns other than ``doc_id``
    and ``text`` are ignored.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    ring = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    slot_bits = ring_slots.bit_length() - 1
    assert ring_slots == 1 << slot_bits, "ring_slots is a power of two"
    copies = (
        rows.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("ring", ring)
        .withColumn("ring_slot", F.shiftrightunsigned("ring", 64 - slot_bits).cast("int"))
        .withColumn("cell", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - CELL_BITS).cast("int"))
    )
    cells = copies.groupBy("ring_slot", "cell").agg(F.sum("copies").alias("n"))
    before = W.partitionBy("ring_slot").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("ring_slot", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    counts = {r[0]: r[1] for r in cells.groupBy("ring_slot").agg(F.sum("n")).collect()}  # at most ring_slots rows
    ranges = bounded_ranges(counts, ring_preferences(n_shards, vnodes, ring_slots), shard_capacities(sum(counts.values()), n_shards, slack))
    inside = W.partitionBy("ring_slot", "cell").orderBy("ring", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    first = F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("copies")
    end = F.col("first") + F.col("copies") - 1
    ranked = (
        copies.join(starts, ["ring_slot", "cell"])
        .withColumn("first", F.col("start") + first)
        .withColumn("run", F.explode(F.sequence("first", end, F.lit(RUN))))
        .select("doc_id", "size", "text_crc32", "ring_slot", F.explode(F.sequence("run", F.least(end, F.col("run") + RUN - 1))).alias("rank"))
    )
    table = _range_table(spark, ranges)
    fits = (ranked.ring_slot == table.at_slot) & (ranked["rank"] >= table.lo) & (ranked["rank"] < table.hi)
    return ranked.join(F.broadcast(table), fits).select(  # at most ring_slots * n_shards rows
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot")
    )


def _range_table(spark: SparkSession, ranges: list[tuple]) -> DataFrame:
    return spark.createDataFrame(ranges, "at_slot int, lo bigint, hi bigint, shard int, base bigint")


def op7_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_consistent_hash_shards": op7_consistent_hash_shards}
ORACLES: dict[str, str] = {}
