"""Prefix scans over sorted tables, segment by segment, without a task that holds a segment.

A table is sorted into range partitions, which may cut a segment anywhere.
Every partition yields a partial state for each segment that it meets; states
are carried along the partitions, a row a partition and segment; each row adds
what its partition was handed.  Where neighbours count, rows are dealt by rank
into blocks, with copies of the rows near a block's ends (a halo).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

PART, BLOCK, OWN = "_part", "_block", "_own"
#: Ranks in one block.
BLOCK_RANKS = 1 << 16


def sorted_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range partitions over ``order``, written, with the partition's number."""
    return cut(df.orderBy(*order).withColumn(PART, F.spark_partition_id()))


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """An equi-join in which null keys meet; the keys come from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def running(placed: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """``placed`` (of ``sorted_parts``) with running values of each segment of ``keys`` up to and with each row.

    ``sums`` add up; ``lasts`` keep the last value that is not null.
    A segment may come back later in the order; its state is carried all the same.
    """
    sums, lasts, rows = sums or {}, lasts or {}, placed if rows is None else rows
    along = W.partitionBy(PART, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    at = F.struct(*order)
    totals = [F.sum(c).alias(f"_own_{n}") for n, c in sums.items()] + [F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_own_{n}") for n, c in lasts.items()]
    states = placed.groupBy(PART, *keys).agg(*totals)
    before = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    carried = [F.sum(f"_own_{n}").over(before).alias(f"_before_{n}") for n in sums] + [F.last(f"_own_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in lasts]
    states = states.select(PART, *keys, *carried)
    here = rows.withColumns({n: F.sum(c).over(along) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(along) for n, c in lasts.items()})
    joined = join_nullsafe(here, states, [PART, *keys])
    out = joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums} | {n: F.coalesce(F.col(n), F.col(f"_before_{n}")) for n in lasts})
    return out.drop(*[f"_before_{n}" for n in [*sums, *lasts]])


def ranked(placed: DataFrame, keys: list[str], order: list[str], name: str, rows: DataFrame | None = None) -> DataFrame:
    """``placed`` (or its ``rows``) with the 0-based rank in each segment."""
    return running(placed, keys, order, sums={name: F.lit(1).cast("bigint")}, rows=rows).withColumn(name, F.col(name) - 1)


def blocks(df: DataFrame, rank: str, halo: int, ranks: int | None = None) -> DataFrame:
    """Rows dealt by ``rank`` into blocks, near a block's ends to the neighbour as well, where they are not its ``OWN``."""
    size = ranks or BLOCK_RANKS
    if halo > size:
        raise ValueError("a halo reaches one block at most")
    home = F.floor(F.col(rank) / size)
    around = F.array_distinct(F.array(F.floor((F.col(rank) - halo) / size), home, F.floor((F.col(rank) + halo) / size)))
    return df.withColumn(BLOCK, F.explode(F.filter(around, lambda b: b >= 0))).withColumn(OWN, F.col(BLOCK) == home)


def own(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(BLOCK, OWN)


def at_or_below(sizes: DataFrame, steps: DataFrame) -> DataFrame:
    """``(size, at, value)`` for each different size of ``sizes(size)``: the greatest size of ``steps(size, value)`` not above it, and its value.

    Both tables are sorted as one, and the last step is carried along.
    """
    marks = steps.select("size", F.struct(F.col("size").alias("at"), "value").alias("_step"), F.lit(0).alias("_kind"))
    asked = sizes.select("size").distinct().select("size", F.lit(None).cast(marks.schema["_step"].dataType).alias("_step"), F.lit(1).alias("_kind"))
    placed = sorted_parts(marks.unionByName(asked), ["size", "_kind"])
    out = running(placed, [], ["size", "_kind"], lasts={"_last": F.col("_step")})
    return out.where("_kind = 1").select("size", "_last.at", "_last.value")


def at_least(sizes: DataFrame, observed: DataFrame) -> DataFrame:
    """``(size, n)`` for each different size of ``sizes(size)``: the sum of ``n`` over ``observed(size, n)`` from this size on."""
    rows = observed.select("size", "n", F.lit(1).alias("_kind")).unionByName(sizes.select("size").distinct().select("size", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("_kind")))
    placed = sorted_parts(rows, ["size", "_kind"])
    total = F.lit(observed.agg(F.sum("n")).first()[0] or 0)
    out = running(placed, [], ["size", "_kind"], sums={"_below": F.col("n")})
    return out.where("_kind = 0").select("size", (total - F.col("_below")).cast("bigint").alias("n"))
