"""Gapless numbers in a stated order, without a window over all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import materialise

_BITS = 33  # monotonically_increasing_id: the partition above, the row's place in it below


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", first: int = 0) -> DataFrame:
    """rows with the numbers first, first + 1, ... in this order; rows that tie are numbered as they come.

    Rows are dealt by ranges of the order and sorted within them, which gives each its range and its place there; one count
    a range then says where its numbers begin. Ties are parted by the row's place in the input, so rows that repeat a key
    any number of times are still spread. The driver sees one number for each range. rows are read twice (ranges are
    sampled first), so a costly input should be written before.
    """
    tie = F.col("__tie")
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys, tie).sortWithinPartitions(*keys, tie)
    return _gapless(dealt.drop("__tie"), name, first)


def as_read(rows: DataFrame, name: str = "number", first: int = 0) -> DataFrame:
    """rows, written once, with the numbers first, first + 1, ... as they come."""
    return _gapless(rows, name, first)


def _gapless(rows: DataFrame, name: str, first: int) -> DataFrame:
    at = F.col("__at")
    placed = materialise(rows.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, _BITS).cast("int")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    begins = accumulate([n for _, n in sizes], initial=first)
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, begins, strict=False)], "__part int, __first long")
    place = at.bitwiseAND(F.lit((1 << _BITS) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__first") + place).drop("__part", "__first", "__at")
