"""Numbers for the rows of groups in order, where a group may hold any share of all rows.

A window by group puts a group's rows in one task. Here rows are dealt out in ranges of (group, order), so a large group spans
many tasks; each task counts its rows, and a group's rows in the ranges before give a row's offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.shared import kept

#: Bits of monotonically_increasing_id() that count rows inside a partition.
ROW_BITS = 33
#: Rows of groups' parts that are broadcast; more are joined by a shuffle.
BROADCAST_SPANS = 200_000


def ranged(rows: DataFrame, group: list[str], order: list[str | Column], kind: str) -> DataFrame:
    """rows as a table in order of (group, order), with `part`, the range, and `row`, the row's place there. Rows that are equal in both may land in any of two neighbouring ranges."""
    clash = {"part", "row", "tie"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns of these names can't be numbered: {sorted(clash)}")
    keys = [*group, *order, "tie"]  # the tie splits a key that repeats
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    place = F.monotonically_increasing_id()
    return kept(dealt.withColumns({"part": F.spark_partition_id(), "row": place.bitwiseAND(F.lit((1 << ROW_BITS) - 1))}), kind)


def sized(spans: DataFrame, most: int = BROADCAST_SPANS) -> DataFrame:
    """spans, to be broadcast if they are few, so that the numbered rows stay where they are."""
    return F.broadcast(spans) if spans.limit(most + 1).count() <= most else spans


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str, kind: str = "numbered") -> DataFrame:
    """rows with `name`, the row's number from 0 in its group in ascending order (nulls first), and `name`_of, the group's size.

    Rows that are equal in group and order are numbered in any order. A null group is a group.
    """
    table = ranged(rows, group, order, kind)
    spans = table.groupBy(*group, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)  # as many rows as a group has ranges
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("part").alias("__part"), (before - F.col("first")).alias("__shift"), F.sum("n").over(whole).alias(f"{name}_of"))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    joined = table.join(sized(starts), [table["part"] == F.col("__part"), *same])
    return joined.select(*rows.columns, (F.col("row") + F.col("__shift")).alias(name), f"{name}_of")


def running_sums(rows: DataFrame, group: list[str], order: list[str | Column], value: str, name: str, kind: str = "sums") -> DataFrame:
    """rows with `name`, the sum of `value` over its group's rows up to and with each in ascending order. A window sums inside each range; the ranges before give its start."""
    table = ranged(rows, group, order, kind)
    inside = Window.partitionBy(*group, "part")
    spans = table.groupBy(*group, "part").agg(F.sum(value).alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spans.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("part").alias("__part"), before.alias("__before"))
    summed = table.withColumn(name, F.sum(value).over(inside.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    return summed.join(sized(starts), [summed["part"] == F.col("__part"), *same]).select(*rows.columns, (F.col(name) + F.col("__before")).alias(name))
