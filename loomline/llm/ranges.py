"""Gapless numbers for all rows of a large table in a given order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.shared import Scratch

#: monotonically_increasing_id() has the row's place in its partition in these low bits.
PLACE_BITS = 33


def numbered(scratch: Scratch, rows: DataFrame, order: list[Column], name: str, column: str = "number") -> DataFrame:
    """rows with their number in this order, from 0. Rows are dealt by range and sorted there; each keeps its place in its
    range, and the ranges' sizes (one row a partition) are summed in order and joined back. The ranges are written to the
    shared folder first, as another attempt at sampling could deal them otherwise."""
    place = F.monotonically_increasing_id()
    dealt = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(column, place), name)
    part = F.shiftright(F.col(column), PLACE_BITS)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), part == before._part).withColumn(column, F.col("_before") + F.col(column).bitwiseAND((1 << PLACE_BITS) - 1)).drop("_part", "_before")
