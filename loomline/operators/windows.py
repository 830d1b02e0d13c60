"""Ordered rules as windows: budgets, allocation, ranks, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(rows: DataFrame, group: list[str], order: list[Column], size: str, most: int) -> DataFrame:
    """Rows of each group, in order, up to a sum of sizes; the first one always stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("_n") == 1) | (F.col("_sum") <= most)).drop("_n", "_sum")


def first_of(rows: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def allocate(rows: DataFrame, bucket: list[str], order: str, total: str, weight: str, out: str = "allocated") -> DataFrame:
    """Share a bucket's verified total by weight, rounded to 8 places (half up); the last row takes the remainder, so that
    the shares sum to the total exactly. Weights that sum to 0 count as equal."""
    w = Window.partitionBy(*bucket)
    ordered = w.orderBy(order)
    sums, n = F.sum(weight).over(w), F.count("*").over(w)
    share = F.when(sums > 0, F.col(total).cast("decimal(18,8)") * F.col(weight).cast("decimal(14,8)") / sums.cast("decimal(20,8)")).otherwise(F.col(total).cast("decimal(18,8)") / n.cast("decimal(10,0)"))
    rounded = rows.withColumn("_s", F.round(share, 8).cast("decimal(20,8)")).withColumn("_k", F.row_number().over(ordered)).withColumn("_n", n)
    others = F.coalesce(F.sum("_s").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rounded.withColumn(out, F.when(F.col("_k") == F.col("_n"), F.col(total).cast("decimal(20,8)") - others).otherwise(F.col("_s")).cast("decimal(20,8)")).drop("_s", "_k", "_n")


def placed(rows: DataFrame, order: list[Column], place: str) -> DataFrame:
    """rows, of which there are few (a page, a top-k or groups), with their place in an order over all of them."""
    return rows.withColumn(place, F.row_number().over(Window.orderBy(*order)).cast("long"))


def ordinals(rows: DataFrame, key: str, ts: str, tie: str, column: str = "ordinal", bucket: str = "HOUR") -> DataFrame:
    """rows with their place in their key's order of (ts, tie), from 0. Each hour is ranked by itself, and the hours' sizes are
    summed, so that no task holds all rows of a key."""
    rows = rows.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    sizes = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(key).alias("_key"), F.col("_bucket").alias("_at"), (F.sum("_n").over(Window.partitionBy(key).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    placed = rows.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    rank = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(ts, tie))
    return placed.withColumn(column, F.col("_before") + rank - 1).drop("_bucket", "_key", "_at", "_before")


def moving(rows: DataFrame, key: str, ts: str, tie: str, width: int, block: int = 10_000, **aggregates: Column) -> DataFrame:
    """rows with aggregates over themselves and the width - 1 rows before, in their key's order of (ts, tie). A window sees a
    block of rows and the width - 1 before it, which are in two blocks; a null ts comes first."""
    placed = ordinals(rows, key, ts, tie, "_o").withColumn("_b", F.floor(F.col("_o") / block))
    again = F.col("_o") % block > block - width
    both = placed.withColumn("_at", F.explode(F.when(again, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b"))))
    w = Window.partitionBy(key, "_at").orderBy("_o").rowsBetween(1 - width, 0)
    return both.select("*", *(c.over(w).alias(n) for n, c in aggregates.items())).where("_b = _at").drop("_o", "_b", "_at")
