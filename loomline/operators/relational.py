"""Joins and aggregates over catalogs, conversations, queues and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_stats(parent: DataFrame, facts: DataFrame, key: str, **stats: Column) -> DataFrame:
    """parent left-joined to facts that are aggregated first; numbers without facts are 0."""
    found = facts.groupBy(key).agg(*(c.alias(n) for n, c in stats.items()))
    return parent.join(found, key, "left").fillna(0, list(stats))


def rollup_all(rows: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """One row for each key and one for all rows, in one pass."""
    return rows.rollup(key).agg(*aggregates, F.grouping(key).alias("_all")).withColumn(key, F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(key))).drop("_all")


def bucket(ts: str, seconds: int) -> Column:
    """Start of the time bucket, as a timestamp without a zone."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    return F.timestamp_seconds(F.floor(at / seconds) * seconds).cast("timestamp_ntz")


def fingerprint(rows: DataFrame, order: str, *fields: str, width: int = 1024, levels: int = 3) -> DataFrame:
    """(parts, digest): one SHA-256 over all rows' fields in order, as a tree: digests of rows meet by range of the order, `width`
    of them in a group, level by level, and the last level's parts (one for width ** levels of the order) give the whole. Of no
    rows, the digest is that of an empty text. Rows of equal order are sorted by digest; they share a group."""
    level = rows.select(F.col(order).cast("long").alias("o"), F.sha2(F.concat_ws("|", *(F.col(f).cast("string") for f in fields)), 256).alias("r"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "r"))), lambda x: x.r), "\n"), 256).alias("r")
    for _ in range(levels):
        level = level.groupBy(F.expr(f"o div {width}").alias("up")).agg(joined).select(F.col("up").alias("o"), "r")
    return level.agg(F.count("*").alias("parts"), joined.alias("digest"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """added, removed, modified or unchanged for each key of either snapshot."""
    both = old.select(key, F.col(mark).alias("_old"), F.lit(True).alias("_in_old")).join(new.select(key, F.col(mark).alias("_new"), F.lit(True).alias("_in_new")), key, "full_outer")
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    return both.select(key, change.alias("change"))


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert new keys; for known ones, a value that is null in the change keeps the old one."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key))
    return current.join(new, key, "full_outer").select(key, *((F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c)) for c in current.columns if c != key))


def insert_new(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes whose key isn't there yet are added, the others ignored; of repeated new keys the first row by its values. A
    null key equals none."""
    new = changes.join(current.select(key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*(c for c in new.columns if c != key)))
    return current.unionByName(new.withColumn("_n", F.when(F.col(key).isNull(), 1).otherwise(first)).where("_n = 1").drop("_n"))


def merge_rows(current: DataFrame, changes: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Upsert with a rule for each changed column: overwrite, keep_if_null, keep_if_empty, existing or greatest."""
    new = changes.select(key, F.lit(True).alias("_changed"), *(F.col(c).alias(f"_{c}") for c in rules))
    rule = {
        "overwrite": lambda old, to: F.when(F.col("_changed"), to).otherwise(old),
        "keep_if_null": lambda old, to: F.coalesce(to, old),
        "keep_if_empty": lambda old, to: F.coalesce(F.nullif(to, F.lit("")), old),
        "existing": lambda old, to: F.coalesce(old, to),
        "greatest": lambda old, to: F.greatest(old, to),
    }
    return current.join(new, key, "full_outer").select(key, *(rule[rules[c]](F.col(c), F.col(f"_{c}")).alias(c) if c in rules else F.col(c) for c in current.columns if c != key))


def first_key_hit(needs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, hit, pos): each row's first of several keys that the index (key, hit) holds."""
    each = needs.select(F.col(key).alias("_row"), F.posexplode("keys").alias("pos", "key"))
    return each.join(index, "key").groupBy("_row").agg(F.min_by("hit", "pos").alias("hit"), F.min("pos").alias("pos")).withColumnRenamed("_row", key)


def kept_by_share(rows: DataFrame, key: str, group: str, size: str, share: float = 0.75) -> DataFrame:
    """rows with `rate` and `kept`: a group (a null one too) is kept at share * largest / own size, 1 at most, so that large groups
    lose rows. A row is kept by a hash of its key, so in any run and partitioning the same rows stay; a null key is kept where the
    rate is 1 alone. A group without size is kept whole."""
    sums = rows.groupBy(F.col(group).alias("_group")).agg(F.sum(size).alias("_sum"))
    rate = F.when(F.col("_sum") > 0, F.least(F.lit(1.0), share * (F.col("_most") / F.col("_sum")))).otherwise(1.0)
    rates = sums.crossJoin(F.broadcast(sums.agg(F.max("_sum").alias("_most")))).select("_group", rate.alias("rate"))  # the one row of the largest
    draw = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967296
    kept = F.coalesce(draw < F.col("rate"), F.col("rate") >= 1)
    return rows.join(rates, F.col(group).eqNullSafe(F.col("_group"))).drop("_group").withColumn("kept", kept)


def replace_sources(current: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, removed): current without the sources that incoming has rows of, and all of incoming; and the rows that went. A null source
    is one like others. A second run with the same rows changes nothing."""
    named = incoming.select(F.col(key).alias("_source")).distinct()
    known = F.col(key).eqNullSafe(F.col("_source"))
    return current.join(named, known, "left_anti").unionByName(incoming), current.join(named, known, "left_semi")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): children whose parent is there, or that name none, and those that go with theirs."""
    named = parents.select(F.col(key).alias("_parent")).distinct()
    orphans = children.where(F.col(key).isNotNull()).join(named, F.col(key) == F.col("_parent"), "left_anti")
    held = children.join(named, F.col(key) == F.col("_parent"), "left_semi").unionByName(children.where(F.col(key).isNull()))
    return held, orphans


def set_null(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """children, with null for a parent that is no longer there."""
    named = parents.select(F.col(key).alias("_parent")).distinct()
    return children.join(named, F.col(key) == F.col("_parent"), "left").withColumn(key, F.col("_parent")).drop("_parent")


def write_sources(rows: DataFrame, path: str, key: str) -> None:
    """Replace the sources that rows have in a table partitioned by source; files of other sources aren't touched. A source of which no
    row is left is to be removed as a partition."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
