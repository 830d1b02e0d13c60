"""Write rules as functions of the table before and its changes, orders with their places, and scope filters, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import windows as W
from loomline.plans.registry import _CATALOG, query
from loomline.sources.tables import catalog, table


def scope(kind: str, entity: int | None = None) -> Column:
    """Rows of a scope: all, global ones, or those of one tenant."""
    return {"all": F.lit(True), "global": F.col("is_global"), "entity": ~F.col("is_global") & (F.col("entity_id") == F.lit(entity))}[kind]


def optional(column: str, value=None) -> Column:
    """column = value; no value lets every row pass."""
    return F.lit(True) if value is None else F.col(column) == value


@query(f"WITH {_CATALOG} SELECT 'all' AS scope, count(*) AS n FROM catalog WHERE status_id IN (2, 4) UNION ALL SELECT 'global', count(*) FROM catalog WHERE status_id IN (2, 4) AND is_global UNION ALL SELECT 'entity', count(*) FROM catalog WHERE status_id IN (2, 4) AND NOT is_global AND entity_id = 3 UNION ALL SELECT 'source', count(*) FROM catalog WHERE status_id IN (2, 4) AND source = 'src1'")
def review_scopes(spark, sf_dir):
    rows = catalog(spark, sf_dir).where(F.col("status_id").isin(2, 4))
    counts = rows.agg(*(F.count_if(c).alias(n) for n, c in {"all": scope("all"), "global": scope("global"), "entity": scope("entity", 3), "source": scope("all") & optional("status_id") & optional("source", "src1")}.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("scope"), F.col(f"`{n}`").alias("n")) for n in counts.columns))))


def upsert_flagged(current: DataFrame, changes: DataFrame, key: str, plain: list[str], flagged: list[str], flag: str) -> DataFrame:
    """Upsert in which some columns of known keys change only where the change's flag is set; new keys take all."""
    new = changes.select(key, F.col(flag).alias("_flag"), F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in [*plain, *flagged]))
    old = current.withColumn("_was", F.lit(True))
    take = {**{c: F.col("_in") for c in plain}, **{c: F.col("_in") & (F.col("_flag") | F.col("_was").isNull()) for c in flagged}}
    return old.join(new, key, "full_outer").select(key, *(F.when(take[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in take else F.col(c) for c in current.columns if c != key))


@query("""WITH n AS (SELECT o_custkey AS k, max(o_orderpriority) AS name, max(o_orderstatus) AS seg, count(*) % 2 = 0 AS flag FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NOT NULL THEN name ELSE c_name END AS c_name, CASE WHEN k IS NOT NULL AND (flag OR c_custkey IS NULL) THEN seg ELSE c_mktsegment END AS c_mktsegment FROM customer FULL JOIN n ON c_custkey = k""")
def upsert_conditional(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"), F.max("o_orderstatus").alias("c_mktsegment"), (F.count("*") % 2 == 0).alias("flag"))
    return upsert_flagged(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), changes, "c_custkey", ["c_name"], ["c_mktsegment"], "flag")


def upsert_null_keys(current: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upsert on keys of which null equals null; of equal keys in the changes, the largest value counts."""
    new = changes.groupBy(*keys).agg(F.max(value).alias("_new"), F.lit(True).alias("_in")).select(*(F.col(k).alias(f"_{k}") for k in keys), "_new", "_in")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return current.withColumn("_was", F.lit(True)).join(new, on, "full_outer").select(*(F.when(F.col("_was"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys), F.when(F.col("_in"), F.col("_new")).otherwise(F.col(value)).alias(value))


@query("""WITH o AS (SELECT nullif(user_id % 7, 0) AS tenant, event_type, max(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), n AS (SELECT nullif(user_id % 9, 0) AS tenant, event_type, max(value) AS value FROM events GROUP BY 1, 2)
SELECT CASE WHEN o.event_type IS NOT NULL THEN o.tenant ELSE n.tenant END AS tenant, coalesce(o.event_type, n.event_type) AS event_type, coalesce(n.value, o.value) AS value FROM o FULL JOIN n ON o.tenant IS NOT DISTINCT FROM n.tenant AND o.event_type IS NOT DISTINCT FROM n.event_type""")
def upsert_with_null_keys(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.where("event_id % 3 = 0").groupBy(F.nullif(F.col("user_id") % 7, F.lit(0)).alias("tenant"), "event_type").agg(F.max("value").alias("value"))
    return upsert_null_keys(old, events.select(F.nullif(F.col("user_id") % 9, F.lit(0)).alias("tenant"), "event_type", "value"), ["tenant", "event_type"], "value")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0")
def insert_from_lookup(spark, sf_dir):
    """Rows to insert, each with the label of its code; a code that the lookup misses inserts no row."""
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return table(spark, sf_dir, "lineitem").join(known, "l_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 20 THEN 'abandoned' ELSE 'done' END AS state, CAST(floor(epoch(m)) - floor(epoch(ts)) AS BIGINT) AS seconds FROM events, (SELECT max(ts) AS m FROM events) WHERE event_type <> 'view'""")
def finish_work(spark, sf_dir):
    """Open work items at the newest time of the table: state by rule, and the seconds they took."""
    rows = table(spark, sf_dir, "events")
    as_of = rows.agg(F.max("ts").alias("as_of"))
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 20, "abandoned").otherwise("done")
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return rows.where("event_type <> 'view'").crossJoin(F.broadcast(as_of)).select("event_id", state.alias("state"), (seconds("as_of") - seconds("ts")).alias("seconds"))


@query("""SELECT (SELECT count(*) FROM documents WHERE source = 'src2') AS deleted, (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src2')) AS cascaded, (SELECT count(*) FROM documents WHERE source IS DISTINCT FROM 'src2') AS kept""")
def delete_with_dependents(spark, sf_dir):
    """What deleting one source removes: its documents and the labels that hang on them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gone = docs.where("source = 'src2'")
    one = docs.agg(F.count_if(F.col("source") == "src2").alias("deleted"), F.count_if(~F.col("source").eqNullSafe("src2")).alias("kept"))
    return one.crossJoin(F.broadcast(labels.join(gone, "doc_id", "left_semi").agg(F.count("*").alias("cascaded")))).select("deleted", "cascaded", "kept")


@query("""WITH gone AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) < 3) SELECT conv_id, turn, conv_id IN (SELECT conv_id FROM gone) AS archived, CASE WHEN conv_id IN (SELECT conv_id FROM gone) THEN NULL ELSE role END AS role FROM conversations""")
def archive_conversations(spark, sf_dir):
    """Short conversations get a tombstone, and the role that refers to them is set to null."""
    turns = table(spark, sf_dir, "conversations")
    gone = turns.groupBy("conv_id").agg(F.max("turn").alias("last")).where("last < 3").select("conv_id", F.lit(True).alias("gone"))
    rows = turns.join(gone, "conv_id", "left").withColumn("archived", F.coalesce("gone", F.lit(False)))
    return rows.select("conv_id", "turn", "archived", F.when(~F.col("archived"), F.col("role")).alias("role"))


@query("""WITH n AS (SELECT doc_id, count(*) AS n FROM labels WHERE toxic = 1 GROUP BY doc_id) SELECT d.doc_id, coalesce(n.n, 0) AS toxic, greatest(CAST(n_chars AS BIGINT), coalesce(n.n, 0)) AS most FROM documents d LEFT JOIN n USING (doc_id)""")
def refresh_counters(spark, sf_dir):
    """Stored counters brought up to date: one is replaced, the other keeps the larger of old and new."""
    n = table(spark, sf_dir, "labels").where("toxic = 1").groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(n, "doc_id", "left").withColumn("toxic", F.coalesce("n", F.lit(0)).cast("long"))
    return rows.select("doc_id", "toxic", F.greatest(F.col("n_chars").cast("long"), "toxic").alias("most"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY CASE coalesce(status_id, 0) WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END, lang DESC NULLS LAST, n_chars ASC NULLS FIRST, doc_id) AS place FROM catalog ORDER BY place LIMIT 100""".replace("SELECT doc_id", f"WITH {_CATALOG} SELECT doc_id", 1))
def recent_work(spark, sf_dir):
    """The first 100 documents by rank of status, then language with nulls last, then size with nulls first."""
    rank = F.when(F.col("status_id") == 2, 0).when(F.col("status_id") == 1, 1).otherwise(2)
    order = [rank.asc(), F.desc_nulls_last("lang"), F.asc_nulls_first("n_chars"), F.asc("doc_id")]
    return W.placed(catalog(spark, sf_dir).orderBy(*order).limit(100), order, "place").select("doc_id", "place")


@query("""WITH o AS (SELECT p_partkey, lower(p_name) AS name, CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS BIGINT) AS number FROM part) SELECT p_partkey, number, row_number() OVER (ORDER BY number NULLS LAST, name, p_partkey) AS place FROM o ORDER BY place LIMIT 50 OFFSET 50""")
def parts_page(spark, sf_dir):
    """The second page of 50 parts by the first number of the brand, then the name in either case."""
    number = F.nullif(F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("")).cast("long")
    rows = table(spark, sf_dir, "part").select("p_partkey", number.alias("number"), F.lower("p_name").alias("name"))
    order = [F.asc_nulls_last("number"), F.asc("name"), F.asc("p_partkey")]
    return W.placed(rows.orderBy(*order).limit(100), order, "place").where("place > 50").select("p_partkey", "number", "place")


@query("""WITH f AS (SELECT 'order' AS feed, o_orderkey AS id, o_orderdate AS moment FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) SELECT feed, id, row_number() OVER (ORDER BY moment DESC, feed, id) AS place FROM f ORDER BY place LIMIT 60""")
def merged_feeds(spark, sf_dir):
    """The newest 60 rows of two feeds."""
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("feed"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    events = table(spark, sf_dir, "events").select(F.lit("event").alias("feed"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    order = [F.desc("at"), F.asc("feed"), F.asc("id")]
    top = lambda df: df.orderBy(*order).limit(60)
    return W.placed(top(top(orders).unionByName(top(events))), order, "place").select("feed", "id", "place")


@query("""WITH l AS (SELECT ts, max(value) AS value, 0 AS live FROM events WHERE event_type <> 'click' GROUP BY ts UNION ALL SELECT ts, max(value), 1 FROM events WHERE event_type = 'click' GROUP BY ts), m AS (SELECT ts, arg_max(value, live) AS value FROM l GROUP BY ts) SELECT ts, value FROM m ORDER BY ts DESC LIMIT 500""")
def merged_history(spark, sf_dir):
    """Stored and live samples, live ones winning at equal times; the newest 500."""
    live = F.col("event_type") == "click"
    rows = table(spark, sf_dir, "events").groupBy("ts").agg(F.max(F.when(live, F.col("value"))).alias("live"), F.max(F.when(~live, F.col("value"))).alias("stored"))
    return rows.select("ts", F.coalesce("live", "stored").alias("value")).orderBy(F.desc("ts")).limit(500)


@query("""SELECT conv_id, list(word ORDER BY pos) AS words FROM (SELECT conv_id, lower(word) AS word, min({'t': turn, 'p': p}) AS pos FROM (SELECT conv_id, turn, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations)) WHERE length(word) >= 8 GROUP BY conv_id, lower(word)) GROUP BY conv_id""")
def long_words_once(spark, sf_dir):
    """Long words of each conversation, each once (in either case), in the order they first appear."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("p", "word")).where("length(word) >= 8")
    once = words.groupBy("conv_id", F.lower("word").alias("word")).agg(F.min(F.struct("turn", "p")).alias("pos"))
    return once.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


@query("""WITH p AS (SELECT n_nationkey AS entity, n_regionkey AS tenant, length(n_name) AS least FROM nation UNION ALL SELECT 100 + r_regionkey, NULL, 99 FROM region), r AS (SELECT c_custkey, least, row_number() OVER (PARTITION BY c_custkey ORDER BY tenant NULLS LAST, entity) AS i FROM customer JOIN p ON p.tenant = c_nationkey % 9 OR p.tenant IS NULL) SELECT c_custkey, CAST(least AS BIGINT) AS least FROM r WHERE i = 1""")
def effective_policy(spark, sf_dir):
    """Each customer's policy: that of the tenant, else the default (a tenant of null). Two equi-joins, no OR in the join."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    own = nation.groupBy(F.col("n_regionkey").cast("long").alias("tenant")).agg(F.min_by(F.length("n_name"), "n_nationkey").cast("long").alias("own"))
    default = region.agg(F.min(F.lit(99)).cast("long").alias("default"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 9).cast("long").alias("tenant")).join(own, "tenant", "left").crossJoin(F.broadcast(default))
    return rows.select("c_custkey", F.coalesce("own", "default").alias("least"))
