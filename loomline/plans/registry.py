"""Every query of the library by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import columns as C
from loomline.operators import relational as R
from loomline.operators import retrieval as V
from loomline.operators import windows as W
from loomline.sources.tables import catalog, lines, table, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_CATALOG = """catalog AS (SELECT d.doc_id, text, lang, source, n_chars, doc_id % 5 AS entity_id, doc_id % 3 = 0 AS is_global,
  CASE WHEN toxic = 1 THEN 4 WHEN quality = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 1 END AS status_id FROM documents d LEFT JOIN labels USING (doc_id))"""
_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_index, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_USAGE = """usage AS (SELECT *, CAST(CAST(value AS DECIMAL(12,4)) * CAST(k AS DECIMAL(6,0)) / 1000 AS DECIMAL(14,8)) AS cost FROM
  (SELECT event_id, ts, user_id, event_type, value, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events))"""


def query(sql: str = ""):
    """Register a query, and its SQL where it has any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {_CATALOG}, {_LINES}, s AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE length(line) < 40) AS n_short, max(length(line)) AS longest FROM lines GROUP BY doc_id)
SELECT c.doc_id, status_id, source, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_short, 0) AS n_short, CAST(coalesce(longest, 0) AS BIGINT) AS longest FROM catalog c LEFT JOIN s USING (doc_id)""")
def review_documents_list(spark, sf_dir):
    docs = catalog(spark, sf_dir)
    chunks = lines(table(spark, sf_dir, "documents"))
    return R.with_stats(docs.select("doc_id", "status_id", "source"), chunks, "doc_id", n_chunks=F.count("*"), n_short=F.count_if(F.length("line") < 40), longest=F.max(F.length("line")).cast("long"))


@query(f"WITH {_CATALOG} SELECT doc_id, source, status_id FROM catalog WHERE status_id = 3 AND (is_global OR entity_id = 2)")
def visible_documents(spark, sf_dir):
    return catalog(spark, sf_dir).where((F.col("status_id") == 3) & C.visible_to(2)).select("doc_id", "source", "status_id")


@query(f"WITH {_USAGE} SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, count(DISTINCT user_id) AS users FROM usage GROUP BY event_type")
def usage_breakdown(spark, sf_dir):
    return usage(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("tokens"), F.sum("cost").cast("double").alias("cost"), F.countDistinct("user_id").alias("users"))


@query(f"WITH {_USAGE} SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(sum(cost) AS DOUBLE) AS cost FROM usage GROUP BY 1")
def usage_cost_timeline(spark, sf_dir):
    return usage(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("cost").cast("double").alias("cost"))


@query(f"WITH {_USAGE} SELECT count(*) AS n, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS spend FROM usage WHERE ts >= (SELECT date_trunc('month', max(ts)) FROM events) AND event_type <> 'error'")
def monthly_spend(spark, sf_dir):
    rows = usage(spark, sf_dir)
    as_of = rows.agg(F.date_trunc("month", F.max("ts"))).first()[0]
    return rows.where((F.col("ts") >= F.lit(as_of)) & (F.col("event_type") != "error")).agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("spend"))


@query("""SELECT event_type, count(*) AS n, max(value) AS peak, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type
UNION ALL SELECT 'all', count(*), max(value), count(*) FILTER (WHERE value > 50) FROM events""")
def queue_wait_summary(spark, sf_dir):
    return R.rollup_all(table(spark, sf_dir, "events"), "event_type", F.count("*").alias("n"), F.max("value").alias("peak"), F.count_if(F.col("value") > 50).alias("high"))


@query("SELECT to_timestamp(floor(epoch(ts) / 900) * 900)::TIMESTAMP AS bucket, max(value) AS peak, count(*) AS n FROM events GROUP BY 1")
def resource_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(R.bucket("ts", 900).alias("bucket")).agg(F.max("value").alias("peak"), F.count("*").alias("n"))


_LEVELS = ", ".join(f"l{i} AS (SELECT o // 1024 AS o, sha256(string_agg(r, chr(10) ORDER BY o, r)) AS r FROM l{i - 1} GROUP BY o // 1024)" for i in range(1, 4))


@query(f"""WITH l0 AS (SELECT doc_id AS o, sha256(concat_ws('|', doc_id, source, n_chars)) AS r FROM documents), {_LEVELS} SELECT count(*) AS parts, sha256(coalesce(string_agg(r, chr(10) ORDER BY o, r), '')) AS digest FROM l3""")
def catalog_fingerprint(spark, sf_dir):
    return R.fingerprint(table(spark, sf_dir, "documents"), "doc_id", "doc_id", "source", "n_chars")


@query("""SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, max(turn) + 1 AS next_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id""")
def conversation_list(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), (F.max("turn") + 1).alias("next_turn"), F.sum(F.length("text")).alias("chars"))


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text ROWS UNBOUNDED PRECEDING) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, role, text))
SELECT conv_id, turn FROM r WHERE n = 1 OR s <= 600""")
def history_within_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("size", F.length("text"))
    return W.within_budget(turns, ["conv_id"], [F.desc("turn"), F.asc("role"), F.asc("text")], "size", 600).select("conv_id", "turn")


@query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 10, event_id) AS n FROM events) WHERE n <= 4""")
def queue_eligible(spark, sf_dir):
    rows = usage(spark, sf_dir).withColumn("priority", F.col("k") % 10)
    return W.first_of(rows, ["event_type"], [F.asc("priority"), F.asc("event_id")], 4).select("event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 3")
def cache_evictions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n > 3").select("user_id", "event_id", "event_type")


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(14,4))) OVER w AS DOUBLE) AS total, count(*) OVER w AS n, round(CAST(sum(CAST(value AS DECIMAL(14,4))) OVER w AS DOUBLE) / count(*) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def moving_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.col("value").cast("decimal(14,4)").alias("value"))
    return W.moving(rows, "event_type", "ts", "event_id", 100, total=F.sum("value"), n=F.count("*")).select("event_id", F.col("total").cast("double").alias("total"), "n", F.round(F.col("total").cast("double") / F.col("n"), 6).alias("mean"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def customers_with_finished_orders(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def customers_without_large_orders(spark, sf_dir):
    placed = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(placed, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def plans_with_step_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = R.with_stats(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", n_orders=F.count("o_orderkey"), total=F.sum("o_totalprice"))
    return out.withColumn("total", F.round("total", 2))


@query("""SELECT o_orderkey, count(*) AS n_steps, count(*) FILTER (WHERE l_linestatus = 'F') AS n_done, count(*) = count(*) FILTER (WHERE l_linestatus = 'F') AS complete FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def plan_completion(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_steps"), F.count_if(F.col("l_linestatus") == "F").alias("n_done"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(steps, "o_orderkey").withColumn("complete", F.col("n_steps") == F.col("n_done"))


@query("""SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def lookup_chain(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"WITH {_CATALOG} SELECT count(*) AS documents, count(*) FILTER (WHERE status_id = 3) AS indexed, count(*) FILTER (WHERE status_id = 2) AS review, count(DISTINCT source) AS folders, (SELECT count(*) FROM embeddings) AS vectors FROM catalog")
def catalog_counts(spark, sf_dir):
    counts = catalog(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(F.col("status_id") == 3).alias("indexed"), F.count_if(F.col("status_id") == 2).alias("review"), F.countDistinct("source").alias("folders"))
    return counts.withColumn("vectors", F.lit(table(spark, sf_dir, "embeddings").count()))


@query("""WITH l AS (SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)), o AS (SELECT doc_id, n_chars AS m FROM l WHERE toxic IS DISTINCT FROM 1), n AS (SELECT doc_id, n_chars + 1 - quality AS m FROM l WHERE quality IS NOT NULL)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.m IS NOT DISTINCT FROM n.m THEN 'unchanged' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def manifest_diff(spark, sf_dir):
    """From documents that are not toxic to labelled ones, whose size differs where their quality is low; each document is in one or both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    newer = docs.where("quality IS NOT NULL").select("doc_id", (F.col("n_chars") + 1 - F.col("quality")).alias("n_chars"))
    return R.snapshot_diff(docs.where("toxic IS DISTINCT FROM 1").select("doc_id", "n_chars"), newer, "doc_id", "n_chars")


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN lang ELSE coalesce('new', lang) END AS lang, source FROM (SELECT d.doc_id, d.lang, d.source, l.quality FROM documents d JOIN labels l USING (doc_id))
UNION ALL SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def upsert_keep_old_if_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") != 0, "new").alias("lang"))
    return R.upsert(docs, changes, "doc_id")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_size <= 10""")
def insert_or_ignore(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return R.insert_new(part.where("p_size > 10").select("p_partkey", "p_name"), part.select("p_partkey", F.upper("p_name").alias("p_name")), "p_partkey")


@query(rf"""WITH {_LINES} SELECT CASE WHEN length(trim(line)) = 0 THEN 'blank' WHEN regexp_matches(line, '^\s*[-*•] ') THEN 'list' WHEN contains(line, '|') THEN 'table'
 WHEN regexp_matches(line, '[=+^]') AND regexp_matches(line, '[0-9]') THEN 'formula' ELSE 'paragraph' END AS kind, count(*) AS n FROM lines GROUP BY 1""")
def line_kinds(spark, sf_dir):
    return lines(table(spark, sf_dir, "documents")).groupBy(C.line_kind("line").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(regexp_replace(regexp_replace(text, 'password', '[REDACTED]', 'gi'), 'token', '[REDACTED]', 'gi')) AS n FROM documents WHERE regexp_matches(lower(text), 'password|token')")
def redacted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.lower("text").rlike("password|token"))
    return docs.select("doc_id", F.length(C.redact("text", ["password", "token"])).cast("long").alias("n"))


@query("""WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark), words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT doc_id, count(DISTINCT term) AS n_terms, count(*) AS n_hits FROM words JOIN terms USING (term) GROUP BY doc_id""".replace("\\\\", "\\"))
def term_matches(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term")).distinct()
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("term"))
    found = words.join(terms, "term").groupBy("doc_id", "term").agg(F.count("*").alias("n"))  # the few known terms first
    return found.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_hits"))


_DISTANCE = "round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))), 6)"


@query(f"SELECT a.vec_id, a.label, {_DISTANCE} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = 7 WHERE a.label IN (1, 3, 5, 7, 9) ORDER BY distance, a.vec_id LIMIT 15")
def vector_search_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 7").select("embedding").first()
    if asked is None:  # nothing is near to a vector that isn't there
        return vectors.limit(0).select("vec_id", "label", F.lit(0.0).alias("distance"))
    query_vector = asked[0]
    return V.nearest(vectors.where(F.col("label").isin(1, 3, 5, 7, 9)), query_vector, 15).select("vec_id", "label", "distance")


@query(f"""WITH h AS (SELECT a.vec_id AS item, b.vec_id AS q, {_DISTANCE} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id IN (3, 11, 42)),
j AS (SELECT item, round(distance * (1 + 0.1 * (1 - least(n_chars / 500, 1.0))), 6) AS adjusted FROM h JOIN documents ON doc_id = item)
SELECT item, min(adjusted) AS distance, count(*) AS n_queries FROM j WHERE adjusted < 1.35 GROUP BY item""")
def multi_query_fusion(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id").isin(3, 11, 42)).select("embedding").collect()  # the stated questions
    each = F.array(*(F.array(*(F.lit(float(x)) for x in r[0])) for r in asked)).cast("array<array<double>>")
    hits = vectors.select(F.col("vec_id").alias("item"), "embedding", F.explode(each).alias("q")).select("item", F.round(C.distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return V.fused(hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "n_chars"), "item"), 1.35)


@query("SELECT event_id, round((1 - least(value / 15, 1.0)) / 3 + k / 100.0 * 2 / 3, 6) AS score FROM (SELECT event_id, value, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events)")
def profile_scores(spark, sf_dir):
    return usage(spark, sf_dir).select("event_id", V.profile_score(F.col("value"), F.col("k") / 100, 0.4, 0.8).alias("score"))


@query("""WITH r AS (SELECT event_type, value / 100 AS s, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS n FROM events), b AS (SELECT event_type, max(s) AS best, max(s) FILTER (WHERE n = 2) AS second FROM r WHERE n <= 2 GROUP BY 1)
SELECT event_type, round(best, 6) AS best, round(best - coalesce(second, 0), 6) AS margin, round(greatest(0.2, 1 / (1 + exp(-(4 * (best + 0.5 * (best - coalesce(second, 0))) - 2)))), 4) AS confidence FROM b""")
def answer_confidence(spark, sf_dir):
    return V.margin(table(spark, sf_dir, "events").withColumn("s", F.col("value") / 100), "event_type", "s")


@query("SELECT event_id, round(least(100, value / 95 * 100), 4) AS heat, round(least(100, value / 450 * 100), 4) AS power FROM events")
def load_percentages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(C.load_percent(F.col("value"), 95), 4).alias("heat"), F.round(C.load_percent(F.col("value"), 450), 4).alias("power"))


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retained_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    as_of = rows.agg(F.max("ts")).first()[0]
    return rows.where(F.col("ts") >= F.lit(as_of) - F.expr("INTERVAL 7 DAYS")).select("event_id", "ts", "user_id")


@query("SELECT source, count(*) AS n_docs, list_sort(list(DISTINCT lang)) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def folder_payload(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sort_array(F.collect_set("lang")).alias("langs"), F.sum("n_chars").alias("chars"))
