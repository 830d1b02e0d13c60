"""Queries on chunks, categories, matching, ranking and upserts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions import columns as C
from loomline.operators import chunks as K
from loomline.operators import relational as R
from loomline.operators import windows as W
from loomline.plans.registry import _LINES, query
from loomline.sources.tables import lines, table

_KIND = r"""CASE WHEN length(trim(line)) = 0 THEN 'blank' WHEN regexp_matches(line, '^\s*[-*•] ') THEN 'list' WHEN contains(line, '|') THEN 'table'
 WHEN regexp_matches(line, '[=+^]') AND regexp_matches(line, '[0-9]') THEN 'formula' ELSE 'paragraph' END"""
_NAME = "lower(replace(replace(p_name, 'µ', 'u'), 'Ω', 'ohm'))"
CATEGORIES = [("secrets", 3, ["password", "token"]), ("law", 2, ["license", "copyright"]), ("contact", 1, ["mail", "phone"])]


@query(rf"""WITH {_LINES}, k AS (SELECT *, {_KIND} AS kind FROM lines), f AS (SELECT *, CASE WHEN kind = 'blank' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line_index) THEN 1 ELSE 0 END AS cut FROM k),
b AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY line_index) AS block FROM f) SELECT doc_id, CAST(block AS BIGINT) AS block, min(kind) AS kind, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM b WHERE kind <> 'blank' GROUP BY doc_id, block""")
def chunk_blocks(spark, sf_dir):
    return K.blocks(lines(table(spark, sf_dir, "documents"))).select("doc_id", "block", "kind", "n_lines", "chars")


@query()
def chunk_documents(spark, sf_dir):
    return K.merge_blocks(K.blocks(lines(table(spark, sf_dir, "documents"))), size=420)


@query(r"""SELECT doc_id, count(*) AS raw, count(*) FILTER (WHERE NOT low) AS kept, count(*) FILTER (WHERE low) AS dropped FROM
 (SELECT doc_id, regexp_matches(l, '^[0-9 .,]*$') OR (length(l) - length(replace(l, '.', ''))) > 0.45 * length(l) AS low FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \t]+', ' ', 'g')) AS l FROM documents)) GROUP BY doc_id""")
def normalized_lines(spark, sf_dir):
    line = F.trim(F.regexp_replace("line", r"[ \t]+", " "))
    rows = lines(table(spark, sf_dir, "documents")).select("doc_id", C.low_value(line).alias("low"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("raw"), F.count_if(~F.col("low")).alias("kept"), F.count_if("low").alias("dropped"))


_HITS = ", ".join("(" + " + ".join(f"len(string_split(lower(text), '{w}')) - 1" for w in words) + f") AS {name}" for name, _, words in CATEGORIES)


@query(f"""WITH h AS (SELECT doc_id, {_HITS} FROM documents), g AS (SELECT doc_id, greatest(secrets * 10 + 3, law * 10 + 2, contact * 10 + 1) AS best, secrets + law + contact AS n FROM h)
SELECT doc_id, CASE WHEN n = 0 THEN 'General Information' WHEN best % 10 = 3 THEN 'secrets' WHEN best % 10 = 2 THEN 'law' ELSE 'contact' END AS category FROM g WHERE n IS NOT NULL""")
def document_categories(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", C.category(F.lower("text"), CATEGORIES, "General Information").alias("category"))


@query(f"SELECT p_partkey, trim(regexp_replace({_NAME}, '[^a-z0-9]+', ' ', 'g')) AS name, regexp_replace({_NAME}, '[^a-z0-9]+', '', 'g') AS compact FROM part")
def part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.part_name("p_name").alias("name"), C.part_name("p_name", "").alias("compact"))


@query(f"""WITH s AS (SELECT key, max(p_partkey) AS hit FROM (SELECT p_partkey, unnest([{_NAME}, lower(p_brand)]) AS key FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)) GROUP BY key),
n AS (SELECT p_partkey, unnest([{_NAME}, lower(p_brand), lower(p_type)]) AS key, unnest([0, 1, 2]) AS pos FROM part) SELECT p_partkey, arg_min(hit, pos) AS hit, min(pos) AS pos FROM n JOIN s USING (key) GROUP BY p_partkey""")
def stock_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.lower(F.replace(F.replace("p_name", F.lit("µ"), F.lit("u")), F.lit("Ω"), F.lit("ohm")))
    large = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    stock = part.join(large, "p_partkey", "left_semi").select("p_partkey", F.explode(F.array(name, F.lower("p_brand"))).alias("key"))
    return R.first_key_hit(part.select("p_partkey", F.array(name, F.lower("p_brand"), F.lower("p_type")).alias("keys")), stock.groupBy("key").agg(F.max("p_partkey").alias("hit")), "p_partkey")


@query("""SELECT l_orderkey, count(*) AS pins, count(*) >= 4 AND (max(l_linenumber) - min(l_linenumber) + 1 <> count(*) OR count(DISTINCT l_linenumber) <> count(*)) AS has_gap FROM lineitem GROUP BY l_orderkey""")
def pin_gaps(spark, sf_dir):
    n, seen = F.count("*"), F.col("l_linenumber")
    gap = (n >= 4) & ((F.max(seen) - F.min(seen) + 1 != n) | (F.size(F.collect_set(seen)) != n))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("pins"), gap.alias("has_gap"))


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS a FROM part), t AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) AS b FROM d WHERE a = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS c FROM t WHERE b <= 2) SELECT p_brand, p_partkey FROM c WHERE c <= 24""")
def facts_capped(spark, sf_dir):
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    once = W.first_of(table(spark, sf_dir, "part"), ["p_brand", "p_type"], order, 1)
    return W.first_of(W.first_of(once, ["p_brand", "p_size"], order, 2), ["p_brand"], order, 24).select("p_brand", "p_partkey")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) SELECT o_custkey, o_orderpriority, o_orderkey, n FROM r WHERE i = 1""")
def best_of_copies(spark, sf_dir):
    best = F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(best.alias("o_orderkey"), F.count("*").alias("n"))


@query("""WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), s AS (SELECT event_type, event_id, CASE WHEN lo >= 0 AND hi <= 1 THEN value WHEN lo = hi THEN 0.5 ELSE (value - lo) / (hi - lo) END AS score FROM events JOIN b USING (event_type)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) AS i, max(score) OVER (PARTITION BY event_type) AS top FROM s)
SELECT event_type, event_id, round(score, 6) AS score, score < 0.1 AS below FROM r WHERE (score >= 0.1 AND i <= 15) OR (top < 0.1 AND i <= 8)""")
def rerank_selection(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bounds = events.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    plain = F.when((F.col("lo") >= 0) & (F.col("hi") <= 1), F.col("value")).when(F.col("lo") == F.col("hi"), 0.5).otherwise((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    top = W.first_of(events.join(bounds, "event_type").withColumn("score", plain), ["event_type"], [F.desc("score"), F.asc("event_id")], 15)
    w = Window.partitionBy("event_type").orderBy(F.desc("score"), F.asc("event_id"))
    ranked = top.withColumn("i", F.row_number().over(w)).withColumn("best", F.first("score").over(w))
    return ranked.where((F.col("score") >= 0.1) | ((F.col("best") < 0.1) & (F.col("i") <= 8))).select("event_type", "event_id", F.round("score", 6).alias("score"), (F.col("score") < 0.1).alias("below"))


@query("""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark) SELECT term, count(*) AS n, list(item_id ORDER BY item_id)[1:3] AS examples FROM w GROUP BY term""")
def term_examples(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")).distinct()
    few = W.first_of(words, ["term"], [F.asc("item_id")], 3).groupBy("term").agg(F.sort_array(F.collect_list("item_id")).alias("examples"))
    return words.groupBy("term").agg(F.count("*").alias("n")).join(few, "term")


@query(r"""WITH q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}-]{2,}')) AS term FROM conversations), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}-]{2,}')) AS term FROM documents)
SELECT term, doc_id FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS i FROM d JOIN q USING (term)) WHERE i <= 3""")
def question_documents(spark, sf_dir):
    terms = lambda df, *keys: df.select(*keys, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}-]{2,}"), F.lit(0))).alias("term")).distinct()
    met = terms(table(spark, sf_dir, "documents"), "doc_id").join(terms(table(spark, sf_dir, "conversations")), "term", "left_semi")
    return W.first_of(met, ["term"], [F.asc("doc_id")], 3).select("term", "doc_id")


@query("""WITH n AS (SELECT o_custkey AS k, max(o_orderpriority) AS name, CASE WHEN max(o_orderstatus) = 'P' THEN '' ELSE max(o_orderstatus) END AS seg, max(o_totalprice) AS bal, 0 AS nation FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN c_name ELSE name END AS c_name, coalesce(nullif(seg, ''), c_mktsegment) AS c_mktsegment, greatest(c_acctbal, bal) AS c_acctbal, coalesce(c_nationkey, nation) AS c_nationkey FROM customer FULL JOIN n ON c_custkey = k""")
def upsert_rules(spark, sf_dir):
    status = F.max("o_orderstatus")
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_name"), F.when(status == "P", "").otherwise(status).alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal"), F.lit(0).alias("c_nationkey"))
    return R.merge_rows(table(spark, sf_dir, "customer"), changes, "c_custkey", {"c_name": "overwrite", "c_mktsegment": "keep_if_empty", "c_acctbal": "greatest", "c_nationkey": "existing"})


@query("SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type = 'error') >= 3 AS disabled FROM events GROUP BY user_id")
def login_lockouts(spark, sf_dir):
    failed = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), failed.alias("failures"), (failed >= 3).alias("disabled"))


@query(r"""WITH t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0) AS n FROM documents), s AS (SELECT source, sum(n)::DOUBLE AS total FROM t GROUP BY source),
r AS (SELECT source, CASE WHEN total > 0 THEN least(1.0::DOUBLE, 0.75::DOUBLE * ((SELECT max(total) FROM s) / total)) ELSE 1.0::DOUBLE END AS rate FROM s)
SELECT doc_id, t.source, round(rate, 9) AS rate, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296::DOUBLE < rate AS kept FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source""")
def source_balance(spark, sf_dir):
    """Which documents a sample weighted against large sources keeps."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(C.n_tokens("text"), F.lit(0)).alias("n"))
    return R.kept_by_share(rows, "doc_id", "source", "n").select("doc_id", "source", F.round("rate", 9).alias("rate"), "kept")
