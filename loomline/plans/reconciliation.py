"""Usage, prices and the reconciliation of estimated with verified cost; all money in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import windows as W
from loomline.plans.registry import _USAGE, query
from loomline.sources.tables import table, usage

#: Parameters: prices per million tokens of input, cached input and output, by model; and the overrides of some scopes.
PRICES = [("click", "5", "0.5", "30"), ("view", "2.5", "0.25", "10"), ("signup", "1.1", "0.55", "4.4"), ("purchase", "0.15", "0.075", "0.6")]
OVERRIDES = [(1, "click", None, "4", "0.4", "25"), (2, "view", 3, "2", None, "9"), (3, "purchase", 4, None, "0.05", None)]
MONEY = "decimal(18,8)"


def priced(spark) -> tuple[DataFrame, DataFrame]:
    base = spark.createDataFrame(PRICES, "model string, i string, c string, o string").select("model", *(F.col(x).cast("decimal(12,6)").alias(x) for x in "ico"))
    own = spark.createDataFrame(OVERRIDES, "override long, model string, entity long, oi string, oc string, oo string")
    return base, own.select("override", "model", "entity", *(F.col(f"o{x}").cast("decimal(12,6)").alias(f"o{x}") for x in "ico"))


def event_cost(input_tokens: Column, cached: Column, output: Column, i: Column, c: Column, o: Column) -> Column:
    """Cost of an event to 8 places, half up; cached tokens are part of the input."""
    n = lambda x: F.greatest(F.lit(0), x).cast("decimal(12,0)")
    return F.round((n(input_tokens - cached) * i + n(cached) * c + n(output) * o) / F.lit(1_000_000).cast("decimal(7,0)"), 8).cast(MONEY)


def token_events(spark, sf_dir) -> DataFrame:
    """Events as calls of a model: tokens from their count and value, a tenant from the user."""
    rows = usage(spark, sf_dir)
    return rows.select("event_id", F.to_date("ts").alias("day"), F.col("event_type").alias("model"), (F.col("user_id") % 5).alias("entity"), (F.col("k") * 20).alias("input"), (F.col("k") * (F.col("event_id") % 4)).alias("cached"), F.floor("value").cast("long").alias("output"))


def costed(spark, sf_dir) -> DataFrame:
    """Each event with its price: the override of its tenant, else that of all tenants, else the list's. Models without a
    price cost 0. The price tables are parameters of a few rows, so they are broadcast."""
    base, own = priced(spark)
    rows = token_events(spark, sf_dir).join(F.broadcast(base), "model", "left")
    tenant = own.where("entity IS NOT NULL").withColumnRenamed("override", "t")
    shared = own.where("entity IS NULL").drop("entity").select("model", F.col("override").alias("s"), *(F.col(f"o{x}").alias(f"s{x}") for x in "ico"))
    rows = rows.join(F.broadcast(tenant), ["model", "entity"], "left").join(F.broadcast(shared), "model", "left")
    price = {x: F.coalesce(F.when(F.col("t").isNotNull(), F.coalesce(f"o{x}", x)), f"s{x}", x, F.lit(0)).cast("decimal(12,6)") for x in "ico"}
    cost = event_cost(F.col("input"), F.col("cached"), F.col("output"), price["i"], price["c"], price["o"])
    return rows.select("event_id", "day", "model", "entity", "input", "cached", "output", cost.alias("cost"), F.coalesce("t", "s").isNotNull().alias("is_override"))


_BASE = ", ".join(f"('{m}', {i}, {c}, {o})" for m, i, c, o in PRICES)
_OWN = ", ".join("({})".format(", ".join("NULL" if v is None else f"'{v}'" if k == 1 else str(v) for k, v in enumerate(r))) for r in OVERRIDES)
#: Prices in millionths, costs in units of 1e-8, both whole numbers.
_COSTED = f"""{_USAGE}, base(model, i, c, o) AS (VALUES {_BASE}), own(override, model, entity, oi, oc, oo) AS (VALUES {_OWN}),
e AS (SELECT event_id, CAST(ts AS DATE) AS day, event_type AS model, user_id % 5 AS entity, k * 20 AS input, k * (event_id % 4) AS cached, CAST(floor(value) AS BIGINT) AS output FROM usage),
p AS (SELECT e.*, t.override IS NOT NULL OR s.override IS NOT NULL AS is_override,
  CAST(round(coalesce(CASE WHEN t.override IS NOT NULL THEN coalesce(t.oi, i) END, s.oi, i, 0) * 1000000) AS HUGEINT) AS pi,
  CAST(round(coalesce(CASE WHEN t.override IS NOT NULL THEN coalesce(t.oc, c) END, s.oc, c, 0) * 1000000) AS HUGEINT) AS pc,
  CAST(round(coalesce(CASE WHEN t.override IS NOT NULL THEN coalesce(t.oo, o) END, s.oo, o, 0) * 1000000) AS HUGEINT) AS po
  FROM e LEFT JOIN base b ON b.model = e.model LEFT JOIN own t ON t.model = e.model AND t.entity = e.entity LEFT JOIN own s ON s.model = e.model AND s.entity IS NULL),
costed AS (SELECT *, (2 * (greatest(0, input - cached) * pi + greatest(0, cached) * pc + greatest(0, output) * po) + 10000) // 20000 AS units FROM p)"""


@query(f"WITH {_COSTED} SELECT event_id, model, CAST(units / 1e8 AS DOUBLE) AS cost, is_override FROM costed")
def event_costs(spark, sf_dir):
    return costed(spark, sf_dir).select("event_id", "model", F.col("cost").cast("double").alias("cost"), "is_override")


@query(f"""WITH {_COSTED}, w AS (SELECT *, sum(units) OVER b AS t, count(*) OVER b AS n, row_number() OVER (PARTITION BY model, day ORDER BY event_id) AS r FROM costed WINDOW b AS (PARTITION BY model, day)),
v AS (SELECT *, CASE WHEN t > 0 THEN (CAST(2500000000 AS HUGEINT) * units + t) // (2 * t) ELSE (2500000000 + n) // (2 * n) END AS share FROM w),
a AS (SELECT *, CASE WHEN r = n THEN 1250000000 - coalesce(sum(share) OVER (PARTITION BY model, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END AS final FROM v)
SELECT event_id, CAST(final / 1e8 AS DOUBLE) AS final_cost, CAST((final - units) / 1e8 AS DOUBLE) AS discrepancy FROM a""")
def allocation_shares(spark, sf_dir):
    """A verified total of 12.5 for each model and day, shared by estimated cost; the last event takes the remainder. A
    window holds one model's day, the bucket that a provider's bill has."""
    rows = costed(spark, sf_dir).withColumn("total", F.lit("12.50000000").cast("decimal(14,8)")).withColumn("weight", F.col("cost").cast("decimal(14,8)"))
    shared = W.allocate(rows, ["model", "day"], "event_id", "total", "weight")
    return shared.select("event_id", F.col("allocated").cast("double").alias("final_cost"), (F.col("allocated") - F.col("cost")).cast("double").alias("discrepancy"))


@query(f"""WITH {_COSTED}, d AS (SELECT day, count(*) AS n, sum(units) AS est, sum(greatest(0, input)) AS input, sum(greatest(0, output)) AS output, (sum(input) * 1000) AS ver FROM costed GROUP BY day),
r AS (SELECT *, CASE WHEN est > 0 THEN CAST((2 * ver * 10000 + est) // (2 * est) AS DOUBLE) / 10000 END AS ratio FROM d)
SELECT day, n, CAST(est / 1e8 AS DOUBLE) AS estimated, CAST(ver / 1e8 AS DOUBLE) AS verified, CASE WHEN abs(ver - est) <= 100 THEN 'verified' ELSE 'adjusted' END AS status, ratio,
 CASE WHEN input + output > 0 THEN CAST((2 * CAST(ver AS HUGEINT) * 10000 + input + output) // (2 * (input + output)) AS DOUBLE) / 1000000 END AS per_million,
 CASE WHEN ratio < 0.8 THEN 'low' WHEN ratio > 1.2 THEN 'high' END AS warning FROM r""")
def reconciliation_days(spark, sf_dir):
    """Estimated against verified cost by day: status, ratio to 4 places, effective rate to 6, and a warning under 0.80 or over 1.20."""
    rows = costed(spark, sf_dir)
    days = rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("cost").alias("estimated"), F.sum(F.greatest(F.lit(0), "input")).alias("input"), F.sum(F.greatest(F.lit(0), "output")).alias("output"), (F.sum("input").cast("decimal(18,0)") / 100_000).cast("decimal(18,8)").alias("verified"))
    ratio = F.when(F.col("estimated") > 0, F.round(F.col("verified") / F.col("estimated"), 4)).cast("double")
    total = (F.col("input") + F.col("output")).cast("decimal(18,0)")
    rate = F.when(total > 0, F.round(F.col("verified") * F.lit(1_000_000).cast("decimal(7,0)") / total, 6)).cast("double")
    status = F.when(F.abs(F.col("verified") - F.col("estimated")) <= F.lit("0.000001").cast("decimal(18,8)"), "verified").otherwise("adjusted")
    out = days.select("day", "n", F.col("estimated").cast("double").alias("estimated"), F.col("verified").cast("double").alias("verified"), status.alias("status"), ratio.alias("ratio"), rate.alias("per_million"))
    return out.withColumn("warning", F.when(F.col("ratio") < 0.8, "low").when(F.col("ratio") > 1.2, "high"))


def payload_total(payload: Column) -> Column:
    """The sum of all amounts of a provider's answer {"data": [{"results": [{"amount": {"value": ...}}]}]}; no amount is 0."""
    parsed = F.from_json(payload, "data array<struct<results: array<struct<amount: struct<value: string>>>>>")
    values = F.flatten(F.transform(F.coalesce(parsed["data"], F.array()), lambda d: F.coalesce(F.transform(d["results"], lambda r: r["amount"]["value"]), F.array().cast("array<string>"))))
    return F.aggregate(values, F.lit(0).cast("decimal(38,8)"), lambda s, v: (s + F.coalesce(v.cast(MONEY), F.lit(0).cast(MONEY))).cast("decimal(38,8)"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) / 100 AS total FROM events GROUP BY event_type")
def provider_payload_totals(spark, sf_dir):
    """Each event's properties as a provider's answer with one amount, read back from JSON and summed."""
    k = F.get_json_object("props", "$.k").cast("long")
    amount = F.struct(F.struct((k.cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string").alias("value")).alias("amount"))
    rows = table(spark, sf_dir, "events").select("event_type", F.to_json(F.struct(F.array(F.struct(F.array(amount).alias("results"))).alias("data"))).alias("payload"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(payload_total(F.col("payload"))).cast("double").alias("total"))


@query(f"WITH {_COSTED}, l AS (SELECT * FROM costed ORDER BY event_id DESC LIMIT 2000), g AS (SELECT coalesce(nullif(CASE WHEN model = 'error' THEN '' ELSE model END, ''), 'Unknown') AS label, count(*) AS n, CAST(sum(input + cached + output) AS BIGINT) AS tokens, sum(units) AS u, max(event_id) AS f FROM l GROUP BY 1) SELECT label, n, tokens, CAST(u / 1e8 AS DOUBLE) AS cost, row_number() OVER (ORDER BY u DESC, f DESC) AS place FROM g")
def usage_breakdown_page(spark, sf_dir):
    """The newest 2,000 events (the page) by label, most expensive first; an empty label is 'Unknown'."""
    page = costed(spark, sf_dir).orderBy(F.desc("event_id")).limit(2000)
    label = F.coalesce(F.nullif(F.when(F.col("model") == "error", "").otherwise(F.col("model")), F.lit("")), F.lit("Unknown"))
    groups = page.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("input") + F.col("cached") + F.col("output")).alias("tokens"), F.sum("cost").alias("c"), F.max("event_id").alias("f"))
    return W.placed(groups, [F.desc("c"), F.desc("f")], "place").select("label", "n", "tokens", F.col("c").cast("double").alias("cost"), "place")


@query(f"""WITH {_COSTED}, s AS (SELECT user_id % 5 AS entity, n_nationkey, n_name FROM (SELECT DISTINCT user_id % 5 AS user_id FROM events) JOIN nation ON n_nationkey = user_id % 5)
SELECT c.event_id, s.n_name AS entity_name, r.r_name AS region_name, u.c_name AS user_name, o.c_name AS owner_name, sup.s_name AS provider_name FROM costed c JOIN events e USING (event_id)
LEFT JOIN s ON s.entity = c.entity LEFT JOIN customer u ON u.c_custkey = e.user_id LEFT JOIN customer o ON o.c_custkey = e.user_id + 1 LEFT JOIN supplier sup ON sup.s_suppkey = e.event_id % 7 LEFT JOIN region r ON r.r_regionkey = c.entity""")
def usage_event_details(spark, sf_dir):
    """Events left-joined to five lookups, one of them (users) in two roles; an event without a match stays."""
    rows = costed(spark, sf_dir).select("event_id", "entity").join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    users = table(spark, sf_dir, "customer")
    star = {
        "entity_name": (table(spark, sf_dir, "nation"), "n_nationkey", "n_name", F.col("entity")),
        "region_name": (table(spark, sf_dir, "region"), "r_regionkey", "r_name", F.col("entity")),
        "user_name": (users, "c_custkey", "c_name", F.col("user_id")),
        "owner_name": (users, "c_custkey", "c_name", F.col("user_id") + 1),
        "provider_name": (table(spark, sf_dir, "supplier"), "s_suppkey", "s_name", F.col("event_id") % 7),
    }
    for name, (lookup, key, label, value) in star.items():
        rows = rows.withColumn("_key", value.cast("long")).join(lookup.select(F.col(key).cast("long").alias("_key"), F.col(label).alias(name)), "_key", "left").drop("_key")
    return rows.select("event_id", *star)


#: Columns of the export, in order.
EXPORT = ["event_id", "day", "model", "entity", "input", "cached", "output", "cost", "is_override"]


def export_csv(spark, sf_dir, path: str) -> None:
    """The priced events as CSV with a header, written in parallel; null cells are empty."""
    costed(spark, sf_dir).select(*EXPORT).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def budget_status(spent: Column, budget: Column, warn: int = 80, stop: int = 100) -> Column:
    """ok, warn or stop by the share of a budget that is spent; without a budget (0 or null) always ok."""
    used = spent * 100 / budget
    return F.when(F.coalesce(budget, F.lit(0)) <= 0, "ok").when(used >= stop, "stop").when(used >= warn, "warn").otherwise("ok")


@query(f"""WITH {_COSTED}, spends AS (SELECT entity, sum(units) AS u FROM costed GROUP BY entity) SELECT entity, CAST(u / 1e8 AS DOUBLE) AS spent, CASE WHEN entity = 0 THEN 'ok' WHEN u * 100 >= 100 * entity * 10000000 * 5 THEN 'stop' WHEN u * 100 >= 80 * entity * 10000000 * 5 THEN 'warn' ELSE 'ok' END AS status FROM spends""")
def entity_budgets(spark, sf_dir):
    """Spend of each tenant against a budget of half a dollar times its number (tenant 0 has none)."""
    spent = costed(spark, sf_dir).groupBy("entity").agg(F.sum("cost").alias("spent"))
    return spent.select("entity", F.col("spent").cast("double").alias("spent"), budget_status(F.col("spent"), F.col("entity").cast("decimal(10,0)") / 2).alias("status"))
