"""Search in batches: several questions at once within a scope, variants of a question, profiles, confidences; with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import columns as C
from loomline.plans.registry import _CATALOG, _DISTANCE, query
from loomline.sources.tables import catalog, table

#: Pairs of a phrase and what may stand for it.
SYNONYMS = [("the", "that"), ("und", "oder"), ("la", "le"), ("password", "secret")]
#: Words that choose a profile, in order, with its weights of closeness and rerank score.
PROFILES = {"code": (["function", "http"], 0.7, 0.3), "french": (["eau", "ouè"], 0.2, 0.6), "default": ([], 0.4, 0.6)}
ACTION_WORDS = ["click", "enter", "select", "choose", "screen", "dashboard", "button", "setting"]


def nearest_of_each(items: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question, item, distance): the k nearest items of each question. The stated questions are few and broadcast; each item
    meets all of them in one scan, and a task keeps k of a question before rows are shuffled."""
    each = items.join(F.broadcast(questions)).select("question", "item", F.round(C.distance(F.col("vector"), F.col("asked")), 6).alias("distance"))
    w = Window.partitionBy("question").orderBy("distance", "item")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _asked(spark, sf_dir, ids: list[int]) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(ids)).select(F.col("vec_id").alias("question"), F.col("embedding").alias("asked"))


@query(f"""WITH {_CATALOG}, h AS (SELECT b.vec_id AS question, a.vec_id AS item, {_DISTANCE} AS distance FROM embeddings a JOIN catalog ON doc_id = a.vec_id JOIN embeddings b ON b.vec_id IN (3, 11, 42) WHERE status_id = 3 AND (is_global OR entity_id = 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, item) AS rank FROM h) SELECT question, item, distance, rank FROM r WHERE rank <= 15""")
def scoped_search(spark, sf_dir):
    """Nearest indexed items that a tenant sees; the scope is applied before distances. Absent questions have no rows."""
    seen = catalog(spark, sf_dir).where((F.col("status_id") == 3) & C.visible_to(2)).select(F.col("doc_id").alias("item"))
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")).join(seen, "item")
    return nearest_of_each(items, _asked(spark, sf_dir, [3, 11, 42]), 15)


_ACTION = "(" + " OR ".join(f"contains(lower(text), '{w[:3]}')" for w in ACTION_WORDS) + ")"


@query(f"""WITH h AS (SELECT b.vec_id AS question, a.vec_id AS item, {_DISTANCE} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id IN (5, 9)), k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question ORDER BY distance, item) <= 8),
s AS (SELECT question, item, round(distance - CASE WHEN coalesce({_ACTION}, false) THEN 0.05 ELSE 0 END, 6) AS distance FROM k LEFT JOIN documents ON doc_id = item) SELECT question, item, distance FROM s QUALIFY row_number() OVER (PARTITION BY question ORDER BY distance, item) <= 4""")
def image_search(spark, sf_dir, n: int = 4):
    """Twice the wanted number by distance; a text with the start of an action word brings an item nearer by 0.05; then the nearest."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    hits = nearest_of_each(items, _asked(spark, sf_dir, [5, 9]), 2 * n)
    acts = F.lit(False)
    for w in ACTION_WORDS:
        acts = acts | F.contains(F.lower("text"), F.lit(w[:3]))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), acts.alias("acts"))
    nearer = hits.join(texts, "item", "left").withColumn("distance", F.round(F.col("distance") - F.when(F.col("acts"), 0.05).otherwise(0.0), 6))
    return nearer.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("distance", "item"))).where(F.col("rank") <= n).select("question", "item", "distance")


def variants(text: Column, pairs=None) -> Column:
    """The text with secrets masked, lower-case and squeezed, and one variant for each pair whose first phrase it holds; each once."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, "(?i)password", "[REDACTED]"))), r"\s+", " ")
    made = [F.when(F.contains(plain, F.lit(a)), F.replace(plain, F.lit(a), F.lit(b))) for a, b in pairs or SYNONYMS]
    return F.array_distinct(F.array_compact(F.array(*made, plain)))


@query(f"""WITH p AS (SELECT conv_id, turn, regexp_replace(lower(trim(regexp_replace(text, '(?i)password', '[REDACTED]', 'g'))), '\\s+', ' ', 'g') AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, unnest(list_distinct([{", ".join(f"CASE WHEN contains(t, '{a}') THEN replace(t, '{a}', '{b}') END" for a, b in SYNONYMS)}, t])) AS variant FROM p""")
def question_variants(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(variants(F.col("text"))).alias("variant"))


def profile(question: Column) -> Column:
    """(profile, weight of closeness, weight of rerank): the first whose words the question holds, else the default; weights sum to 1."""
    low, out = F.lower(question), F.when(F.lit(False), None)
    for name, (words, a, b) in PROFILES.items():
        holds = F.lit(name == "default")
        for w in words:
            holds = holds | F.contains(low, F.lit(w))
        out = out.when(holds, F.struct(F.lit(name).alias("profile"), F.lit(a / (a + b)).alias("closeness"), F.lit(b / (a + b)).alias("rerank")))
    return out


@query(f"""WITH q AS (SELECT conv_id, turn, length(text) % 15 AS d, (length(text) % 10) / 10 AS r, CASE {" ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, (words, _, _) in PROFILES.items() if words)} ELSE 'default' END AS profile FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, profile, round((1 - least(d / 15, 1)) * CASE profile WHEN 'code' THEN 0.7 WHEN 'french' THEN 0.25 ELSE 0.4 END + r * CASE profile WHEN 'code' THEN 0.3 WHEN 'french' THEN 0.75 ELSE 0.6 END, 6) AS score FROM q""")
def profile_fusion(spark, sf_dir):
    """Scores of turns by the profile that their words choose; distance and rerank score stand in as remainders of the length."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", (F.length("text") % 15).alias("d"), (F.length("text") % 10 / 10).alias("r"), profile(F.col("text")).alias("p"))
    return rows.select("conv_id", "turn", "p.profile", F.round((1 - F.least(F.col("d") / 15, F.lit(1.0))) * F.col("p.closeness") + F.col("r") * F.col("p.rerank"), 6).alias("score"))


def confidence(best: Column, second: Column, method: str) -> Column:
    """From the two best scores: linear_margin, normalized_ratio or sigmoid_margin; 0.2 to 1."""
    lead = best - second
    raw = {"linear_margin": 0.6 * best + 0.4 * lead, "normalized_ratio": F.when(best == 0, 0.2).otherwise(lead / best), "sigmoid_margin": 1 / (1 + F.exp(-(4 * (best + 0.5 * lead) - 2)))}[method]
    return F.round(F.greatest(F.lit(0.2), F.least(F.lit(1.0), raw)), 4)


@query(f"""WITH h AS (SELECT b.vec_id AS question, {_DISTANCE} AS d FROM embeddings a JOIN embeddings b ON b.vec_id IN (3, 11, 42)), k AS (SELECT question, d, row_number() OVER (PARTITION BY question ORDER BY d) AS n FROM h), s AS (SELECT question, avg(d) AS mean, max(1 / (1 + d)) FILTER (WHERE n = 1) AS x, max(1 / (1 + d)) FILTER (WHERE n = 2) AS y FROM k WHERE n <= 15 GROUP BY question)
SELECT question, round(greatest(0.2, 1 - mean / 4), 2) AS vector, round(greatest(0.2, least(1, 0.6 * x + 0.4 * (x - y))), 4) AS linear, round(greatest(0.2, least(1, (x - y) / x)), 4) AS ratio, round(greatest(0.2, least(1, 1 / (1 + exp(-(4 * (x + 0.5 * (x - y)) - 2))))), 4) AS sigmoid FROM s""")
def search_confidences(spark, sf_dir, threshold: float = 4.0):
    """For each question: 1 less the mean distance over the threshold, and the confidences from the two best scores."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    score = 1 / (1 + F.col("distance"))
    best = nearest_of_each(items, _asked(spark, sf_dir, [3, 11, 42]), 15).groupBy("question").agg(F.avg("distance").alias("mean"), F.max(F.when(F.col("rank") == 1, score)).alias("x"), F.max(F.when(F.col("rank") == 2, score)).alias("y"))
    x, y = F.col("x"), F.col("y")
    return best.select("question", F.round(F.greatest(F.lit(0.2), 1 - F.col("mean") / threshold), 2).alias("vector"), *(confidence(x, y, m).alias(n) for n, m in (("linear", "linear_margin"), ("ratio", "normalized_ratio"), ("sigmoid", "sigmoid_margin"))))
