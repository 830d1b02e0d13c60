"""Exact vector search, fusion of several queries, and profile scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import distance


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest rows to one vector by Euclidean distance: a scan and a bounded top-k, no full sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.withColumn("distance", F.round(distance(F.col("embedding"), q), 6)).orderBy("distance", "vec_id").limit(k)


def fused(hits: DataFrame, threshold: float) -> DataFrame:
    """One row for each item of several queries' hits: the least length-adjusted distance under a threshold."""
    adjusted = F.col("distance") * (1 + 0.1 * (1 - F.least(F.col("n_chars") / 500, F.lit(1.0))))
    return hits.withColumn("adjusted", F.round(adjusted, 6)).where(F.col("adjusted") < threshold).groupBy("item").agg(F.min("adjusted").alias("distance"), F.count("*").alias("n_queries"))


def profile_score(d: Column, rerank: Column, weight_vector: float, weight_rerank: float, reach: float = 15.0) -> Column:
    """Weighted mean of closeness and rerank score; the weights are brought to a sum of 1."""
    whole = weight_vector + weight_rerank
    return F.round((1 - F.least(d / reach, F.lit(1.0))) * (weight_vector / whole) + rerank * (weight_rerank / whole), 6)


def margin(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Best score of each group, its lead over the second, and a confidence from both (0.2 to 1)."""
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score)))).where("_n <= 2").groupBy(group).agg(F.max(score).alias("best"), F.max(F.when(F.col("_n") == 2, F.col(score))).alias("second"))
    lead = F.col("best") - F.coalesce("second", F.lit(0.0))
    return best.select(group, F.round("best", 6).alias("best"), F.round(lead, 6).alias("margin"), F.round(F.greatest(F.lit(0.2), 1 / (1 + F.exp(-(4 * (F.col("best") + 0.5 * lead) - 2)))), 4).alias("confidence"))
