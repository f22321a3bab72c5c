"""Retrieval metrics, answer metrics and query-log statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(hits: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    """(qid, precision, recall, f1, mrr, ndcg) from hits (qid, rank, key) and different relevant (qid, key)."""
    rel = relevant.distinct().withColumn("hit", F.lit(1))
    size = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("n_rel"))
    return per_query_hits(hits.join(rel, ["qid", key], "left").withColumn("hit", F.coalesce("hit", F.lit(0))), size, k)


def per_query_hits(hits: DataFrame, size: DataFrame, k: int) -> DataFrame:
    """The same from hits (qid, rank, hit = 1 if relevant) and the number of relevant rows (qid, n_rel), where those need not be listed."""
    top = F.col("rank") <= k
    g = hits.groupBy("qid").agg(
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("found"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top & (F.col("hit") == 1), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    g = g.join(size, "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    p, r = F.col("found") / F.lit(k), F.coalesce(F.try_divide("found", "n_rel"), F.lit(0.0))
    ideal = F.aggregate(F.expr(f"sequence(1, greatest(1, cast(least(n_rel, {k}) as int)))"), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return g.select(
        "qid", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def nan_mean(c: str) -> Column:
    """Mean of the labelled values: NaN and null are left out."""
    return F.avg(F.nullif(F.col(c), F.lit(float("nan"))))


def percentile(c: str, p: float) -> Column:
    """Linear interpolation; 0 for no values."""
    return F.coalesce(F.percentile(c, p / 100), F.lit(0.0))


def distribution(c: str) -> list[Column]:
    return [F.avg(c).alias("mean"), F.median(c).alias("median"), percentile(c, 95).alias("p95"), percentile(c, 99).alias("p99"), F.min(c).alias("min"), F.max(c).alias("max")]


def window_of(ts: str, today: str, days: int) -> Column:
    """Dates from ``days`` before today on, today's and that day's both included."""
    return F.to_date(ts) >= F.date_sub(F.lit(today).cast("date"), days)


def query_stats(log: DataFrame, today: str, days: int) -> DataFrame:
    """One row: totals, averages and the cache hit rate of the window; 0 where there is nothing."""
    d = log.where(window_of("timestamp", today, days))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hits = F.coalesce(F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)), F.lit(0))
    return d.agg(
        F.count(F.lit(1)).alias("total_queries"), zero(F.avg("latency_ms")).alias("avg_latency_ms"), zero(F.avg("num_results")).alias("avg_results"),
        zero(F.avg("avg_similarity")).alias("avg_similarity"), zero(F.avg("avg_rerank_score")).alias("avg_rerank_score"),
        hits.cast("long").alias("cache_hits"), F.count_distinct("query").alias("unique_queries"), zero(F.try_divide(hits, F.count(F.lit(1)))).alias("cache_hit_rate"),
    )


def top_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    g = log.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency_ms"), F.avg("avg_similarity").alias("avg_similarity"))
    return g.orderBy(F.desc("n"), "query").limit(limit)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    good, bad = (F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long") for c in (F.col("rating") >= 4, F.col("rating") <= 2))
    return feedback.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"), good.alias("positive"), bad.alias("negative"), F.coalesce(F.try_divide(good, F.count(F.lit(1))), F.lit(0.0)).alias("satisfaction"))


def log_rows(results: DataFrame) -> DataFrame:
    """(qid, num_results, avg_similarity, top_similarity, avg_rerank_score, top_rerank_score) of result rows (qid, rank, similarity, rerank_score)."""
    return results.groupBy("qid").agg(
        F.count(F.lit(1)).alias("num_results"), F.avg("similarity").alias("avg_similarity"), F.max_by("similarity", -F.col("rank")).alias("top_similarity"),
        F.avg("rerank_score").alias("avg_rerank_score"), F.max_by("rerank_score", -F.col("rank")).alias("top_rerank_score"),
    )


def scorecard(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Per pipeline: means of the labelled metrics, mean, median and 95th percentile of latency_ms."""
    return rows.groupBy("pipeline").agg(*(nan_mean(m).alias(m) for m in metrics), F.avg("latency_ms").alias("avg_latency_ms"), percentile("latency_ms", 50).alias("p50_latency_ms"), percentile("latency_ms", 95).alias("p95_latency_ms"))


def supported_ratio(checks: DataFrame, by: str) -> DataFrame:
    return checks.groupBy(by).agg(F.coalesce(F.avg(F.col("supported").cast("int")), F.lit(0.0)).alias("ratio"))
