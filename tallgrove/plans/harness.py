"""Evaluation and comparison over a labelled test set, with reports as JSON."""
from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrove.operators import evaluation, records
from tallgrove.plans.index import Index

#: Metrics of an answer that are averaged where they are labelled.
ANSWER_METRICS = ("fact_coverage", "must_cite_recall", "citation_validity", "grounding", "abstain_rate", "llm_calls", "total_tokens", "precision", "recall", "ndcg", "resilience")


def retrieval(hits: DataFrame, relevant: DataFrame, key: str, k: int = 5) -> DataFrame:
    """A row a query (qid): precision, recall, f1, mrr, ndcg at k, and means and first values of similarity and rerank_score where the hits have them."""
    per = evaluation.per_query(hits, relevant, key, k)
    scores = [c for c in ("similarity", "rerank_score") if c in hits.columns]
    more = hits.groupBy("qid").agg(*(F.avg(c).alias(f"avg_{c}") for c in scores), *([F.first("latency_ms").alias("latency_ms")] if "latency_ms" in hits.columns else []), F.count(F.lit(1)).alias("num_results"))
    return per.join(more, "qid")


def test_set_report(per_query: DataFrame) -> DataFrame:
    """One row: number of queries, means of all metrics, 95th percentile of latency."""
    numbers = [c for c, t in per_query.dtypes if t == "double"]
    tail = [evaluation.percentile("latency_ms", 95).alias("p95_latency_ms")] if "latency_ms" in numbers else []
    return per_query.agg(F.count(F.lit(1)).alias("num_queries"), *(evaluation.nan_mean(c).alias(c if c.startswith("avg_") else f"avg_{c}") for c in numbers), *tail)


def scored(results: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """A row for each result (of any pipelines, in one frame): its answer metrics and, where relevant chunks are labelled, precision, recall and ndcg at k."""
    answers = records.scored_answers(results, labels).withColumn("abstain_rate", F.col("abstained").cast("double"))
    hits = results.select(F.concat_ws("\x01", "pipeline", "query").alias("qid"), F.posexplode(F.transform("chunks", lambda c: c["chunk_id"])).alias("pos", "chunk_id"))
    hits = hits.groupBy("qid", "chunk_id").agg(F.min("pos").alias("pos")).select("qid", "chunk_id", (F.col("pos") + 1).alias("rank"))
    wanted = results.join(labels.select("query", "relevant"), "query").select(F.concat_ws("\x01", "pipeline", "query").alias("qid"), F.explode("relevant").alias("chunk_id"))
    per = evaluation.per_query(hits.join(wanted.select("qid").distinct(), "qid", "left_semi"), wanted, "chunk_id", k).select("qid", "precision", "recall", "ndcg")
    return answers.withColumn("qid", F.concat_ws("\x01", "pipeline", "query")).join(per, "qid", "left").drop("qid")


def scorecard(rows: DataFrame) -> DataFrame:
    """A row a pipeline: number of queries, means of the labelled metrics, mean, median and 95th percentile of latency."""
    card = evaluation.scorecard(rows, list(ANSWER_METRICS))
    return rows.groupBy("pipeline").agg(F.count(F.lit(1)).alias("num_queries")).join(card, "pipeline")


def compare(results: DataFrame, labels: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(scorecard a pipeline, metrics a query and pipeline)."""
    rows = scored(results, labels, k)
    return scorecard(rows), rows


def _timed(run: Callable[[], list]) -> tuple[float, list]:
    """(milliseconds, rows)."""
    start = time.perf_counter()
    rows = run()
    return 1000 * (time.perf_counter() - start), rows


def speed(index: Index, n: int = 100, top_k: int = 5, chars: int = 100) -> DataFrame:
    """One row: the latency distribution of single searches with the first ``chars`` characters of ``n`` sampled chunks, and the rate of repeats that a cache answered.

    As there is no other sign of it, a repeat counts as answered by a cache if it takes less than a tenth of the first search. This times searches; it says nothing of their quality.
    """
    spark = index.spark
    texts = [r.q for r in records.sampled(index.table("chunks"), "chunk_id", n).select(F.substring("text", 1, chars).alias("q")).collect()]  # n rows
    rows = []
    for text in texts:
        q = spark.createDataFrame([(0, text)], "qid long, text string")
        first, _ = _timed(lambda q=q: index.search(q, top_k).collect())
        again, _ = _timed(lambda q=q: index.search(q, top_k).collect())
        rows.append((first, again < first / 10))
    took = spark.createDataFrame(rows, "latency_ms double, cached boolean")
    return took.agg(F.count(F.lit(1)).alias("num_queries"), *evaluation.distribution("latency_ms"), F.coalesce(F.avg(F.col("cached").cast("int")), F.lit(0.0)).alias("cache_hit_rate"))


def compare_configurations(index: Index, query: str, configurations: dict[str, dict], runs: int = 10, top_k: int = 5) -> DataFrame:
    """A row a configuration (arguments of ``Index.search``): mean latency of ``runs`` searches with one query, and the first hit's similarity and re-ranker's score (0 without)."""
    q, rows = index.spark.createDataFrame([(0, query)], "qid long, text string"), []
    for name, arguments in configurations.items():
        timed = [_timed(lambda a=arguments: index.search(q, top_k, **a).where("rank = 1").collect()) for _ in range(runs)]
        first = timed[-1][1][0].asDict() if timed[-1][1] else {}
        rows.append((name, sum(t for t, _ in timed) / len(timed), float(first.get("similarity") or 0), float(first.get("rerank_score") or 0)))
    return index.spark.createDataFrame(rows, "configuration string, avg_latency_ms double, top_similarity double, top_rerank_score double")


def write_report(path: str, stamp: str, **parts: DataFrame) -> None:
    """Each part as JSON lines in ``path/stamp/part``; a report that is there already is an error."""
    for name, df in parts.items():
        df.withColumn("timestamp", F.lit(stamp)).write.mode("errorifexists").json(f"{path.rstrip('/')}/{stamp}/{name}")
