"""Row shapes: index metadata, retrieved chunks, responses, prompts, scored answers; look-ups; the query log's tables."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrove.functions import text as T
from tallgrove.operators import evaluation, rollups

LONGEST_QUERY, MOST_RESULTS, MOST_DAYS, LONGEST_COMMENT = 2000, 100, 365, 1000


def checked_query(query: str, top_k: int = 5) -> tuple[str, int]:
    """A stripped query of 1 to 2000 characters and a top_k of 1 to 100, or ValueError."""
    query = query.strip()
    if not 0 < len(query) <= LONGEST_QUERY:
        raise ValueError(f"a query has 1 to {LONGEST_QUERY} characters")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MOST_RESULTS:
        raise ValueError(f"top_k is 1 to {MOST_RESULTS}")
    return query, top_k


def clamped_days(days: int) -> int:
    return max(1, min(MOST_DAYS, days))


def metadata(chunks: DataFrame) -> DataFrame:
    """Chunk rows as the index keeps them: offsets dropped, summary and questions never null."""
    none = F.array().cast("array<string>")
    given = set(chunks.columns)
    summary = F.coalesce("summary", F.lit("")) if "summary" in given else F.lit("")
    questions = F.coalesce("questions", none) if "questions" in given else none
    return chunks.select("chunk_id", "doc_name", "page", "section", "text", summary.alias("summary"), questions.alias("questions"))


def retrieved(results: DataFrame, source_query: Column) -> DataFrame:
    """Results as retrieved chunks: missing numbers are 0, missing texts empty; the re-ranker's score is not kept."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("chunk_id", "doc_name", "page", "section", "text")]
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("score", "similarity")]
    return results.select("qid", *text, *numbers, F.coalesce(source_query, F.lit("")).alias("source_query"))


def response(chunks: DataFrame, order: list[Column]) -> DataFrame:
    """Retrieved chunks as response rows; the rank is the place in ``order``."""
    w = Window.partitionBy("qid").orderBy(*order)
    return chunks.select("qid", F.row_number().over(w).alias("rank"), "similarity", "score", "chunk_id", "doc_name", "page", "section", "text")


def wire(results: DataFrame) -> DataFrame:
    """(qid, json): a pipeline result as it is sent; latencies with two decimals, chunks by id only, traces of the stages if there are any."""

    def trace(s: Column) -> Column:
        tokens = (s["usage"]["prompt_tokens"] + s["usage"]["completion_tokens"]).alias("total_tokens")
        calls = [s["usage"]["calls"].alias("llm_calls"), s["usage"]["prompt_tokens"].alias("prompt_tokens"), s["usage"]["completion_tokens"].alias("completion_tokens")]
        return F.struct(s["name"].alias("name"), F.round(s["latency_ms"], 2).alias("latency_ms"), *calls, tokens)

    stages = [F.transform("stages", trace).alias("stages")] if "stages" in results.columns else []
    body = F.struct(
        "query", "pipeline", "answer", "confidence", "citations", F.transform("chunks", lambda c: c["chunk_id"]).alias("retrieved_chunks"), *stages,
        F.round("total_latency_ms", 2).alias("total_latency_ms"), F.col("usage.calls").alias("total_llm_calls"),
        (F.col("usage.prompt_tokens") + F.col("usage.completion_tokens")).alias("total_tokens"),
    )
    return results.select("qid", F.to_json(body).alias("json"))


def prompt_contexts(hits: DataFrame, most: int = 5) -> DataFrame:
    """(qid, context): the first ``most`` results as source blocks without ids, by rank."""
    block = T.source_block(F.col("doc_name"), F.col("page"), F.col("section"), F.lit(""), F.col("text"), with_id=False)
    top = hits.where(F.col("rank") <= most).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return top.select("qid", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("context"))


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id).orderBy("ord").limit(1)


def section_chunks(chunks: DataFrame, doc: str, section: str) -> DataFrame:
    return chunks.where((F.col("doc_name") == doc) & (F.col("section") == section)).orderBy("ord")


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and documents, and the documents' sorted names."""
    return chunks.agg(F.count(F.lit(1)).alias("num_chunks"), F.count_distinct("doc_name").alias("num_docs"), F.array_sort(F.collect_set("doc_name")).alias("docs"))


def all_sections(chunks: DataFrame) -> DataFrame:
    """(doc_name, section, pos): different sections of each document that are not empty, numbered as first seen."""
    own = chunks.where(F.coalesce("section", F.lit("")) != "").groupBy("doc_name", "section").agg(F.min("ord").alias("__first"))
    return own.select("doc_name", "section", F.row_number().over(Window.partitionBy("doc_name").orderBy("__first")).alias("pos"))


def sampled(chunks: DataFrame, key: str, n: int, seed: str = ":1") -> DataFrame:
    """n rows drawn by a hash of their key, the same ones each time; adds the hash as ``digest``."""
    return chunks.withColumn("digest", F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))).orderBy("digest").limit(n)


def document_sections(chunks: DataFrame, doc: str) -> DataFrame:
    """Different sections of a document that are not empty, first seen first."""
    return all_sections(chunks.where(F.col("doc_name") == doc)).orderBy("pos").select("section")


def scored_answers(results: DataFrame, labels: DataFrame) -> DataFrame:
    """All answer metrics of results (query, answer, confidence, citations, chunks, usage, total_latency_ms) with their labels.

    Metrics without a label are null; ``resilience`` only where the query is out of scope.
    """
    none = F.array().cast("array<string>")
    d = results.join(labels.select("query", "expected_facts", "must_cite", "out_of_scope"), "query", "left")
    source = F.array_join(F.transform("chunks", lambda c: c["text"]), " ")
    cited_docs = F.array_distinct(F.transform("citations", lambda c: c["doc_name"]))
    cited = F.transform("citations", lambda c: c["chunk_id"])
    d, gone = d.withColumn("__gone", T.abstained(F.col("answer"))), F.col("__gone")
    return d.select(
        "query", "pipeline", T.fact_coverage(F.col("answer"), F.coalesce("expected_facts", none)).alias("fact_coverage"),
        T.must_cite_recall(cited_docs, F.coalesce("must_cite", none)).alias("must_cite_recall"),
        T.citation_validity(cited, F.transform("chunks", lambda c: c["chunk_id"])).alias("citation_validity"),
        T.grounding(F.col("answer"), source).alias("grounding"), gone.alias("abstained"), F.length(F.coalesce("answer", F.lit(""))).alias("answer_chars"),
        F.col("usage.calls").alias("llm_calls"), (F.col("usage.prompt_tokens") + F.col("usage.completion_tokens")).alias("total_tokens"),
        F.col("total_latency_ms").alias("latency_ms"), "confidence", F.when(F.coalesce("out_of_scope", F.lit(False)), gone.cast("double")).alias("resilience"),
    )


class QueryLog:
    """The append-only tables ``queries``, a partition a day, and ``feedback`` below a folder, and ``daily``: sums of the days that were rolled up.

    Statistics read the sums of rolled-up days and the rows of the others, of the days of their window only. A day that gets rows after it was rolled up is rolled up
    again by the same call (should that die in between, ``roll_up`` of the day mends it).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def log_queries(self, queries: DataFrame, results: DataFrame) -> None:
        """Appends a row for each of (qid, query, timestamp, top_k, latency_ms, cache_hit, use_rerank, generate_answer) with its results' figures; the id is a UUID."""
        rows = queries.join(evaluation.log_rows(results), "qid", "left").withColumn("num_results", F.coalesce("num_results", F.lit(0)).cast("long"))
        rows.withColumn("id", F.expr("uuid()")).withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(f"{self.path}/queries")
        late = [r.day for r in queries.select(F.to_date("timestamp").alias("day")).distinct().join(self.rolled_up(), "day").collect()]
        if late:
            self.roll_up(late)

    def rolled_up(self) -> DataFrame:
        """(day): the days that have sums."""
        return self._daily().select("day").distinct()

    def _daily(self) -> DataFrame:
        kind = ", ".join(f"sum_{c} double, count_{c} long" for c in rollups.AVERAGED)
        try:
            return self.spark.read.schema(f"query string, n long, cache_hits long, {kind}, day date").parquet(f"{self.path}/daily")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"query string, n long, cache_hits long, {kind}, day date")

    def roll_up(self, days: list) -> None:
        """Writes the sums of some days in place of those they had."""
        rows = rollups.daily(self.table("queries").where(F.col("day").isin([str(d) for d in days])))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/daily")

    def days(self, since: Column | None = None) -> DataFrame:
        """Daily sums from a date on: those that are there, and those of the other days from their rows."""
        recent = lambda d: d if since is None else d.where(F.col("day") >= since)
        sums = recent(self._daily())
        known = [r.day for r in recent(self.rolled_up()).collect()]
        rows = recent(self.table("queries"))
        rows = rows.where(~F.col("day").isin([str(d) for d in known]) | F.col("day").isNull()) if known else rows
        return sums.unionByName(rollups.daily(rows))

    def query_stats(self, today: str, window: int) -> DataFrame:
        return rollups.query_stats(self.days(F.date_sub(F.lit(today).cast("date"), window)), today, window)

    def top_queries(self, limit: int = 10) -> DataFrame:
        return rollups.top_queries(self.days(), limit)

    def log_feedback(self, feedback: DataFrame) -> None:
        """Appends (query_id, timestamp, rating, relevant_results, comments); ratings are 1 to 5, comments are cut at 1000 characters."""
        wrong = F.raise_error(F.lit("a rating is 1 to 5"))
        rating = F.when(F.col("rating").between(1, 5), F.col("rating")).otherwise(wrong)
        rows = feedback.withColumn("rating", rating).withColumn("comments", F.substring("comments", 1, LONGEST_COMMENT)).withColumn("id", F.expr("uuid()"))
        rows.write.mode("append").parquet(f"{self.path}/feedback")

    def exported(self, today: str, now: str) -> DataFrame:
        """One row with the statistics of 7 and 30 days, the 20 top queries and the feedback, as nested columns (write it as JSON)."""
        one = lambda d, name: d.select(F.struct("*").alias(name))
        top = self.top_queries(20).agg(F.collect_list(F.struct("*")).alias("top_queries"))
        out = one(self.query_stats(today, 7), "query_stats_7d").crossJoin(one(self.query_stats(today, 30), "query_stats_30d"))
        return out.crossJoin(top).crossJoin(one(evaluation.feedback_stats(self.table("feedback")), "feedback_stats")).withColumn("export_timestamp", F.lit(now))
