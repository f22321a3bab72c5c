"""Two pipelines over one index with one result shape: single-shot (traditional) and staged with verification (agentic).

A result is (qid, query, answer, pipeline, confidence, citations, chunks, stages, total_latency_ms, usage), a row a query; all
queries of a batch are handled at once. Each stage's replies are written before the next stage reads them (``replies``), so each model is called once for each different
prompt, however often the result is read. Latencies are those of the model calls: retrieval is shared by the batch.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrove.functions import models
from tallgrove.operators import context, records, verification
from tallgrove.plans import agent
from tallgrove.plans.index import Index
from tallgrove.plans.replies import Replies
from tallgrove.sources.store import kept

ANSWER, PLAN, VERIFY = (
    "Answer from the context only. Cite sources as footnotes.",
    "Split the question into sub-queries. Return JSON.",
    "Check every claim of the answer against the sources. Return JSON.",
)
#: Fixed value: the reply where nothing was found.
NOTHING = "I could not find information about this in the indexed documents."
CHUNK = ("chunk_id", "doc_name", "page", "section", "text", "score", "similarity", "source_query")


def _question(context_text: Column, query: Column) -> Column:
    return F.concat(F.lit("Context:\n"), F.coalesce(context_text, F.lit("")), F.lit("\n\nQuestion: "), query)


def _chunks_of(hits: DataFrame) -> DataFrame:
    """(qid, chunks): the retrieved chunks of a query in order of rank."""
    one = F.struct("rank", F.struct(*CHUNK).alias("c"))
    return hits.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"]).alias("chunks"))


def _stage(name: str, completion: str | None) -> Column:
    c = F.col(completion) if completion else None
    none = F.lit(0).cast("long")
    use = models.usage(c) if completion else F.struct(none.alias("calls"), none.alias("prompt_tokens"), none.alias("completion_tokens"))
    return F.struct(F.lit(name).alias("name"), (F.coalesce(c["latency_ms"], F.lit(0.0)) if completion else F.lit(0.0)).alias("latency_ms"), use.alias("usage"))


def _result(rows: DataFrame, pipeline: str, confidence: Column, stages: list[tuple[str, str | None]]) -> DataFrame:
    used = [c for _, c in stages if c]
    latency = sum((F.coalesce(F.col(c)["latency_ms"], F.lit(0.0)) for c in used), F.lit(0.0))
    return rows.select(
        "qid", "query", F.coalesce("answer", F.lit("")).alias("answer"), F.lit(pipeline).alias("pipeline"), confidence.alias("confidence"),
        "citations", F.coalesce("chunks", F.array().cast(rows.schema["chunks"].dataType)).alias("chunks"),
        F.array(*(_stage(n, c) for n, c in stages)).alias("stages"), latency.alias("total_latency_ms"), models.usage(*(F.col(c) for c in used)).alias("usage"),
    )


def _free(text: str) -> Column:
    """A completion that no model was asked for."""
    none = lambda kind: F.lit(0).cast(kind)
    return F.struct(F.lit(text).alias("text"), none("long").alias("calls"), none("long").alias("prompt_tokens"), none("long").alias("completion_tokens"), none("double").alias("latency_ms"))


def traditional(
    index: Index, queries: DataFrame, call: models.Call | None, top_k: int = 5, rerank: Callable[[Column, Column], Column] | None = None,
    hyde: Callable[[Column], Column] | None = None, replies: Replies | None = None,
) -> DataFrame:
    """One search, one answer; citations by document and page; confidence is not judged (n/a)."""
    replies = replies or Replies(index.spark)
    hits = kept(index.search(queries, top_k, rerank, hyde))
    own = records.retrieved(hits.join(queries.select("qid", F.col("text").alias("__q")), "qid"), F.col("__q"))
    own = own.join(hits.select("qid", F.col("chunk_id"), "rank"), ["qid", "chunk_id"])
    blocks = records.prompt_contexts(hits, top_k)
    a = queries.select("qid", F.col("text").alias("query")).join(blocks, "qid", "left").join(_chunks_of(own), "qid", "left")
    a = replies.ask(a, call, ANSWER, _question(F.col("context"), F.col("query")), "__answer")
    # an answer is one call, even if it failed
    a = a.withColumn("__answer", F.col("__answer").withField("calls", F.when(models.failed(F.col("__answer.text")), F.lit(1).cast("long")).otherwise(F.col("__answer.calls")))).withColumn("answer", F.col("__answer.text"))
    a = a.withColumn("citations", context.plain_cited(F.col("answer"), F.col("chunks")))
    return _result(a, "traditional", F.lit("n/a"), [("retrieval", None), ("answer", "__answer")])


def agentic(
    index: Index, queries: DataFrame, call: models.Call | None, top_k: int = 5, passes: int = 3, verify: bool = True, reformulate: models.Call | None = None,
    verifier: models.Call | None = None, planner: models.Call | None = None, rerank: Callable[[Column, Column], Column] | None = None, replies: Replies | None = None,
) -> DataFrame:
    """Plan, retrieve with a coverage gate, assemble, answer, verify. ``planner`` and ``verifier`` default to ``call``.

    Citations, the verifier and the result see the chunks of the assembled context, those of referenced sections too. A query without context gets the fixed
    reply ``NOTHING`` without a call, at low confidence. Models named differently share no replies.
    """
    replies = replies or Replies(index.spark)
    planned = replies.ask(queries.select("qid", F.col("text").alias("query")), planner or call, PLAN, F.col("query"), "__plan", model="planner")
    subs = agent.sub_queries(planned.select("qid", F.col("query").alias("text"), "__plan"), lambda _: F.col("__plan.text"))
    hits, coverage = agent.retrieve(index, subs, top_k, passes, reformulate, rerank=rerank, replies=replies)
    add = lambda f: F.sum(F.col("cost")[f]).alias(f)
    cost = coverage.groupBy("qid").agg(F.struct(*map(add, ("calls", "prompt_tokens", "completion_tokens", "latency_ms"))).alias("__retrieval"))
    a = planned.join(agent.blocks(index, hits), "qid", "left").join(cost, "qid", "left")
    some = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    a = replies.ask(a, call, ANSWER, _question(F.col("context"), F.col("query")), "__answer", when=some, model="answerer")
    a = a.withColumn("__answer", F.coalesce("__answer", _free(NOTHING))).withColumn("answer", F.col("__answer.text"))
    a = a.withColumn("citations", context.cited(F.col("answer"), F.col("chunks")))
    stages: list[tuple[str, str | None]] = [("planner", "__plan"), ("retriever", "__retrieval"), ("assembler", None), ("answerer", "__answer")]
    if not verify:
        return _result(a, "agentic", F.lit("n/a"), stages)
    a = replies.ask(a, verifier or call, VERIFY, verification.prompt(F.col("answer"), F.col("chunks")), "__check", when=some & (F.col("answer") != ""), model="verifier")
    a = a.withColumn("__v", verification.verified(F.col("answer"), F.col("chunks"), F.col("__check.text"))).withColumn("answer", F.col("__v.verified_answer"))
    return _result(kept(a), "agentic", F.col("__v.confidence"), [*stages, ("verifier", "__check")])


PIPELINES = {"traditional": traditional, "agentic": agentic}


def build(kind: str) -> Callable:
    """The pipeline of a name, whatever its case; ValueError for others."""
    name = (kind or "").strip().lower()
    if name not in PIPELINES:
        raise ValueError(f"unknown pipeline {kind!r}; there are {', '.join(PIPELINES)}")
    return PIPELINES[name]
