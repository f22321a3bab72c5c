"""The staged pipeline: plan, retrieve with a coverage gate, assemble, answer, verify; all queries of a batch at once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrove.functions import models
from tallgrove.functions import text as T
from tallgrove.operators import context, records, search
from tallgrove.plans.index import Index, checked_answers
from tallgrove.plans.replies import Replies
from tallgrove.sources.store import kept

Model = Callable[[Column], Column]

REFORMULATE = 'The chunks found for the sub-query are not enough. Write one other search query for it. Return JSON: {"reformulated_query": "..."}'
#: Chunks, and characters of each, that a reformulation is shown; how weak coverage is noted.
SHOWN, SNIPPET = 5, 240
WEAK, PARTIAL = "Weak coverage (sim=%.2f) for: %s", "Partial coverage for: %s"


def sub_queries(queries: DataFrame, planner: Model, most: int = 5) -> DataFrame:
    """(qid, sub, text) from a planner's JSON replies; the query itself where there is no usable plan."""
    planned = queries.select("qid", T.planned(T.llm_json(planner(F.col("text"))), F.col("text"), most).alias("p"))
    return planned.select("qid", F.posexplode("p.sub_queries").alias("sub", "s")).select("qid", "sub", F.col("s.text").alias("text"))


def _reformulated(replies: Replies, weak: DataFrame, hits: DataFrame, call: models.Call) -> DataFrame:
    """``weak`` (key, qid, sub, text, ...) with the completion ``asked`` and the query ``next`` that it holds, empty if none is usable."""
    line = F.concat(F.lit("- ("), F.col("doc_name").cast("string"), F.lit(" p"), F.col("page").cast("string"), F.lit(") "), F.substring("text", 1, SNIPPET))
    shown = hits.where(F.col("rank") <= SHOWN).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("__l"))
    rows = weak.join(shown, "key", "left")
    snippets = F.coalesce(F.array_join(F.transform("__l", lambda x: x["l"]), "\n"), F.lit(""))
    prompt = F.concat(F.lit("Sub-query: "), "text", F.lit("\n\nRetrieved snippets:\n"), snippets, F.lit("\n\nReformulation JSON:"))
    rows = replies.ask(rows, call, REFORMULATE, prompt, "asked", by="key").drop("__l")
    said = F.try_variant_get(F.try_parse_json(T.llm_json(F.col("asked.text"))), "$.reformulated_query", "string")
    return kept(rows.withColumn("next", T.strip(F.coalesce(said, F.lit("")))))


def retrieve(
    index: Index, subs: DataFrame, top_k: int = 5, passes: int = 1, reformulate: models.Call | None = None, gate: float = 0.45,
    rerank: Callable[[Column, Column], Column] | None = None, replies: Replies | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(hits, coverage): merged hits by qid with the query that found them; by sub-query its passes, whether the last one reached the gate, a note, and what reformulating cost.

    With ``reformulate``, sub-queries below the gate are searched again with a query that the model makes of the sub-query itself and of
    snippets of what was found, up to ``passes`` times. A pass searches the sub-queries that are still open, a written table, once; it ends the loop if none is left.
    """
    replies = replies or Replies(index.spark)
    open_ = kept(subs.select(F.concat_ws(":", F.col("qid"), F.col("sub")).alias("key"), "qid", "sub", "text", F.col("text").alias("searched")))
    none = F.struct(*(F.lit(0).cast("double" if f == "latency_ms" else "long").alias(f) for f in ("calls", "prompt_tokens", "completion_tokens", "latency_ms")))
    found, coverage = None, None
    for i in range(max(1, passes)):
        hits = kept(index.search(open_.select(F.col("key").alias("qid"), F.col("searched").alias("text")), top_k, rerank).withColumnRenamed("qid", "key"))
        own = hits.join(open_.select("key", "qid", "sub", F.col("searched").alias("source_query")), "key").withColumn("sub", F.col("sub") * 100 + i)
        found = own if found is None else found.unionByName(own)
        best = search.covered(hits.withColumnRenamed("key", "qid"), gate).withColumnRenamed("qid", "key")
        state = open_.join(best, "key", "left").withColumn("covered", F.coalesce("covered", F.lit(False))).withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("pass", F.lit(i))
        state = state.withColumn("cost", none)
        last = reformulate is None or i == passes - 1
        if not last:
            weak = _reformulated(replies, state.where(~F.col("covered")).drop("cost"), hits, reformulate)
            cost = F.struct(*(F.col("asked")[f].alias(f) for f in ("calls", "prompt_tokens", "completion_tokens", "latency_ms")))
            state = state.where(F.col("covered")).unionByName(weak.withColumn("cost", cost).select(state.columns))
        state = kept(state)
        coverage = state if coverage is None else coverage.unionByName(state)
        if last:
            break
        open_ = kept(weak.where("next <> ''").select("key", "qid", "sub", "text", F.col("next").alias("searched")))
        if open_.isEmpty():
            break
    add = lambda f: F.sum(F.col("cost")[f]).alias(f)
    note = F.format_string(WEAK, "best", "text") if reformulate is None else F.when(F.col("passes") == passes, F.format_string(PARTIAL, "text"))
    ends = coverage.groupBy("qid", "sub", "text").agg(
        F.max_by("covered", "pass").alias("covered"), F.max_by("best", "pass").alias("best"), F.count(F.lit(1)).alias("passes"),
        F.struct(*map(add, ("calls", "prompt_tokens", "completion_tokens", "latency_ms"))).alias("cost"),
    )
    ends = ends.withColumn("note", F.when(~F.col("covered"), note)).drop("text")
    return search.merged(found.drop("key"), "chunk_id"), ends


def notes(coverage: DataFrame) -> DataFrame:
    """(qid, notes): notes of weak sub-queries in order."""
    own = F.sort_array(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("sub", "note"))))
    return coverage.groupBy("qid").agg(F.array_join(F.transform(own, lambda x: x["note"]), "; ").alias("notes"))


def blocks(index: Index, hits: DataFrame) -> DataFrame:
    """(qid, context, chunks): the context of hits and of the sections that they refer to, and the chunks in it in order; nothing else is cited or checked."""
    own = records.retrieved(hits, F.col("source_query")).join(hits.select("qid", "chunk_id", "rank"), ["qid", "chunk_id"])
    full = context.with_referenced(own, index.table("chunks"))
    full = full.withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    placed = context.ordered(full)
    block = T.source_block(F.col("doc_name"), F.col("page"), F.col("section"), F.col("chunk_id"), F.col("text"))
    one = F.struct("place", block.alias("b"), F.struct("chunk_id", "doc_name", "page", "section", "text", "score", "similarity", "source_query").alias("c"))
    rows = placed.groupBy("qid").agg(F.sort_array(F.collect_list(one)).alias("__bs"))
    return kept(rows.select("qid", F.array_join(F.transform("__bs", lambda x: x["b"]), "\n\n").alias("context"), F.transform("__bs", lambda x: x["c"]).alias("chunks")))


def answered(index: Index, queries: DataFrame, planner: Model, llm: Model, top_k: int = 5, passes: int = 1, reformulate: models.Call | None = None, verifier: Model | None = None) -> DataFrame:
    """(qid, query, context, answer, citations, notes, mismatches, confidence) of every query (qid, text), with models as Columns; confidence as in ``Index.answer``."""
    hits, coverage = retrieve(index, sub_queries(queries, planner), top_k, passes, reformulate)
    own = blocks(index, hits)
    a = own.join(queries.select("qid", F.col("text").alias("query")), "qid")
    a = kept(a.withColumn("answer", llm(F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "query"))))
    a = a.withColumn("citations", context.cited(F.col("answer"), F.col("chunks"))).join(notes(coverage), "qid", "left")
    full = own.select("qid", F.inline("chunks"))
    a = checked_answers(a, full, verifier)
    return a.select("qid", "query", "context", "answer", "citations", F.coalesce("notes", F.lit("")).alias("notes"), "mismatches", "confidence")
