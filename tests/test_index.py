"""The versioned index, its postings, replies that are stored, and the staged pipeline over its own context."""
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tallgrove.operators import context, postings, search
from tallgrove.plans import agent, pipelines
from tallgrove.plans.index import Index, hashed_embed
from tallgrove.plans.replies import Replies
from tallgrove.sources import store

PAGE = "doc_name string, page int, text string"


def pages_of(spark, n, start=0, word="alpha"):
    return spark.createDataFrame([(f"d{i:03d}", 1, f"The {word} number {i} runs at {i % 7} bar. Pump{i % 5} and valve{i % 3}.") for i in range(start, n)], PAGE)


def queries_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def seen(spark, names, size=1):
    return spark.createDataFrame([(n, size) for n in names], "name string, size long").select("name", F.timestamp_seconds(F.lit(0)).alias("mtime"), "size")


def same_as_rebuilt(spark, index, q, k=4):
    """The index's lexical hits, which are those of a scan over its texts."""
    got = {(r.qid, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in index.lexical(q, k).collect()}
    want = {(r.qid, r["rank"]): (r.chunk_id, round(r.score, 9)) for r in search.bm25(index.table("chunks").select("chunk_id", "text"), q, "chunk_id", k).collect()}
    assert got == want and got
    return got


def test_versions(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=8)
    q = queries_of(spark, "alpha number 3", "pump1 the valve2", "new word", "nothing of it")
    index.build(pages_of(spark, 20))
    before = same_as_rebuilt(spark, index, q)
    index.build(pages_of(spark, 25), mode="append")
    assert index.store.versions() == [1, 2] and index.stats().first().num_chunks == 25 and same_as_rebuilt(spark, index, q) != before
    assert spark.read.parquet(f"{index.path}/{index.store.entry()['segments'][1]['path']}/chunks").count() == 5
    index.build(pages_of(spark, 25), mode="append")  # again: nothing is added, nothing is committed
    assert index.store.versions() == [1, 2] and index.table("vectors").count() == 25
    assert len({(r.qid, r.chunk_id) for r in index.search(q, 3).collect()}) == index.search(q, 3).count() == 12
    assert index.table("chunks", version=1).count() == 20
    with pytest.raises(ValueError):
        index.table("chunks", version=9)


def test_a_run_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=4)
    index.build(pages_of(spark, 5))
    for name in ("write_postings", "write_statistics"):
        with monkeypatch.context() as m:
            m.setattr(postings, name, lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                index.build(pages_of(spark, 9), mode="append")
        assert index.store.versions() == [1] and index.stats().first().num_chunks == 5 and index.table("vectors").count() == 5
    with monkeypatch.context() as m:
        m.setattr(store.Store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            index.update(pages_of(spark, 9), seen(spark, ["d001"]))
    index.build(pages_of(spark, 9), mode="append")
    assert index.stats().first().num_chunks == 9 and len(index.store.vacuum()) == 4 and index.stats().first().num_chunks == 9
    same_as_rebuilt(spark, index, queries_of(spark, "alpha pump3"))


def test_of_two_writers_one_fails(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.entry() == {"version": 0} and s.commit({"a": 1}, 0) == 1
    with pytest.raises(store.Conflict):
        s.commit({"a": 2}, 0)
    assert s.entry()["a"] == 1 and s.commit({"a": 3}, 1) == 2 and s.versions() == [1, 2] and not [f for f in os.listdir(tmp_path / "s/_log") if not f.lstrip(".").startswith("000")]


def test_update_writes_the_changed_documents_only(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=8)
    names = [f"d{i:03d}" for i in range(40)]
    assert index.update(pages_of(spark, 40), seen(spark, names)) == "built"
    changed = pages_of(spark, 40).where("doc_name <> 'd007'").unionByName(spark.createDataFrame([("d007", 1, "A zebra runs at 9 bar."), ("d007", 2, "Second page.")], PAGE))
    now = seen(spark, [n for n in names if n not in ("d007", "d012")]).unionByName(seen(spark, ["d007"], 2))
    assert index.update(changed, now) == "updated" and index.update(changed, now) == "unchanged"
    entry = index.store.entry()
    own = f"{index.path}/{entry['segments'][1]['path']}"
    assert {r.doc_name for r in spark.read.parquet(f"{own}/chunks").collect()} == {"d007"} and spark.read.parquet(f"{own}/vectors").count() == 2
    assert {r.doc_name for r in spark.read.parquet(f"{own}/deleted").collect()} == {"d007", "d012"}
    q = queries_of(spark, "zebra number", "number 7 alpha", "number 12", "the valve1")
    hits = same_as_rebuilt(spark, index, q, 50)
    assert "d012_p1_c0" not in {c for c, _ in hits.values()} and index.stats().first().num_chunks == 40 == index.table("config").first().num_chunks
    assert {r.chunk_id for r in index.table("vectors").where("chunk_id like 'd0%7_p%' or chunk_id like 'd012%'").collect()} == {"d007_p1_c0", "d007_p2_c0", "d017_p1_c0", "d027_p1_c0", "d037_p1_c0"}
    searched = {(r.qid, r["rank"]): r.chunk_id for r in index.search(q, 5).collect()}
    index.compact()
    assert same_as_rebuilt(spark, index, q, 50) == hits and {(r.qid, r["rank"]): r.chunk_id for r in index.search(q, 5).collect()} == searched
    assert len(index.store.entry()["segments"]) == 1 and index.update(changed, now) == "unchanged"
    assert index.update(changed, seen(spark, [])) == "updated" and index.stats().first().num_chunks == 0 and index.lexical(q, 3).count() == 0 and index.search(q, 2).count() == 0
    assert index.update(changed, now) == "appended" and index.stats().first().num_chunks == 40
    same_as_rebuilt(spark, index, q, 50)


def test_a_search_reads_the_buckets_of_its_terms_only(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=32)
    index.build(pages_of(spark, 30))
    q = queries_of(spark, "pump1 number")
    want = sorted(map(tuple, index.lexical(q, 5).collect()))
    read = {r.bucket for r in postings.query_terms(q, 32).collect()}
    top = f"{index.path}/{index.store.entry()['segments'][0]['path']}"
    broken = 0
    for f in glob.glob(f"{top}/postings/bucket=*/*.parquet") + glob.glob(f"{top}/chunks/*.parquet") + glob.glob(f"{top}/vectors/*.parquet"):
        if "bucket=" in f and int(f.split("bucket=")[1].split("/")[0]) in read:
            continue
        with open(f, "r+b") as x:  # the footer stays, as the schema is taken from any file: pages are made unreadable
            x.seek(4)
            x.write(b"\xff" * (os.path.getsize(f) // 3))
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
        broken += 1
    assert broken > 10 and sorted(map(tuple, index.lexical(q, 5).collect())) == want
    with pytest.raises(Exception):  # noqa: B017  what another bucket holds can no longer be read
        index.lexical(queries_of(spark, " ".join(f"valve{i} pump{i} {i} alpha the runs at bar and" for i in range(30))), 5).collect()


def test_many_blocks_and_empty_cases(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=4)
    with pytest.raises(ValueError, match="no index"):
        index.search(queries_of(spark, "x"))
    index.build(pages_of(spark, 12).unionByName(spark.createDataFrame([("blank", 1, " "), ("none", 1, None)], PAGE)))
    q = queries_of(spark, *[f"alpha number {i} pump{i % 5}" for i in range(9)], "", None)
    want = same_as_rebuilt(spark, index, q)
    monkeypatch.setattr(search, "BLOCK", 2)
    monkeypatch.setattr(search, "CELLS", 3)
    assert same_as_rebuilt(spark, index, q) == want
    empty = Index(spark, str(tmp_path / "e"), hashed_embed())
    empty.build(spark.createDataFrame([], PAGE))
    assert empty.search(q, 2).count() == 0 and empty.stats().first().num_chunks == 0 and empty.table("config").first().num_chunks == 0
    empty.build(pages_of(spark, 3), mode="append")
    assert empty.search(q.where("qid = 1"), 2).count() == 2
    empty.build(pages_of(spark, 4), mode="append", enrich=lambda p: F.lit('{"summary": "zebra"}'))  # a segment with further columns
    assert {(r.doc_name, r.summary) for r in empty.table("chunks").collect()} == {("d000", None), ("d001", None), ("d002", None), ("d003", "zebra")}


def test_open_takes_the_embedder_that_the_index_names(spark, tmp_path):
    Index(spark, str(tmp_path / "i"), hashed_embed(8), "small").build(pages_of(spark, 3))
    index = Index.open(spark, str(tmp_path / "i"), {"small": hashed_embed(8), "large": hashed_embed(64)})
    assert index.model == "small" and index.search(queries_of(spark, "alpha"), 1).count() == 1
    with pytest.raises(ValueError, match="small"):
        Index.open(spark, str(tmp_path / "i"), {"large": hashed_embed(64)})
    with pytest.raises(ValueError, match="no index"):
        Index.open(spark, str(tmp_path / "none"), {})


def test_scoped_search_counts_ranks(spark, tmp_path):
    """Hits of one document equal those of a search for everything that is filtered afterwards."""
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=4)
    rows = [(f"doc{i % 4}" if i % 9 else "rare", i, f"word{i % 6} pump {'bar ' * (i % 4)} valve{i % 5} number {i}") for i in range(60)]
    index.build(spark.createDataFrame(rows, PAGE))
    q = queries_of(spark, "pump bar valve1", "word3 number", "zzz", "valve2")
    for doc, k in (("rare", 3), ("doc2", 2), ("doc0", 50), ("missing", 2)):
        own = index.table("chunks").where(F.col("doc_name") == doc).count()
        budget = max(1, min(60, max(3 * k, int(k / (own / 60))))) if own else 1
        want = {}
        for r in sorted(index.search(q, budget).where(F.col("doc_name") == doc).collect(), key=lambda r: r["rank"]):
            if len(want.setdefault(r.qid, [])) < k:
                want[r.qid].append((r.chunk_id, round(r.score, 9)))
        got = {}
        for r in sorted(index.search_by_document(q, doc, k).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.qid, []).append((r.chunk_id, round(r.score, 9)))
        assert got == want


def test_lists_are_cut_at_each_query_s_own_budget(spark, monkeypatch):
    """A task hands on no more hits of a query than it asks for; neither blocks, nor small lists, nor lists too long to be held, nor ranges change ranks."""
    v = spark.createDataFrame([(f"k{i:03d}", [float(i * 37 % 50), float(i % 3)]) for i in range(300)], "id string, embedding array<double>").repartition(3).cache()
    q = spark.createDataFrame([(1, [1.0, 0.0], 4), (2, [0.0, 1.0], 150), (3, [-1.0, 0.5], 0), (4, [0.5, -1.0], 1000)], "qid long, q array<double>, budget long")
    words = v.select("id", F.lit("d").alias("doc"), F.lit(0).alias("seg"), F.expr("concat('a ', repeat('b ', int(embedding[0]) % 7), substring(id, 4, 1))").alias("text"))
    rows = postings.postings(words, "id", "doc").withColumn("bucket", postings.bucket_of(F.col("term"), 4)).cache()
    terms = postings.term_counts(rows, 4).cache()
    dfs = terms.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
    asked = q.select("qid", F.when(F.col("qid") == 2, "b").otherwise("3 b").alias("text"), "budget")
    length = rows.agg(F.sum("tf")).first()[0]

    def best(scores):
        ranks = search.counted_ranks(scores, "score", "id").join(q.select("qid", "budget"), "qid").where(F.col("rank") <= F.col("budget"))
        return sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in ranks.collect())

    dense = lambda k: search.dense(v, q, "id", k)
    lexical = lambda k: postings.bm25(rows, terms, dfs, 300, length, asked, "id", k, 4)
    want = best(dense(None)), best(lexical(None))
    assert [len(x) for x in want][0] == 454 and want[1]
    for settings in ({}, {"CELLS": 5, "HELD": 500}, {"LONG": 100}):
        with monkeypatch.context() as m:
            for name, value in settings.items():
                m.setattr(search, name, value)
            assert (best(dense("budget")), best(lexical("budget"))) == want
    assert dense("budget").where("qid = 1").count() <= spark.sparkContext.defaultParallelism * 4 and dense("budget").where("qid = 3").count() == 0
    monkeypatch.setattr("tallgrove.operators.incremental.RANGE", 100)
    assert best(dense("budget")) == want[0]


# -- cross references by query ---------------------------------------------------------------------


def test_references_do_not_leak_between_queries(spark):
    chunks = spark.createDataFrame(
        [("c0", "d", 1, "1.0 Start", "See section 2.1 and Section 2."), ("c1", "d", 1, " 2.1 Parts", "Parts."), ("c2", "d", 1, "9 End", "Section 7"), ("c3", "d", 2, "2.10 Rest", "Rest."), ("e1", "e", 1, "2.1 Else", "Else.")],
        "chunk_id string, doc_name string, page int, section string, text string",
    )
    have = lambda *own: chunks.join(spark.createDataFrame(list(own), "qid long, chunk_id string"), "chunk_id")
    found = lambda *own: {(r.qid, r.chunk_id, r.ref) for r in context.referenced(have(*own), chunks).collect()}
    alone = {q: found(*own) for q, own in {1: [(1, "c0")], 2: [(2, "c2")], 3: [(3, "c1")], 4: [(4, "c0"), (4, "c1")]}.items()}
    assert alone == {1: {(1, "c1", "2.1"), (1, "c3", "2.1")}, 2: set(), 3: set(), 4: {(4, "c3", "2.1")}}
    assert found((1, "c0"), (2, "c2"), (3, "c1"), (4, "c0"), (4, "c1")) == set().union(*alone.values())
    assert {r.chunk_id for r in context.with_referenced(have((1, "c0")).withColumn("score", F.lit(1.0)), chunks).collect()} == {"c0", "c1", "c3"}


# -- stored replies ---------------------------------------------------------------------------------


def test_replies_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(system, user):
        calls.add(1)
        if "fail" in user:
            raise OSError("busy")
        return user.upper(), 3, 2

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "fail"), (5, None), (6, "skip")], "qid long, text string")
    replies = Replies(spark, str(tmp_path / "r"))
    ask = lambda: replies.ask(rows, model, "sys", F.col("text"), "out", when=F.coalesce(F.col("text") != "skip", F.lit(True)))
    out = ask()
    got = {r.qid: r.out for r in out.collect()}
    again = {r.qid: r.out for r in out.collect()}
    assert calls.value == 4 and got == again  # a, b, fail and the empty prompt
    assert [got[i].text for i in (1, 2, 3, 5)] == ["A", "A", "B", ""] and got[4].text.startswith("[LLM Error]") and got[6] is None
    assert sum(x.calls for x in got.values() if x) == 3 and got[1].calls == 1 and got[2].calls == 0 and got[2].latency_ms == 0  # the failed one is not charged
    later = {r.qid: r.out for r in ask().collect()}
    assert calls.value == 5 and later[1].text == "A" and sum(x.calls for x in later.values() if x) == 0  # only what failed is asked again
    other = replies.ask(rows.where("qid = 1"), model, "sys", F.col("text"), "out", model="other").first().out
    assert calls.value == 6 and other.calls == 1
    none = replies.ask(rows, None, "sys", F.col("text"), "out").first().out
    assert none.text.startswith("[LLM Error]") and none.calls == 0


class Script:
    """A model that counts its calls by stage."""

    def __init__(self, spark, answer):
        self.answer, self.n = answer, {k: spark.sparkContext.accumulator(0) for k in ("plan", "answer", "verify", "reformulate")}

    def __call__(self, system, user):
        if "sub-queries" in system:
            self.n["plan"].add(1)
            return json.dumps({"sub_queries": [{"text": user}]}), 1, 1
        if "Check" in system:
            self.n["verify"].add(1)
            return json.dumps({"claims": [{"claim": "c", "supported": True}], "confidence": "high"}), 1, 1
        if "reformulated_query" in system:
            self.n["reformulate"].add(1)
            return json.dumps({"reformulated_query": "hose rubber" if "Retrieved snippets:\n- (" in user and "qqq" in user.split("\n")[0] else ""}), 1, 1
        self.n["answer"].add(1)
        return self.answer, 1, 1

    def counts(self):
        return {k: v.value for k, v in self.n.items()}


def test_the_agentic_pipeline_checks_its_own_context(spark, tmp_path):
    """A value and a source that only a referenced section has."""
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=4)
    index.build(spark.createDataFrame([("a", 1, "1.0 Start Here\nThe pump is set up as in Section 2.1 below."), ("a", 2, "2.1 Limits Of Use\nNever exceed 4567 bar."), ("b", 1, "9.1 Other Things\nHoses are of rubber.")], PAGE))
    chunks = {r.chunk_id: r.section for r in index.table("chunks").collect()}
    assert chunks["a_p2_c0"].startswith("2.1")
    q = queries_of(spark, "pump set up")
    model = Script(spark, "At most 4567 bar [^1].\nReferences\n[^1]: a, Page 2 (id: a_p2_c0)")
    out = pipelines.agentic(index, q, model, 1, passes=1)
    r, again = out.first(), out.first()
    assert r == again and [c.chunk_id for c in r.citations] == ["a_p2_c0"] and r.confidence == "high"
    assert [c.chunk_id for c in r.chunks] == ["a_p1_c0", "a_p2_c0"] and [c.source_query for c in r.chunks] == ["pump set up", "xref:2.1"]
    assert model.counts() == {"plan": 1, "answer": 1, "verify": 1, "reformulate": 0} and r.usage.calls == 3
    a = agent.answered(index, q, lambda t: F.lit("no plan"), lambda p: F.lit("At most 4567 bar [^1].\n[^1]: a, Page 2 (id: a_p2_c0)"), top_k=1).first()
    assert [c.chunk_id for c in a.citations] == ["a_p2_c0"] and a.mismatches == []


def test_without_context_no_model_is_asked(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), hashed_embed())
    index.build(spark.createDataFrame([], PAGE))
    model = Script(spark, "made up")
    r = pipelines.agentic(index, queries_of(spark, "anything"), model, 2, passes=1).first()
    assert r.answer == pipelines.NOTHING and r.confidence == "low" and r.citations == [] == r.chunks and model.counts() == {"plan": 1, "answer": 0, "verify": 0, "reformulate": 0} and r.usage.calls == 1


def test_passes_search_open_sub_queries_only(spark, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=4)
    index.build(spark.createDataFrame([("pump", 1, "The pump runs at 30 bar."), ("hose", 1, "hose rubber")], PAGE))
    q = queries_of(spark, "The pump runs at 30 bar.", "qqq", "uuu", "qqq")
    searched = []
    plain = Index.search

    def counted(self, queries, *a, **k):
        searched.append(sorted(r.text for r in queries.collect()))
        return plain(self, queries, *a, **k)

    monkeypatch.setattr(Index, "search", counted)
    model = Script(spark, "x")
    out = pipelines.agentic(index, q, model, 1, passes=3, reformulate=model, rerank=lambda a, b: F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))).cast("double"))
    rows = {r.qid: r for r in out.collect()}
    out.collect()
    assert searched == [["The pump runs at 30 bar.", "qqq", "qqq", "uuu"], ["hose rubber", "hose rubber"]]  # uuu got no query; the pump was covered
    assert model.counts()["reformulate"] == 2 and {c.doc_name for c in rows[1].chunks} >= {"hose"}  # equal prompts are one call
    assert sum(r.usage.calls for r in rows.values()) == sum(model.counts().values())
    _, coverage = agent.retrieve(index, spark.createDataFrame([(1, 0, "uuu")], "qid long, sub int, text string"), 1)
    assert coverage.first().note == "Weak coverage (sim=0.00) for: uuu" and coverage.first().passes == 1


def test_speed_and_configurations(spark, tmp_path):
    from tallgrove.plans import harness

    index = Index(spark, str(tmp_path / "i"), hashed_embed(), buckets=2)
    index.build(pages_of(spark, 4))
    r = harness.speed(index, 2).first()
    assert r.num_queries == 2 and 0 < r.min <= r.median <= r.p95 <= r.p99 <= r.max and 0 <= r.cache_hit_rate <= 1
    overlap = lambda a, b: F.size(F.array_intersect(F.split(a, " "), F.split(b, " "))).cast("double")
    rows = {x.configuration: x for x in harness.compare_configurations(index, "number 3", {"baseline": {}, "with_reranking": {"rerank": overlap}}, 1, 2).collect()}
    assert rows["baseline"].top_rerank_score == 0 < rows["with_reranking"].top_rerank_score and rows["baseline"].avg_latency_ms > 0
