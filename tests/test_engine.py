"""The retrieval engine: queries against their SQL, and small frames for what the tables never trigger."""
import collections
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrove.functions import text as T
from tallgrove.functions import vectors as V
from tallgrove.operators import chunking, context, evaluation, incremental, postings, search
from tallgrove.plans.index import Index, hashed_embed
from tallgrove.plans.queries import QUERIES, SQL, bag_vectors
from tallgrove.sources import files


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "conversations", "events", "pages"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    want = sorted(con.sql(f"select {', '.join(cols)} from ({SQL[name]})").fetchall(), key=repr)
    assert got == want


def test_queries_on_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "benchmark", "embeddings", "labels", "conversations", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("bm25_topk", "dense_topk", "rrf_fusion", "chunks", "assemble_context", "query_stats_7d", "search_by_document", "eval_aggregate"):
        QUERIES[name](spark, str(tmp_path)).collect()


def greedy(sizes, size, overlap):
    """The packing loop stated literally."""
    out, cur, fresh = [], [], 0
    cost = lambda ids: sum(sizes[i] + 1 for i in ids)
    for i in range(len(sizes)):
        if fresh and cost(cur) + sizes[i] + 1 > size:
            out.append((cur[0], cur[-1]))
            keep = []
            for j in reversed(cur):
                if cost(keep) + sizes[j] + 1 > overlap:
                    break
                keep.insert(0, j)
            cur, fresh = (keep if cost(keep) + sizes[i] + 1 <= size else []), 0
        cur.append(i)
        fresh += 1
    return out + ([(cur[0], cur[-1])] if cur else [])


def test_packing_equals_the_loop():
    import random

    random.seed(3)
    for _ in range(3000):
        sizes = [random.choice([1, 5, 20, 60, 130]) for _ in range(random.randint(0, 25))]
        assert chunking.packed_ranges(sizes, 100, random.choice([0, 10, 30, 90])) is not None
        for overlap in (0, 10, 30, 90):
            assert chunking.packed_ranges(sizes, 100, overlap) == greedy(sizes, 100, overlap)


def test_headers_and_chunks(spark):
    text = "1.2 Scope of use\nFirst sentence here. Second one! \n\nSAFETY RULES\nSTEP 3: Open. Then close.\n12. no header\nProcedure 4. Close"
    assert [h for _, h in chunking.header_spans(text)] == ["1.2 Scope of use", "SAFETY RULES", "STEP 3: Open. Then close.", "Procedure 4. Close"]
    for s, e, t in chunking.sentence_spans(text):
        assert text[s:e].strip() == t
    pages = spark.createDataFrame([("d", 1, text), ("e", 2, None), ("f", 3, "  ")], "doc_name string, page int, text string")
    got = chunking.chunks(pages, 50, 10).orderBy("ord").collect()
    assert {r.doc_name for r in got} == {"d"} and got[0].chunk_id == "d_p1_c0" and got[0].section == "1.2 Scope of use" and got[-1].section == "STEP 3: Open. Then close."


def test_text_functions(spark):
    row = lambda *cols: spark.range(1).select(*cols).first()
    s = F.lit("\u00a0 Go to 10.0.0.1, C:\\tmp\\a.txt and /etc/ssh/x.conf [^12] 30 mm\nReferences\n[^1]: x 99")
    assert sorted(row(T.value_tokens(T.answer_body(s)))[0]) == sorted({"10.0.0.1", "C:\\tmp\\a.txt", "/etc/ssh/x.conf", "10.0", "0.1", "30"})
    assert row(T.strip(F.lit("\u00a0\x1c a b \n")))[0] == "a b"
    assert row(T.chunk_index(F.lit("a_p1_c12")), T.chunk_index(F.lit("x")))[:] == (12, 0)
    assert row(T.xrefs(F.lit("see Section 3.2 and section 10; 4.1")))[0] == ["3.2", "10"]
    assert row(T.file_stem(F.lit("file:/a/b.c/report.v2.pdf")))[0] == "report.v2"
    assert row(T.abstained(F.lit("I could  NOT find it")), T.abstained(F.lit("here it is")))[:] == (True, False)
    empty = F.array().cast("array<string>")
    assert row(T.fact_coverage(F.lit("a"), empty), T.must_cite_recall(F.array(F.lit("guide")), F.array(F.lit("the guide"), F.lit("x"))))[:] == (None, 0.5)
    assert row(T.confidence(F.lit("high"), F.lit(0.96), empty), T.confidence(F.lit("low"), F.lit(0.96), empty), T.confidence(F.lit("high"), F.lit(0.5), empty))[:] == ("high", "medium", "low")
    assert row(T.embedding_text(F.lit("d"), F.lit(""), F.lit(None).cast("string"), F.array(F.lit("q?")), F.lit("t")))[0] == "d\nQuestions answered: q?\nt"
    assert row(T.embedding_source(F.lit(""), F.lit("t")))[0] == "t"


@pytest.mark.parametrize("raw,want", [('{"a": 1}', '{"a": 1}'), ('x ```json\n[1]\n``` y', "[1]"), ('so {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("[1, 2] tail", "[1, 2]"), ("none", None), ("", None), (None, None), ("{ broken", None)])
def test_json_from_replies(spark, raw, want):
    assert T.balanced_json(raw) == want
    assert spark.createDataFrame([(raw,)], "r string").select(T.llm_json(F.col("r"))).first()[0] == want


def test_enrichment(spark):
    replies = [json.dumps({"summary": " s ", "questions": [" a ", "", *"bcdefg"]}), "oops", None, '{"summary": 3}']
    got = [tuple(r.e) for r in spark.createDataFrame([(r,) for r in replies], "r string").select(T.enrichment(F.col("r")).alias("e")).collect()]
    assert got == [("s", ["a", "b", "c", "d", "e"]), ("", []), ("", []), ("3", [])]


def test_vectors(spark):
    r = spark.range(1).select(V.normalized(F.array(F.lit(3.0), F.lit(4.0))), V.normalized(F.array(F.lit(0.0))), V.similarity(F.lit(1.2)), V.similarity(F.lit(None).cast("double"))).first()
    assert r[0] == [0.6, 0.8] and r[1] == [0.0] and r[2:] == (1.0, 0.0)


def test_bm25_small(spark):
    docs = spark.createDataFrame([(0, "the cat sat"), (1, "the dog"), (2, "the cat cat ran far"), (3, None)], "id long, text string")
    got = search.bm25(docs, spark.createDataFrame([(9, "cat cat unknown")], "qid long, text string"), "id", 5).collect()
    idf, avg = math.log(4 - 2 + 0.5) - math.log(2.5), (3 + 2 + 5 + 0) / 4
    assert idf == 0.0 and got == [] and avg == 2.5  # half of the documents hold the term: idf 0, no score above 0
    rare = search.bm25(docs, spark.createDataFrame([(9, "dog")], "qid long, text string"), "id", 5).collect()
    want = (math.log(3.5) - math.log(1.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2.5))
    assert [r.id for r in rare] == [1] and math.isclose(rare[0].score, want)


def test_dense_in_blocks(spark, sf, monkeypatch):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    rounded = lambda: sorted((r.qid, r.rank, r.vec_id, round(r.score, 9)) for r in search.dense(v, q, "vec_id", 3).collect())
    want = rounded()
    monkeypatch.setattr(search, "BLOCK", 3)
    assert rounded() == want


def test_best_of_many_tasks(spark, monkeypatch):
    """Ties go by key, string keys too; tasks, batches and blocks of queries do not matter; documents without words and null keys are not found."""
    words = ["red", "green", "blue", "red green", "blue blue red", None, ""]
    docs = spark.createDataFrame([(f"k{i:03d}" if i % 50 else None, words[i % 7]) for i in range(300)] + [("z", "rare")], "id string, text string").repartition(6)
    queries = spark.createDataFrame([("a", "red"), ("b", "rare green"), ("c", "none"), (None, "blue blue")], "qid string, text string")
    rounded = lambda: sorted(((r.qid or "", r.rank, r.id, round(r.score, 9)) for r in search.bm25(docs, queries, "id", 4).collect()))
    want = rounded()
    assert {q for q, *_ in want} == {"", "a", "b"} and [r[2] for r in want if r[0] == "b"][0] == "z" and all(r[2] for r in want)
    tied = [r for r in want if r[0] == "a"]
    assert [r[2] for r in tied] == sorted(r[2] for r in tied) and len({r[3] for r in tied}) == 1
    monkeypatch.setattr(search, "CELLS", 13)
    assert rounded() == want
    monkeypatch.setattr(search, "BLOCK", 1)
    monkeypatch.setattr(search, "CELLS", 2)
    assert rounded() == want


def test_batches_to_python_are_bounded(spark):
    """No operator hands its workers more than a few MB of texts or words at once, however long the rows are."""
    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", "word " * 20
    docs = spark.createDataFrame([(i, "s", 0, f"{text}w{i}") for i in range(5)], "doc_id long, source string, seg int, text string")
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_name"), F.lit(1).alias("page"), "text")
    queries = spark.createDataFrame([(1, "w1")], "qid long, text string")
    vectors = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    for name, make in {
        "postings": lambda: postings.postings(docs, "doc_id", "source"),
        "chunks": lambda: chunking.chunks(pages),
        "virtual_pages": lambda: chunking.virtual_pages(docs, "doc_id"),
        "vocabulary": lambda: search.vocabulary(docs),
        "bm25": lambda: search.bm25(docs, queries, "doc_id", 2),
        "dense": lambda: search.dense(vectors, vectors.select(F.col("id").alias("qid"), F.col("embedding").alias("q")), "id", 2),
        "bag_vectors": lambda: bag_vectors(docs, "doc_id"),
    }.items():
        spark.conf.set(key, str(1 << 28))
        assert make().count() and int(spark.conf.get(key)) <= 4 << 20, name


def test_best_holds_what_it_needs():
    """The best of many scores for many queries: what waits and what is kept is bounded by the hits asked for, not by the scores."""
    k, rng = np.array([3, 0, 7]), np.random.default_rng(1)
    best, every = search.Best(k), rng.integers(0, 50, (40_000, 3)) / 7
    for s in range(0, len(every), 500):
        best.add(np.arange(s, s + 500), every[s : s + 500])
        assert best.waiting + len(best.q) <= max(search.CELLS // 4, 10) + 1500
    q, keys, scores = best.rows()
    for i, n in enumerate(k):
        want = sorted(zip(-np.round(every[:, i], 9), range(len(every))))[:n]
        assert list(zip(-np.round(scores[q == i], 9), keys[q == i])) == want


def test_postings_are_dealt_evenly(spark, tmp_path, monkeypatch):
    """A task writes one bucket of one shard: as many files as those, each about as large."""
    monkeypatch.setattr(postings, "SHARD", 100)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(0).alias("seg"), F.expr("array_join(transform(sequence(0, 39), x -> concat('w', (id * 7 + x * 13) % 500)), ' ')").alias("text"))
    postings.write_postings(postings.postings(docs, "doc_id", "source"), str(tmp_path / "p"), "doc_id", 400, 4)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "p")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 400 * 40 and len(sizes) == 16 and max(sizes) < 3 * min(sizes)


def test_answers_are_normalised_once(spark):
    """One pass over a long answer, not one for each phrase and fact; words that are asked for are the first of all."""
    row = spark.createDataFrame([("  x\u2003Y\x1cz  w ", ["x y", "nowhere"])], "a string, facts array<string>")
    plan = row.select(T.abstained(F.col("a")).alias("x"), T.fact_coverage(F.col("a"), F.col("facts")).alias("y"))
    assert str(plan._jdf.queryExecution().optimizedPlan()).count("regexp_replace(coalesce(a") <= 2 and plan.first()[:] == (False, 0.5)
    assert "exists" not in str(row.select(T.abstained(F.col("a")))._jdf.queryExecution().optimizedPlan())
    texts = spark.createDataFrame([(t,) for t in (None, "", "   ", "A", " a b ", "a b c", "\u2003 a\x1cB  c d e", "a b c ")], "t string")
    assert texts.where(~T.first_tokens(F.col("t"), 3).eqNullSafe(F.slice(T.tokens(F.col("t")), 1, 3))).count() == 0


def test_scoped_search_equals_ranking(spark, sf):
    """The best of a document among the budget best of all, against a full ranking."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), "label", (10 + F.col("vec_id") % 37).alias("budget"))
    full = search.dense(v, q, "vec_id", 10_000).join(v.select("vec_id", "label"), "vec_id").join(q.select("qid", F.col("label").alias("own"), "budget"), "qid")
    want = collections.defaultdict(list)
    for r in sorted(full.where("label = own and rank <= budget").collect(), key=lambda r: (r.qid, r.rank)):
        want[r.qid].append(r.vec_id)
    got = collections.defaultdict(list)
    for r in sorted(search.scoped(v, q, "vec_id", 3, "label").collect(), key=lambda r: (r.qid, r.rank)):
        got[r.qid].append(r.vec_id)
    assert got == {k: x[:3] for k, x in want.items()}


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")], "qid long, rank int, key string")
    rel = spark.createDataFrame([(1, "b"), (1, "c"), (1, "x"), (1, "x")], "qid long, key string")
    r = {x.qid: x for x in evaluation.per_query(hits, rel, "key", 3).collect()}
    assert math.isclose(r[1].precision, 2 / 3) and math.isclose(r[1].recall, 2 / 3) and r[1].mrr == 0.5
    assert math.isclose(r[1].ndcg, (1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3) + 0.5))
    assert r[2][1:] == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "v double").agg(evaluation.nan_mean("v"), evaluation.percentile("v", 50)).first()[0] == 2.0


def test_context_budget_and_citations(spark):
    one = lambda i, page, text: ("q", "d", page, "", f"d_p{page}_c{i}", text)
    c = spark.createDataFrame([one(1, "10", "b" * 50), one(0, "2", "a" * 50), one(0, "appendix", "c" * 50)], "qid string, doc_name string, page string, section string, chunk_id string, text string")
    got = context.assembled(c, budget=200).first()
    assert got.n_blocks == 2 and got.context.index("aaa") < got.context.index("bbb") and "Section: N/A" in got.context
    assert context.assembled(c, budget=10).first().n_blocks == 1
    a = spark.createDataFrame([("q", "T [^1].\n[^1]: nowhere\n[^1]: d, Page 2\n[^2]: ghost (id: d_p10_c1)\n[^1]: d, Page 10")], "qid string, answer string")
    ranked = c.select("qid", F.lit(0).alias("ord"), "chunk_id", "doc_name", "page", "section")
    got = {(r.marker, r.chunk_id) for r in context.resolved(context.references(a), ranked).collect()}
    assert got == {(1, "d_p2_c0"), (2, "d_p10_c1")}


def test_sources_and_index(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.txt").write_bytes("Die Größe ist 5.\r\nDas Gerät läuft.".encode("cp1252"))
    (raw / "b.txt").write_text("The pump runs at 30 bar. See Section 2.\nMAIN PUMP\nThe valve opens.")
    (raw / "e.txt").write_text("  ")
    (raw / "~$b.txt").write_text("lock")
    (raw / "c.csv").write_text("x")
    (raw / "D.TXT").write_text("upper")
    listed = files.raw_files(spark, str(raw))
    assert {r.name for r in listed.select("name").collect()} == {"a.txt", "b.txt", "e.txt"}
    assert {r.name for r in files.library(spark, str(raw)).collect()} == {"a.txt", "b.txt", "e.txt", "D.TXT"}
    pages = files.extracted(listed)
    got = {r.doc_name: r for r in pages.collect()}
    assert set(got) == {"a", "b"} and got["a"].text == "Die Größe ist 5.\nDas Gerät läuft."
    assert files.manifest(pages).first().documents == ["a", "b"]
    index = Index(spark, str(tmp_path / "index"), hashed_embed())
    files.write_pages(pages.drop("error"), str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages")).select("doc_name", "page", "text")
    seen = listed.select(F.regexp_replace("name", r"\.txt$", "").alias("name"), "mtime", "size")
    index.build(stored.where("doc_name = 'a'"))
    index.remember(seen.where("name = 'a'"))
    assert index.update(stored, seen) == "appended" and index.update(stored, seen) == "unchanged"
    assert index.stats().first().docs == ["a", "b"]
    q = spark.createDataFrame([(1, "pump bar"), (2, "größe gerät")], "qid long, text string")
    best = {r.qid: r.doc_name for r in index.search(q, 2).where("rank = 1").collect()}
    assert best == {1: "b", 2: "a"}
    overlap = lambda a, b: F.size(F.array_intersect(T.tokens(a), T.tokens(b))).cast("double")
    assert index.search(q, 1, rerank=overlap).count() == 2
    answers = {r.qid: r for r in index.answer(q, lambda p: F.lit("It runs at 30 bar, not 77."), top_k=1).collect()}
    assert answers[1].mismatches == ["77"] and answers[1].confidence == "low"
    assert index.update(stored, seen.where("name = 'b'")) == "updated" and index.stats().first().docs == ["b"]


def test_agent(spark, tmp_path):
    from tallgrove.plans import agent

    pages = spark.createDataFrame([("pump", 1, "The pump runs at 30 bar. Keep it cool."), ("valve", 1, "The valve opens at 7 bar.")], "doc_name string, page int, text string")
    index = Index(spark, str(tmp_path / "i"), hashed_embed())
    index.build(pages)
    q = spark.createDataFrame([(1, "pump bar"), (2, "zzz qqq")], "qid long, text string")
    plan = lambda t: F.when(t == "pump bar", F.lit('{"sub_queries": [{"text": "the pump"}, {"text": "the valve"}]}')).otherwise("no plan")
    assert {(r.qid, r.sub, r.text) for r in agent.sub_queries(q, plan).collect()} == {(1, 0, "the pump"), (1, 1, "the valve"), (2, 0, "zzz qqq")}
    hits, coverage = agent.retrieve(index, agent.sub_queries(q, plan), 1, passes=3, reformulate=lambda system, user: json.dumps({"reformulated_query": " The valve opens at 7 bar. "}))
    assert {r.doc_name for r in hits.where("qid = 1").collect()} == {"pump", "valve"}
    assert {(r.qid, r.sub): r.passes for r in coverage.collect()}[(2, 0)] == 2
    llm = lambda p: F.lit("At 30 bar [^1].\n[^1]: pump, Page 1")
    a = {r.qid: r for r in agent.answered(index, q, plan, llm).collect()}
    assert [c.doc_name for c in a[1].citations] == ["pump"] and a[1].confidence == "n/a" and a[1].mismatches == []
    assert [r.doc_name for r in index.search_by_document(q.where("qid = 1"), "valve", 1).collect()] == ["valve"]
    assert index.search_by_document(q, "nothing", 1).count() == 0


CHECK = json.dumps({"claims": [{"claim": " It runs at 30 bar ", "supported": True, "cited_chunk_id": "k"}, {"claim": "It is red", "supported": False, "reason": "nowhere"}, {"claim": "", "supported": False}], "verified_answer": " It runs at 30 bar. ", "confidence": " High "})


def test_verification(spark):
    from tallgrove.operators import verification

    chunk = "array(named_struct('chunk_id', 'k', 'doc_name', 'd', 'page', 1, 'text', 'It runs at 30 bar.'))"
    one = lambda answer, reply, chunks=chunk, **kw: spark.sql(f"select {chunks} c").withColumn("a", F.lit(answer).cast("string")).select(verification.verified(F.col("a"), F.col("c"), F.lit(reply), **kw).alias("v")).first().v
    v = one("It runs at 30 bar. It is red.", CHECK)
    assert v.verified_answer == "It runs at 30 bar." and v.removed_claims == ["It is red"] and [c.supported for c in v.claim_checks] == [True, False, False] and v.confidence == "low"
    good = lambda n, m, said: json.dumps({"claims": [{"claim": "c", "supported": i < n} for i in range(m)], "confidence": said})
    assert one("at 30 bar", good(2, 2, "high")).confidence == "high" and one("at 30 bar", good(3, 4, "medium")).confidence == "medium" and one("at 30 bar", good(0, 0, "high")).confidence == "low"
    bad = one("at 30 bar, port 8080", good(2, 2, "high"))
    assert bad.confidence == "low" and bad.mismatches == ["8080"] and one("port 8080", good(2, 2, "high"), value_check=False).confidence == "high"
    for answer, reply, chunks in (("", CHECK, chunk), (None, CHECK, chunk), ("x", "no json", chunk), ("x", "[1]", chunk), ("x", CHECK, "slice(" + chunk + ", 1, 0)")):
        v = one(answer, reply, chunks)
        assert (v.verified_answer, v.confidence, v.claim_checks, v.removed_claims, v.mismatches) == (answer, "low", [], [], [])


def test_enrichment_stage_and_embedding_source(spark, tmp_path):
    from tallgrove.functions import models
    from tallgrove.operators import enrichment

    chunks = spark.createDataFrame([("c1", "D", "S", "Alpha body.", "old"), ("c2", "D", "", "Beta body.", None)], "chunk_id string, doc_name string, section string, text string, summary string")
    reply = lambda system, user: json.dumps({"summary": "Short.", "questions": [f"Q{i}?" for i in range(10)]})
    got = {r.chunk_id: r for r in enrichment.enriched(chunks, lambda p: models.completion(reply, "s", p)["text"]).collect()}
    assert got["c1"].summary == "Short." and len(got["c1"].questions) == 5 and "Alpha body." in got["c1"].embedding_text and "Q4?" in got["c1"].embedding_text

    def boom(system, user):
        raise RuntimeError("gateway down")

    for bad in (boom, lambda s, u: "not json", None):
        r = enrichment.enriched(chunks, lambda p: models.completion(bad, "s", p)["text"]).where("chunk_id = 'c2'").first()
        assert (r.summary, r.questions) == ("", []) and "Beta body." in r.embedding_text
    pages = spark.createDataFrame([("d", 1, "RAW words here."), ("e", 1, "OTHER words.")], "doc_name string, page int, text string")
    index = Index(spark, str(tmp_path / "i"), hashed_embed())
    index.build(pages, enrich=lambda p: F.when(F.contains(p, F.lit("RAW")), F.lit('{"summary": "zebra"}')).otherwise("none"))
    assert {r.doc_name for r in index.table("chunks").where("embedding_text like '%zebra%'").collect()} == {"d"}
    q = spark.createDataFrame([(1, "zebra")], "qid long, text string")
    assert index.search(q, 1).first().doc_name == "d"


def test_model_calls(spark):
    from tallgrove.functions import models

    d = spark.range(2).select(models.completion(lambda s, u: (f"{s}:{u}", 3, 4), "sys", F.col("id").cast("string")).alias("a"), models.completion(None, "s", F.lit("x")).alias("b"))
    r = d.select("a", "b", models.usage(F.col("a"), F.col("a"), F.col("b")).alias("u"), models.failed(F.col("b.text")).alias("f")).collect()
    assert r[1].a.text == "sys:1" and tuple(r[0].u) == (2, 6, 8) and r[0].f and r[0].b.text.startswith("[LLM Error]")
    assert tuple(d.agg(models.total_usage("a").alias("t")).first().t) == (2, 6, 8)
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) % 2:
            raise OSError("busy")
        return [[float(len(t)), 1.0] for t in texts]

    embed = models.embedder(flaky, batch=2, wait_s=0.0)
    assert sorted(r[0] for r in spark.range(3).coalesce(1).select(embed(F.repeat(F.lit("x"), F.col("id").cast("int")))).collect()) == [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]]


def test_pipelines_and_harness(spark, tmp_path):
    from tallgrove.plans import harness, pipelines

    pages = spark.createDataFrame([("pump", 1, "The pump runs at 30 bar. Keep it cool."), ("valve", 2, "The valve opens at 7 bar.")], "doc_name string, page int, text string")
    index = Index(spark, str(tmp_path / "i"), hashed_embed())
    assert index.manifest().count() == 0
    index.build(pages)
    q = spark.createDataFrame([(1, "pump bar"), (2, "valve opens")], "qid long, text string")
    calls = spark.sparkContext.accumulator(0)

    def model(system, user):
        calls.add(1)
        if "sub-queries" in system:
            return "no plan", 1, 1
        if "Check" in system:
            return json.dumps({"claims": [{"claim": "c", "supported": True}], "confidence": "high"}), 5, 5
        return "At 30 bar [^1].\n[^1]: pump, Page 1\n[^2]: nothing, Page 4", 10, 2

    t = {r.qid: r for r in pipelines.build(" Traditional ")(index, q, model, 2, hyde=lambda x: F.lit("The pump")).collect()}
    assert calls.value == 2 and t[1].confidence == "n/a" and [c.doc_name for c in t[1].citations] == ["pump"] and t[1].usage.calls == 1 and {c.doc_name for c in t[1].chunks} == {"pump", "valve"} and [s.name for s in t[1].stages] == ["retrieval", "answer"]
    calls = spark.sparkContext.accumulator(0)
    a = pipelines.build("agentic")(index, q, model, 2, passes=1)
    got = {r.qid: r for r in a.collect()}
    assert got[1].confidence == "high" and got[1].usage.prompt_tokens == 16 and [s.name for s in got[1].stages] == ["planner", "retriever", "assembler", "answerer", "verifier"] and got[1].total_latency_ms > 0
    assert [c.chunk_id for c in got[1].citations] == [c.chunk_id for c in got[1].chunks if c.doc_name == "pump"] and pipelines.agentic(index, q, None, verify=False, passes=1).first().answer.startswith("[LLM Error]")
    with pytest.raises(ValueError):
        pipelines.build("other")
    labels = spark.createDataFrame([("pump bar", [got[1].citations[0].chunk_id], ["30 bar"], ["pump"], False), ("valve opens", None, None, None, True)], "query string, relevant array<string>, expected_facts array<string>, must_cite array<string>, out_of_scope boolean")
    both = pipelines.traditional(index, q, model, 2).unionByName(a)
    card, rows = harness.compare(both, labels, 2)
    r = {x.pipeline: x for x in card.collect()}
    assert r["agentic"].num_queries == 2 and r["agentic"].fact_coverage == 1.0 and r["agentic"].recall == 1.0 and r["agentic"].precision == 0.5 and r["agentic"].resilience == 0.0 and r["traditional"].llm_calls == 1.0
    per = harness.retrieval(index.search(q, 2), spark.createDataFrame([(1, "pump_p1_c0"), (2, "valve_p2_c0")], "qid long, chunk_id string"), "chunk_id", 2)
    report = harness.test_set_report(per)
    assert report.first().num_queries == 2 and report.first().avg_recall == 1.0
    harness.write_report(str(tmp_path / "r"), "now", aggregated=report, individual=per)
    assert spark.read.json(str(tmp_path / "r/now/individual")).count() == 2
    with pytest.raises(ValueError, match="another"):
        Index(spark, str(tmp_path / "i"), hashed_embed(), "other").search(q)
    fresh = Index(spark, str(tmp_path / "f"), hashed_embed())
    now = spark.sql("select 'pump' name, timestamp'2024-01-01 00:00:00' mtime, 5L size")
    assert fresh.update(pages, now) == "built" and fresh.update(pages, now) == "unchanged" and fresh.stats().first().docs == ["pump"]


def test_pages_before_a_broken_one_are_kept(spark, monkeypatch):
    def broken(name, ext, raw):
        yield 1, "first"
        raise OSError("page 2")

    monkeypatch.setattr(files, "pages_of", broken)
    df = spark.createDataFrame([("a.pdf", "pdf", b"x")], "name string, ext string, content binary")
    rows = files.extracted(df)
    assert sorted(((r.page, r.text, r.error) for r in rows.collect()), key=str) == [(1, "first", None), (None, None, "OSError: page 2")]


def test_records_and_log(spark, tmp_path):
    from tallgrove.operators import records

    assert records.checked_query(" q ", 3) == ("q", 3) and records.clamped_days(0) == 1
    for bad in (("", 1), ("x" * 2001, 1), ("q", 0), ("q", 101), ("q", True)):
        with pytest.raises(ValueError):
            records.checked_query(*bad)
    chunks = spark.createDataFrame([("a", "d", "B", 2), ("b", "d", "A", 0), ("c", "d", "", 1), ("a", "d", "B", 5)], "chunk_id string, doc_name string, section string, ord int")
    assert records.chunk_by_id(chunks, "a").first().ord == 2 and records.chunk_by_id(chunks, "x").count() == 0
    assert [r.section for r in records.document_sections(chunks, "d").collect()] == ["A", "B"]
    assert records.section_chunks(chunks, "d", "B").count() == 2
    log = records.QueryLog(spark, str(tmp_path / "log"))
    q = spark.sql("select 1L qid, 'a' query, timestamp'2024-01-30 00:00:00' timestamp, 5 top_k, 2.0D latency_ms, true cache_hit, true use_rerank, false generate_answer union all select 2L, 'a', timestamp'2023-01-01 00:00:00', 5, 4.0D, false, true, false")
    r = spark.createDataFrame([(1, 1, 0.5, 2.0), (1, 2, 0.9, None)], "qid long, rank int, similarity double, rerank_score double")
    log.log_queries(q, r)
    log.log_queries(q, r)
    log.log_feedback(spark.createDataFrame([("x", 5, "c" * 2000)], "query_id string, rating int, comments string"))
    out = log.exported("2024-01-31", "now").first()
    assert out.query_stats_7d.total_queries == 2 and out.query_stats_7d.cache_hits == 2 and out.top_queries[0].n == 4 and out.feedback_stats.positive == 1
    assert log.table("queries").where("qid = 1").first().top_similarity == 0.5 and len(log.table("feedback").first().comments) == 1000
    result = "named_struct('chunk_id', 'k', 'text', 'it is 30 bar', 'doc_name', 'd')"
    res = spark.sql(f"select 1L qid, 'q' query, 'agentic' pipeline, 'It is 30' answer, 'high' confidence, array(named_struct('chunk_id', 'k', 'doc_name', 'd')) citations, array({result}) chunks, named_struct('calls', 2, 'prompt_tokens', 3, 'completion_tokens', 4) usage, 1.239D total_latency_ms")
    hits = spark.createDataFrame([(1, "a", "d", 2, "s", "t", 0.2, None), (1, "b", "d", None, None, "u", 0.9, 0.5)], "qid long, chunk_id string, doc_name string, page int, section string, text string, score double, similarity double")
    rows = records.response(records.retrieved(hits, F.lit(None).cast("string")), [F.desc("score"), F.col("chunk_id")]).collect()
    assert [(x["rank"], x.chunk_id, x.page, x.section, x.similarity) for x in rows] == [(1, "b", "", "", 0.5), (2, "a", "2", "s", 0.0)]
    lab = spark.createDataFrame([("q", ["it is 30"], ["d"], False)], "query string, expected_facts array<string>, must_cite array<string>, out_of_scope boolean")
    s = records.scored_answers(res, lab).first()
    assert (s.fact_coverage, s.must_cite_recall, s.citation_validity, s.grounding, s.abstained, s.total_tokens, s.resilience) == (1.0, 1.0, 1.0, 1.0, False, 7, None)
    assert json.loads(records.wire(res).first().json)["total_latency_ms"] == 1.24


def test_numbers_in_ranges(spark, monkeypatch):
    """Many small ranges give the same dense numbers, with one value in a third of the rows, nulls and ties of the first column."""
    rows = [(None if i % 10 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}", i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "source string, doc_id long").repartition(5)
    monkeypatch.setattr(incremental, "RANGE", 90)
    got = {(r.source, r.doc_id): r.ord for r in incremental.numbered(df, ["source", "doc_id"], "ord").collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [got[r] for r in want] == list(range(1, 1001))


def test_changes(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "name string, mtime long, size long")
    new = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("d", 1, 5)], "name string, mtime long, size long")
    assert {tuple(r) for r in incremental.changes(new, old).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "new")}


def test_page_and_chunk_files(spark, tmp_path):
    """JSON arrays of pages and chunks; files that are something else are left out."""
    pages = [{"doc_name": "d", "page": i, "text": f"t{i}", "doc_type": "txt"} for i in (1, 2)]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/d.json").write_text(json.dumps(pages))
    (tmp_path / "pages/manifest.json").write_text(json.dumps({"total_docs": 1, "documents": ["d"]}))
    (tmp_path / "pages/notes.txt").write_text("no")
    assert sorted((r.doc_name, r.page, r.text, r.doc_type) for r in files.read_pages(spark, str(tmp_path / "pages")).collect()) == [("d", 1, "t1", "txt"), ("d", 2, "t2", "txt")]
    chunk = {"chunk_id": "d_p1_c0", "doc_name": "d", "page": 1, "section": "S", "text": "t", "char_start": 0, "char_end": 1}
    (tmp_path / "chunks.json").write_text(json.dumps([chunk, chunk | {"chunk_id": "d_p1_c1", "summary": "s", "questions": ["q"]}]))
    got = {r.chunk_id: r for r in files.read_chunks(spark, str(tmp_path / "chunks.json")).collect()}
    assert got["d_p1_c0"].summary is None and got["d_p1_c1"].questions == ["q"] and got["d_p1_c0"].char_end == 1


def test_test_set_and_streams(spark, tmp_path):
    from tallgrove.streaming import ingest

    (tmp_path / "t.json").write_text(json.dumps({"queries": [{"query": "q", "relevant": ["a"], "out_of_scope": False}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"query": "q2", "expected_facts": ["f"]}]))
    assert files.read_test_set(spark, str(tmp_path / "t.json")).first().relevant == ["a"]
    assert files.read_test_set(spark, str(tmp_path / "l.json")).first().query == "q2"
    seen = []
    spark.createDataFrame([("a", 1, "x")], "doc_name string, page int, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.new_pages(spark, str(tmp_path / "in"), str(tmp_path / "state"), lambda df, i: seen.append(df.count()), "doc_name string, page int, text string").awaitTermination()
    assert [n for n in seen if n] == [1]
    log = spark.sql("select timestamp'2024-01-01 10:05:00' as timestamp, 2.0D as latency_ms, true as cache_hit")
    assert ingest.windowed_stats(log).first().n == 1
    # as a stream: windows end with the watermark, late rows are left out
    rows = "select timestamp'2024-01-01 {}' as timestamp, 2.0D as latency_ms, true as cache_hit"
    for i, at in enumerate(("10:05:00", "10:50:00", "12:30:00", "10:55:00", "14:00:00")):
        spark.sql(rows.format(at)).write.mode("append").parquet(str(tmp_path / "log"))
        stream = ingest.windowed_stats(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "stats")).awaitTermination()
    assert sorted((r.start.hour, r.n) for r in spark.read.parquet(str(tmp_path / "stats")).collect()) == [(10, 2), (12, 1)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
