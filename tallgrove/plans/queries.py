"""The registered queries of the retrieval engine and their DuckDB SQL, side by side."""
from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrove.functions import models
from tallgrove.functions import text as T
from tallgrove.functions import vectors as V
from tallgrove.operators import chunking, clustered, context, enrichment, evaluation, incremental, postings, records, rollups, search, verification
from tallgrove.operators.batches import small_batches
from tallgrove.plans import harness
from tallgrove.sources.store import kept, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a function of (table reader) under its name with its SQL."""

    def add(f: Callable) -> Callable:
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name], SQL[name] = run, sql
        return f

    return add


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c: str | Column, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c)


# -- lexical search --------------------------------------------------------------------------

TOK = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')"
BM25 = rf"""
dt as (select doc_id, {TOK} as t from documents),
dl as (select doc_id, len(t) as dl from dt),
av as (select avg(dl) as avgdl, count(*) as n from dl),
vocab as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw
  from (select unnest(list_distinct(t)) as term from dt), av group by term),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from vocab) else raw end as idf from vocab),
qt as (select qid, term, count(*) as times from (select item_id as qid, unnest({TOK}) as term from benchmark) group by all),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from dt) where term in (select term from qt) group by all),
bm as (select qid, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score
  from qt join idf using (term) join tf using (term) join dl using (doc_id), av group by all),
lex as (select * from (select qid, doc_id, score, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank from bm where score > 0) where rank <= 20)
"""


def _items(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("qid"), "text")


@query(f"with {BM25} select qid, rank, doc_id, round(score, 6) as score from lex where rank <= 5")
def bm25_topk(t):
    out = search.bm25(t("documents").select("doc_id", "text"), _items(t), "doc_id", 5)
    return out.select("qid", long("rank").alias("rank"), "doc_id", r6("score"))


@query(f"with {BM25} select term, df, round(raw, 6) as idf from vocab")
def bm25_vocab_idf(t):
    return search.vocabulary(search.spread(t("documents").select("text"))).select("term", "df", r6("idf"))


#: Buckets of terms of the indexes that queries write; an ``Index`` has more by default.
BUCKETS = 16


def _segments(t, parts: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(postings, terms, dfs, chunks, tokens) of all documents, written as one segment after another."""
    docs = t("documents").select("doc_id", "source", "text")
    top, tables = scratch(docs.sparkSession), {"postings": [], "terms": [], "dfs": []}
    for i, part in enumerate(parts):
        own = docs.where(part).withColumn("seg", F.lit(i))
        postings.write_postings(postings.postings(own, "doc_id", "source"), f"{top}/{i}/postings", "doc_id", own.count(), BUCKETS)
        change = postings.term_counts(docs.sparkSession.read.parquet(f"{top}/{i}/postings"), BUCKETS)
        postings.write_statistics(change, postings.united(docs.sparkSession, tables["terms"]), f"{top}/{i}")
        for name, paths in tables.items():
            paths.append(f"{top}/{i}/{name}")
    found = [postings.united(docs.sparkSession, paths) for paths in tables.values()]
    return *found, docs.count(), found[0].agg(F.sum("tf")).first()[0]


@query(SQL["bm25_topk"])
def postings_topk(t):
    """``bm25_topk`` from a persisted inverted index: the buckets of the queries' terms are read, no text is."""
    rows, terms, dfs, n, length = _segments(t, [F.lit(True)])
    return postings.bm25(rows, terms, dfs, n, length, _items(t), "doc_id", 5, BUCKETS).select("qid", long("rank").alias("rank"), "doc_id", r6("score"))


@query(SQL["bm25_vocab_idf"])
def postings_vocab_idf(t):
    """``bm25_vocab_idf`` from the statistics of segments by language, added up."""
    _, terms, _, n, _ = _segments(t, [F.col("lang") == "en", F.col("lang") == "de", ~F.col("lang").isin("en", "de") | F.col("lang").isNull()])
    return postings.summed(terms).select("term", "df", r6(postings._idf(F.col("df"), n), "idf"))


@query(f"""with {BM25.replace("from documents", "from (select * from documents where doc_id not in (select doc_id from labels where toxic = 1))")}
select qid, rank, doc_id, round(score, 6) as score from lex where rank <= 5""")
def postings_after_deletes(t):
    """The same after three appends and the deletion of all documents that are labelled toxic: changes of the statistics add up, postings stay where they are."""
    rows, terms, dfs, n, length = _segments(t, [F.col("lang") == "en", F.col("lang") == "de", ~F.col("lang").isin("en", "de") | F.col("lang").isNull()])
    gone = t("labels").where("toxic = 1").select("doc_id")
    dead = kept(t("documents").join(search.near(gone), "doc_id", "left_semi").select("doc_id", "source", "text", F.lit(3).alias("seg")))
    lost = kept(postings.postings(dead, "doc_id", "source"))
    top = scratch(rows.sparkSession)
    postings.write_statistics(postings.term_counts(lost, BUCKETS, -1), terms, top)
    terms, dfs = terms.unionByName(postings.united(rows.sparkSession, [f"{top}/terms"])), dfs.unionByName(postings.united(rows.sparkSession, [f"{top}/dfs"]))
    live = lambda d: d.join(search.near(gone), "doc_id", "left_anti")
    n, length = n - dead.count(), length - (lost.agg(F.sum("tf")).first()[0] or 0)
    return postings.bm25(rows, terms, dfs, n, length, _items(t), "doc_id", 5, BUCKETS, live).select("qid", long("rank").alias("rank"), "doc_id", r6("score"))


@query(f"""with {BM25} select doc_id, dl::bigint as n_tokens, len(list_distinct(t))::bigint as n_terms from dt join dl using (doc_id)""")
def token_counts(t):
    w = T.tokens(F.col("text"))
    return t("documents").select("doc_id", long(F.size(w)).alias("n_tokens"), long(F.size(F.array_distinct(w))).alias("n_terms"))


# -- dense search ----------------------------------------------------------------------------

VEC = """
v as (select vec_id, label, embedding::double[] as e from embeddings),
q as (select vec_id as qid, e as q, label as qlabel from v where vec_id % 50 = 0)
"""


def _topk(name: str, q: str, k: int) -> str:
    return f"""{name} as (select * from (select qid, vec_id, score, row_number() over (partition by qid order by round(score, 9) desc, vec_id) as rank
  from (select qid, vec_id, list_inner_product(q, e) as score from v, {q})) where rank <= {k})"""


DENSE20 = f"{VEC}, {_topk('hits', 'q', 20)}"


def _vectors(t) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries every one whose id is divisible by 50."""
    v = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("qlabel"))


def _shifted(t, by: int) -> DataFrame:
    """The query set with the vector of the id ``by`` further on."""
    v, q = _vectors(t)
    other = v.select((F.col("vec_id") - by).alias("qid"), F.col("embedding").alias("q"))
    return q.select("qid").join(other, "qid")


def _hits(t, k: int) -> DataFrame:
    v, q = _vectors(t)
    return search.dense(v, q, "vec_id", k)


def _q(by: int) -> str:
    return f"q{by} as (select vec_id - {by} as qid, e as q from v where (vec_id - {by}) % 50 = 0 and vec_id - {by} in (select qid from q))"


@query(f"with {DENSE20} select qid, rank, vec_id, round(greatest(0, least(1, score)), 6) as similarity from hits")
def dense_topk(t):
    return _hits(t, 20).select("qid", long("rank").alias("rank"), "vec_id", r6(V.similarity(F.col("score")), "similarity"))


@query(SQL["dense_topk"])
def clustered_topk(t):
    """``dense_topk`` from vectors in cells; cells whose bound reaches no query's 20th best score are not read."""
    v, q = _vectors(t)
    index = clustered.Clustered(v.sparkSession, scratch(v.sparkSession))
    index.build(v, "vec_id", cells=32)
    return index.search(q, "vec_id", 20).select("qid", long("rank").alias("rank"), "vec_id", r6(V.similarity(F.col("score")), "similarity"))


@query("""with v as (select vec_id, embedding::double[] as e from embeddings), n as (select vec_id, e, sqrt(list_inner_product(e, e)) as n from v)
select vec_id, round(n, 6) as norm, round(list_sum(list_transform(e, lambda x: x / n)), 6) as total from n""")
def l2_normalized(t):
    e = F.col("embedding").cast("array<double>")
    d = t("embeddings").select("vec_id", V.normalized(e).alias("u"), F.sqrt(V.dot(e, e)).alias("norm"))
    return d.select("vec_id", r6("norm"), r6(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), "total"))


HYDE = "h as (select q.qid, list_transform(list_zip(q.q, q1.q), lambda x: (x[1] + x[2]) / 2) as q from q join q1 using (qid))"


@query(f"with {VEC}, {_q(1)}, {HYDE}, {_topk('hits', 'h', 10)} select qid, rank, vec_id, round(score, 6) as score from hits")
def hyde_topk(t):
    v, q = _vectors(t)
    both = q.select("qid", "q").join(_shifted(t, 1).withColumnRenamed("q", "q2"), "qid").select("qid", V.mean_of(F.col("q"), F.col("q2")).alias("q"))
    return search.dense(v, both, "vec_id", 10).select("qid", long("rank").alias("rank"), "vec_id", r6("score"))


RRF = """fused as (select qid, vec_id, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as score, greatest(0, least(1, coalesce(a.score, 0))) as similarity
  from ha a full join hb b using (qid, vec_id))"""


@query(f"""with {VEC}, {_q(1)}, {_topk('ha', 'q', 20)}, {_topk('hb', 'q1', 20)}, {RRF}
select * from (select qid, row_number() over (partition by qid order by round(score, 9) desc, vec_id) as rank, vec_id, round(score, 6) as score, round(similarity, 6) as similarity from fused) where rank <= 20""")
def rrf_fusion(t):
    v, q = _vectors(t)
    out = search.fused(search.dense(v, q, "vec_id", 20), search.dense(v, _shifted(t, 1), "vec_id", 20), "vec_id", 20)
    return out.select("qid", long("rank").alias("rank"), "vec_id", r6("score"), r6("similarity"))


BAG = """
{d}_c as (select {key} as k, ('0x' || substr(md5(term), 1, 4))::int % 64 as dim, count(*)::double as c from (select {key}, unnest({tok}) as term from {d}) group by all),
{d}_m as (select k, map_from_entries(list((dim, c))) as m, sqrt(sum(c * c)) as n from {d}_c group by k),
{d}_v as (select k, list_transform(range(64), lambda i: coalesce(m[i::int], 0) / n) as e from {d}_m)"""


def _bag_sql(d: str, key: str) -> str:
    return BAG.format(d=d, key=key, tok=TOK)


def bag_vectors(df: DataFrame, key: str) -> DataFrame:
    """(key, embedding): a stand-in embedder as an Arrow UDF, normalised counts of hashed words in 64 dimensions."""

    @F.arrow_udf("array<double>")
    def embed(words: pa.Array) -> pa.Array:
        each = words.flatten().dictionary_encode()
        slot = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 for w in each.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        c = np.bincount(row * 64 + slot[each.indices.to_numpy()] if len(row) else [], minlength=len(words) * 64).reshape(-1, 64).astype(float)
        unit = c / np.sqrt((c * c).sum(axis=1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, 64), pa.int32()), pa.array(unit.ravel()))

    w = T.tokens(F.col("text"))
    return small_batches(df.where(F.size(w) > 0)).select(key, embed(w).alias("embedding"))


@query(f"""with {BM25}, {_bag_sql('documents', 'doc_id')}, {_bag_sql('benchmark', 'item_id')},
den as (select * from (select q.k as qid, d.k as doc_id, list_inner_product(q.e, d.e) as score, row_number() over (partition by q.k order by round(list_inner_product(q.e, d.e), 9) desc, d.k) as rank
  from documents_v d, benchmark_v q) where rank <= 20),
fused as (select qid, doc_id, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as score, greatest(0, least(1, coalesce(a.score, 0))) as similarity
  from den a full join lex b using (qid, doc_id))
select * from (select qid, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as rank, doc_id, round(score, 6) as score, round(similarity, 6) as similarity from fused) where rank <= 20""")
def hybrid_search(t):
    docs, items = t("documents").select("doc_id", "text"), _items(t)
    den = search.dense(bag_vectors(search.spread(docs), "doc_id"), bag_vectors(items, "qid").withColumnRenamed("embedding", "q"), "doc_id", 20)
    out = search.fused(den, search.bm25(docs, items, "doc_id", 20), "doc_id", 20)
    return out.select("qid", long("rank").alias("rank"), "doc_id", r6("score"), r6("similarity"))


@query(f"""with {BM25.replace("where rank <= 20)", ")")}, {_bag_sql('documents', 'doc_id')}, {_bag_sql('benchmark', 'item_id')},
s as (select source, row_number() over (order by source) - 1 as i, count(*) as own from documents where source is not null group by source),
b as (select item_id as qid, source as src, least((select count(*) from documents), greatest(15, floor(5 / (own::double / (select count(*) from documents))))) as budget from benchmark join s on i = item_id % (select count(*) from s)),
den as (select q.k as qid, d.k as doc_id, list_inner_product(q.e, d.e) as score, row_number() over (partition by q.k order by round(list_inner_product(q.e, d.e), 9) desc, d.k) as rank from documents_v d, benchmark_v q),
fused as (select qid, doc_id, coalesce(1.0::double / (60 + a.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as score
  from (select den.* from den join b using (qid) where rank <= budget) a full join (select lex.* from lex join b using (qid) where rank <= budget) b using (qid, doc_id)),
r as (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as pos from fused)
select * from (select qid, row_number() over (partition by qid order by pos) as rank, r.doc_id, round(score, 6) as score from r join b using (qid) join documents d on d.doc_id = r.doc_id where pos <= budget and d.source = src) where rank <= 5""")
def scoped_hybrid(t):
    """Hybrid search within one source of each query, by ranks counted up to its budget: a task hands on no more hits of a query than that."""
    docs, items = t("documents").select("doc_id", "source", "text"), _items(t)
    own = incremental.numbered(docs.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("own")), ["source"], "i").withColumn("i", F.col("i") - 1)
    n = docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(own.agg(F.count(F.lit(1)).alias("sources")))
    b = items.select("qid").crossJoin(F.broadcast(n)).join(own, F.col("qid") % F.col("sources") == F.col("i"))
    b = kept(b.select("qid", F.col("source").alias("doc"), search.scoped_budget(F.col("own"), F.col("n"), 5).cast("long").alias("budget")))
    limited = lambda d: d.join(search.near(b.select("qid", "budget")), "qid")
    dense = search.dense(bag_vectors(search.spread(docs.select("doc_id", "text")), "doc_id"), limited(bag_vectors(items, "qid").withColumnRenamed("embedding", "q")), "doc_id", "budget")
    rows, terms, dfs, chunks, length = _segments(t, [F.lit(True)])
    lexical = postings.bm25(rows, terms, dfs, chunks, length, limited(items), "doc_id", "budget", BUCKETS)
    out = search.scoped_fused(dense, lexical, b, docs.select("doc_id", F.col("source").alias("doc")), "doc_id", 5, kept)
    return out.select("qid", long("rank").alias("rank"), "doc_id", r6("score"))


@query(f"""with {VEC}, n as (select label, count(*) as k, sum(count(*)) over () as n from v group by label),
b as (select qid, q, qlabel, least(n, greatest(15, floor(5 / (k::double / n)))) as budget from q join n on qlabel = label),
r as (select qid, qlabel, budget, vec_id, label, score, row_number() over (partition by qid order by round(score, 9) desc, vec_id) as pos
  from (select qid, qlabel, budget, vec_id, label, list_inner_product(q, e) as score from v, b))
select * from (select qid, row_number() over (partition by qid order by pos) as rank, vec_id, round(score, 6) as score from r where pos <= budget and label = qlabel) where rank <= 5""")
def search_by_document(t):
    v, q = _vectors(t)
    n = v.groupBy("label").agg(F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(v.agg(F.count(F.lit(1)).alias("n"))))
    b = q.join(n, F.col("qlabel") == F.col("label")).select("qid", "q", F.col("qlabel").alias("label"), search.scoped_budget(F.col("k"), F.col("n"), 5).cast("long").alias("budget"))
    return search.scoped(v, b, "vec_id", 5, "label").select("qid", long("rank").alias("rank"), "vec_id", r6("score"))


@query(f"""with {DENSE20} select * from (select qid, row_number() over (partition by qid order by (vec_id * 7919 % 1009) desc, rank) as rank, vec_id, (vec_id * 7919 % 1009)::bigint as rerank_score from hits) where rank <= 5""")
def rerank_topk(t):
    out = search.reranked(_hits(t, search.over_fetch(5, 1 << 30, True)), F.col("vec_id") * 7919 % 1009, 5, "vec_id")
    return out.select("qid", long("rank").alias("rank"), "vec_id", long("rerank_score").alias("rerank_score"))


_SUBS = ", ".join([_topk("s0", "q", 10), _topk("s1", "q1", 10), _topk("s2", "q2", 10)])


@query(f"""with {VEC}, {_q(1)}, {_q(2)}, {_SUBS},
a as (select *, 0 as sub from s0 union all select *, 1 from s1 union all select *, 2 from s2),
m as (select * from (select *, row_number() over (partition by qid, vec_id order by round(score, 9) desc, sub, rank) as r from a) where r = 1)
select qid, row_number() over (partition by qid order by round(score, 9) desc, vec_id) as rank, vec_id, sub::bigint as sub, round(score, 6) as score from m""")
def merge_hits(t):
    v, q = _vectors(t)
    subs = [search.dense(v, s, "vec_id", 10).withColumn("sub", F.lit(i)) for i, s in enumerate([q, _shifted(t, 1), _shifted(t, 2)])]
    out = search.merged(subs[0].unionByName(subs[1]).unionByName(subs[2]), "vec_id")
    return out.select("qid", long("rank").alias("rank"), "vec_id", long("sub").alias("sub"), r6("score"))


@query(f"""with {VEC}, {_q(1)}, {_topk('h', 'q1', 5)} select qid, round(max(greatest(0, least(1, score))), 6) as best, max(greatest(0, least(1, score))) >= 0.45 as covered from h group by qid""")
def coverage_gate(t):
    v, _ = _vectors(t)
    hits = search.dense(v, _shifted(t, 1), "vec_id", 5).withColumn("similarity", V.similarity(F.col("score")))
    return search.covered(hits).select("qid", r6("best"), "covered")


# -- metrics ---------------------------------------------------------------------------------

METRICS = f"""{DENSE20}, rel as (select qid, vec_id from q join v on label = qlabel), nr as (select qid, count(*) as n from rel group by qid),
h as (select h.qid, h.rank, (r.vec_id is not null)::int as hit from hits h left join rel r using (qid, vec_id)),
g as (select qid, sum(hit) filter (rank <= 5) as found, min(rank) filter (hit = 1) as first, coalesce(sum(1 / log2(rank + 1)) filter (rank <= 5 and hit = 1), 0) as dcg from h group by qid),
m as (select qid, found / 5.0::double as p, found / n::double as r, coalesce(1.0::double / first, 0) as mrr,
  dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) as ndcg from g join nr using (qid)),
per as (select qid, p as precision, r as recall, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1, mrr, ndcg from m)"""


def _per(t) -> DataFrame:
    v, q = _vectors(t)
    hits = _hits(t, 20).join(q.select("qid", "qlabel"), "qid").join(v.select("vec_id", "label"), "vec_id")
    size = q.join(v.groupBy("label").agg(F.count(F.lit(1)).alias("n_rel")), F.col("label") == F.col("qlabel")).select("qid", "n_rel")
    return evaluation.per_query_hits(hits.withColumn("hit", (F.col("label") == F.col("qlabel")).cast("int")), size, 5)


@query(f"with {METRICS} select qid, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from per")
def precision_recall_f1(t):
    return _per(t).select("qid", r6("precision"), r6("recall"), r6("f1"))


@query(f"with {METRICS} select qid, round(mrr, 6) as mrr from per")
def mrr(t):
    return _per(t).select("qid", r6("mrr"))


@query(f"with {METRICS} select qid, round(ndcg, 6) as ndcg from per")
def ndcg(t):
    return _per(t).select("qid", r6("ndcg"))


@query(f"""with {METRICS} select count(*) as n, round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, round(avg(mrr), 6) as mrr,
round(avg(ndcg), 6) as ndcg, round(quantile_cont(ndcg, 0.95), 6) as p95_ndcg from per""")
def eval_aggregate(t):
    d = _per(t)
    return d.agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c), c) for c in ("precision", "recall", "f1", "mrr", "ndcg")), r6(evaluation.percentile("ndcg", 95), "p95_ndcg"))


@query(f"""with {DENSE20}, s as (select *, greatest(0, least(1, score)) as similarity, (vec_id * 7919 % 1009)::double as rs from hits)
select qid, count(*) as num_results, round(avg(similarity), 6) as avg_similarity, round(arg_min(similarity, rank), 6) as top_similarity, round(avg(rs), 6) as avg_rerank_score, round(arg_min(rs, rank), 6) as top_rerank_score from s group by qid""")
def log_rows(t):
    hits = _hits(t, 20).withColumn("similarity", V.similarity(F.col("score"))).withColumn("rerank_score", (F.col("vec_id") * 7919 % 1009).cast("double"))
    return evaluation.log_rows(hits).select("qid", "num_results", *(r6(c) for c in ("avg_similarity", "top_similarity", "avg_rerank_score", "top_rerank_score")))


# -- query log (events: type as query, value as latency) ---------------------------------------

LOG = """log as (select ts as timestamp, event_type as query, value as latency_ms, (user_id % 20)::double as num_results, value < 10 as cache_hit,
  value / 100 as avg_similarity, case when value > 20 then value / 50 end as avg_rerank_score from events)"""
TODAY = "2024-01-31"


def _log(t) -> DataFrame:
    v = F.col("value")
    return t("events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("query"), v.alias("latency_ms"), (F.col("user_id") % 20).cast("double").alias("num_results"),
        (v < 10).alias("cache_hit"), (v / 100).alias("avg_similarity"), F.when(v > 20, v / 50).alias("avg_rerank_score"),
    )


def _stats_sql(days: int) -> str:
    return f"""with {LOG}, d as (select * from log where timestamp::date >= date '{TODAY}' - {days})
select count(*) as total_queries, round(coalesce(avg(latency_ms), 0), 6) as avg_latency_ms, round(coalesce(avg(num_results), 0), 6) as avg_results, round(coalesce(avg(avg_similarity), 0), 6) as avg_similarity,
round(coalesce(avg(avg_rerank_score), 0), 6) as avg_rerank_score, (count(*) filter (cache_hit))::bigint as cache_hits, count(distinct query) as unique_queries,
round(coalesce((count(*) filter (cache_hit))::double / nullif(count(*), 0), 0), 6) as cache_hit_rate from d"""


def _stats(t, days: int) -> DataFrame:
    d = evaluation.query_stats(_log(t), TODAY, days)
    return d.select(*(r6(c) if k == "double" else F.col(c) for c, k in d.dtypes))


@query(_stats_sql(7))
def query_stats_7d(t):
    return _stats(t, 7)


@query(_stats_sql(30))
def query_stats_30d(t):
    return _stats(t, 30)


@query(f"""with {LOG} select query, count(*) as n, round(avg(latency_ms), 6) as avg_latency_ms, round(avg(avg_similarity), 6) as avg_similarity from log group by query order by n desc, query limit 10""")
def top_queries(t):
    return evaluation.top_queries(_log(t), 10).select("query", "n", r6("avg_latency_ms"), r6("avg_similarity"))


@query(f"""with {LOG} select query, round(avg(latency_ms), 6) as mean, round(median(latency_ms), 6) as median, round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99,
round(min(latency_ms), 6) as min, round(max(latency_ms), 6) as max, round(avg(cache_hit::int), 6) as cache_hit_rate from log group by query""")
def latency_distribution(t):
    d = _log(t).groupBy("query").agg(*evaluation.distribution("latency_ms"), F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"))
    return d.select("query", *(r6(c) for c in d.columns[1:]))


@query(_stats_sql(7))
def rollup_stats_7d(t):
    """``query_stats_7d`` from daily sums."""
    d = rollups.query_stats(rollups.daily(_log(t)), TODAY, 7)
    return d.select(*(r6(c) if k == "double" else F.col(c) for c, k in d.dtypes))


@query(SQL["top_queries"])
def rollup_top_queries(t):
    return rollups.top_queries(rollups.daily(_log(t)), 10).select("query", "n", r6("avg_latency_ms"), r6("avg_similarity"))


@query(f"""with {LOG}, k as (select query as key, latency_ms from log union all select 'all', latency_ms from log)
select key, round(quantile_cont(latency_ms, 0), 6) as p0, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99,
round(quantile_cont(latency_ms, 1), 6) as p100 from k group by key""")
def latency_percentiles(t):
    """Exact percentiles by rank selection, of each query and of all rows under one key."""
    log = _log(t).select(F.col("query").alias("key"), "latency_ms")
    rows = log.unionByName(log.withColumn("key", F.lit("all")))
    out = rollups.percentiles(rows, "key", "latency_ms", [0.0, 0.5, 0.95, 0.99, 1.0], kept, leaves=1000)
    return out.select("key", *(r6(F.get("percentiles", i), f"p{p}") for i, p in enumerate((0, 50, 95, 99, 100))))


@query("""with f as (select 1 + 3 * quality + (1 - toxic) as rating from labels)
select count(*) as total, round(coalesce(avg(rating), 0), 6) as avg_rating, count(*) filter (rating >= 4) as positive, count(*) filter (rating <= 2) as negative, round(coalesce((count(*) filter (rating >= 4))::double / nullif(count(*), 0), 0), 6) as satisfaction from f""")
def feedback_stats(t):
    d = evaluation.feedback_stats(t("labels").select((1 + 3 * F.col("quality") + (1 - F.col("toxic"))).alias("rating")))
    return d.select("total", r6("avg_rating"), "positive", "negative", r6("satisfaction"))


@query(f"""with {LOG} select query as pipeline, round(avg(case when latency_ms > 20 then avg_similarity end), 6) as quality, round(avg(latency_ms), 6) as avg_latency_ms,
round(quantile_cont(latency_ms, 0.5), 6) as p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms from log group by query""")
def scorecard(t):
    rows = _log(t).withColumn("quality", F.when(F.col("latency_ms") > 20, F.col("avg_similarity")).otherwise(F.lit(float("nan")))).withColumnRenamed("query", "pipeline")
    d = evaluation.scorecard(rows, ["quality"])
    return d.select("pipeline", *(r6(c) for c in d.columns[1:]))


@query("""select source, round(coalesce(avg(quality), 0), 6) as ratio, case when max(toxic) > 0 then 'low' when coalesce(avg(quality), 0) >= 0.95 and 'high' = 'high' then 'high' when coalesce(avg(quality), 0) >= 0.75 then 'medium' else 'low' end as confidence
from labels join documents using (doc_id) group by source""")
def claim_confidence(t):
    checks = t("labels").join(t("documents").select("doc_id", "source"), "doc_id").withColumn("supported", F.col("quality") == 1)
    ratio = evaluation.supported_ratio(checks, "source")
    bad = checks.groupBy("source").agg(F.collect_set(F.when(F.col("toxic") > 0, F.lit("x"))).alias("mismatches"))
    return ratio.join(bad, "source").select("source", r6("ratio"), T.confidence(F.lit("high"), F.col("ratio"), F.col("mismatches")).alias("confidence"))


@query("select role, count(*) as calls, sum(length(text))::bigint as chars from conversations group by role")
def usage_totals(t):
    none = F.lit(0).cast("long")
    d = t("conversations").select("role", F.struct(F.lit(1).alias("calls"), F.length("text").alias("prompt_tokens"), none.alias("completion_tokens")).alias("usage"))
    return d.groupBy("role").agg(models.total_usage("usage").alias("u")).select("role", "u.calls", F.col("u.prompt_tokens").alias("chars"))


# -- text, chunks, context -----------------------------------------------------------------------

SENTENCES = r"""
s0 as (select doc_id, text as x from documents),
s1 as (select doc_id, regexp_replace(x, '\n\s*\n', chr(1), 'g') as x from s0),
s2 as (select doc_id, regexp_replace(regexp_replace(x, '\n(\d+[.)][\s\x01])', chr(1) || '\1', 'g'), '\n(\d+[.)][\s\x01])', chr(1) || '\1', 'g') as x from s1),
s3 as (select doc_id, regexp_replace(regexp_replace(x, '\n([A-Z])', chr(1) || '\1', 'g'), '([.!?])\s+', '\1' || chr(1), 'g') as x from s2),
sen as (select doc_id, list_filter(list_transform(string_split(x, chr(1)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') as s from s3)
"""


@query(f"with {SENTENCES} select doc_id, (unnest(range(len(s))))::bigint as pos, unnest(s) as sentence from sen")
def sentences(t):
    return t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", long("pos").alias("pos"), "sentence")


PAGES = [("a", "1.2 Scope of use\nbody\nSAFETY RULES\n12. not a header"), ("b", "STEP 3: Open it\n  Procedure 4. Close it  \nStep 5: no\nTOO\n3 Nothing"), ("c", "")]


@query("""select 'doc' || (doc_id::varchar) as doc_name, 0::bigint as char_offset, '' as header from documents where false
union all values ('a', 0::bigint, '1.2 Scope of use'), ('a', 22::bigint, 'SAFETY RULES'), ('b', 0::bigint, 'STEP 3: Open it'), ('b', 16::bigint, 'Procedure 4. Close it')
union all select 'doc' || (doc_id::varchar), (length(array_to_string(l[1:i - 1], chr(10))) + (i > 1)::int)::bigint, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))
where regexp_matches(regexp_replace(l[i], '^\\s+|\\s+$', '', 'g'), '{headers}')""".replace("\\\\", "\\").replace("{headers}", "|".join(T.HEADERS)))
def section_headers(t):
    docs = t("documents")
    own = docs.sparkSession.createDataFrame(PAGES, "doc_name string, text string")
    pages = docs.select(F.concat(F.lit("doc"), "doc_id").alias("doc_name"), "text").unionByName(own)
    lines = pages.select("doc_name", F.split("text", "\n").alias("l")).select("doc_name", "l", F.posexplode("l").alias("i", "line"))
    at = F.length(F.array_join(F.expr("slice(l, 1, i)"), "\n")) + (F.col("i") > 0).cast("int")
    return lines.where(T.is_header(T.strip(F.col("line")))).select("doc_name", long(at).alias("char_offset"), T.strip(F.col("line")).alias("header"))


PACKED = f"""with recursive {SENTENCES}, p as (select doc_id, s, len(s) as n, list_prepend(0, list_transform(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[1:i], lambda y: length(y) + 1))))::bigint[] as p from sen where len(s) > 0),
w as (
  select doc_id, 0::bigint as ord, 0::bigint as st, coalesce(list_max(list_filter(range(0, n), lambda k: p[k + 2] <= 800)), 0)::bigint as e from p
  union all
  select doc_id, ord + 1, t, greatest(e + 1, coalesce(list_max(list_filter(range(e + 1, n), lambda k: p[k + 2] - p[t + 1] <= 800)), e + 1))::bigint
  from (select doc_id, ord, e, n, p, case when p[e + 3] - p[t0 + 1] > 800 then e + 1 else t0 end as t from
    (select w.doc_id, ord, e, n, p, coalesce(list_min(list_filter(range(st, e + 1), lambda j: p[e + 2] - p[j + 1] <= 200)), e + 1) as t0 from w join p using (doc_id) where e + 1 < n)))"""


@query(f"""{PACKED}
select doc_id || '_p1_c' || ord as chunk_id, ord, st as first, e as last, array_to_string(s[st + 1:e + 1], ' ') as text from w join p using (doc_id)""")
def chunks(t):
    pages = t("documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.lit(1).alias("page"), "text")
    return chunking.chunks(pages).select("chunk_id", long("ord").alias("ord"), long("first").alias("first"), long("last").alias("last"), "text")


#: Texts between two headers, by SQL and by expressions.
HEADED = "(select doc_id, 'INTRO PART' || chr(10) || coalesce(text, '') || chr(10) || 'FINAL PART' || chr(10) || 'It ends here.' as text from documents)"


@query(f"""{PACKED.replace('from documents)', f'from {HEADED})')}
select doc_id || '_p1_c' || ord as chunk_id, case when st >= len(s) - 2 then 'FINAL PART' else 'INTRO PART' end as section from w join p using (doc_id)""")
def chunk_sections(t):
    text = F.concat(F.lit("INTRO PART\n"), F.coalesce("text", F.lit("")), F.lit("\nFINAL PART\nIt ends here."))
    pages = t("documents").select(F.col("doc_id").cast("string").alias("doc_name"), F.lit(1).alias("page"), text.alias("text"))
    return chunking.chunks(pages).select("chunk_id", "section")


@query(r"""with recursive l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents),
p as (select doc_id, l, len(l) as n, list_prepend(0, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda y: length(y) + 1))))::bigint[] as p from l where len(l) > 0),
w as (select doc_id, 1::bigint as page, 0::bigint as st, coalesce(list_min(list_filter(range(0, n), lambda k: p[k + 2] >= 3000)), n - 1)::bigint as e from p
  union all select w.doc_id, page + 1, e + 1, coalesce(list_min(list_filter(range(e + 1, n), lambda k: p[k + 2] - p[e + 2] >= 3000)), n - 1)::bigint from w join p using (doc_id) where e + 1 < n)
select doc_id, page, array_to_string(l[st + 1:e + 1], chr(10)) as text from w join p using (doc_id)""")
def virtual_pages(t):
    return chunking.virtual_pages(t("documents"), "doc_id").select("doc_id", long("page").alias("page"), "text")


@query("""select doc_id, md5(array_to_string(list_filter([source || ' > ' || lang, case when n_chars > 2000 then 'long' else '' end, case when quality = 1 then 'Questions answered: what ' || lang else '' end, text], lambda x: x <> ''), chr(10))) as digest
from documents left join labels using (doc_id)""")
def embedding_text(t):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    summary = F.when(F.col("n_chars") > 2000, "long").otherwise("")
    asked = F.when(F.col("quality") == 1, F.array(F.lit("what"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    return d.select("doc_id", F.md5(T.embedding_text(F.col("source"), F.col("lang"), summary, asked, F.col("text"))).alias("digest"))


@query("""with b as (select source as qid, lang as doc_name, doc_id, '[Source: ' || lang || ', Page ' || doc_id || ', Section: N/A, id: d' || doc_id || '_p1_c0]' || chr(10) || text as b from documents),
w as (select *, row_number() over o as n, sum(length(b)) over (o rows unbounded preceding) as total from b window o as (partition by qid order by doc_name, doc_id))
select qid, count(*) as n_blocks, md5(string_agg(b, chr(10) || chr(10) order by n)) as digest from w where total <= 12000 or n = 1 group by qid""")
def assemble_context(t):
    c = t("documents").select(F.col("source").alias("qid"), F.col("lang").alias("doc_name"), F.col("doc_id").cast("string").alias("page"), F.lit("").alias("section"), F.concat(F.lit("d"), "doc_id", F.lit("_p1_c0")).alias("chunk_id"), "text")
    return context.assembled(c).select("qid", "n_blocks", F.md5("context").alias("digest"))


def _values(text: str) -> str:
    found = f"regexp_replace(split_part({text}, 'References', 1), '\\[\\^\\d+\\]', ' ', 'g')"
    return "list_distinct(list_filter(list_concat(" + ", ".join(f"regexp_extract_all({found}, '{p}')" for p in T.VALUES) + "), lambda x: length(x) > 1))"


@query(f"select doc_id, unnest({_values('text')}) as value from documents")
def value_tokens(t):
    return t("documents").select("doc_id", F.explode(T.value_tokens(T.answer_body(F.col("text")))).alias("value"))


@query(f"""with x as (select doc_id, {_values('text')} as v, regexp_replace(text[1:length(text) // 2], '\\s+', ' ', 'g') as src from documents)
select doc_id, round(len(list_filter(v, lambda y: contains(src, y)))::double / nullif(len(v), 0), 6) as grounding, len(list_filter(v, lambda y: not contains(src, y)))::bigint as mismatches from x where len(v) > 0""")
def grounding(t):
    half = F.expr("substring(text, 1, length(text) div 2)")
    d = t("documents").select("doc_id", F.inline(T.values_checked(F.col("text"), half))).where("n > 0")
    bad = F.size("mismatches")
    return d.select("doc_id", r6((F.col("n") - bad) / F.col("n"), "grounding"), long(bad).alias("mismatches"))


_MARKERS = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in T.ABSTAINS) + "]"
ANSWERS = r"""ans as (select a.conv_id, a.turn, a.text as answer, list_filter(regexp_split_to_array(lower(u.text), '\s+'), lambda x: x <> '')[1:3] as facts
  from conversations a join conversations u on a.conv_id = u.conv_id and u.turn = a.turn - 1 where a.role = 'assistant')"""


def _answers(t) -> DataFrame:
    c = t("conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.slice(T.tokens(F.col("text")), 1, 3).alias("facts"))
    return c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(u, ["conv_id", "turn"])


@query(rf"with {ANSWERS} select conv_id, turn, len(list_filter({_MARKERS}, lambda m: contains(lower(regexp_replace(answer, '\s+', ' ', 'g')), m))) > 0 as abstained from ans")
def abstained(t):
    return _answers(t).select("conv_id", "turn", T.abstained(F.col("answer")).alias("abstained"))


@query(rf"with {ANSWERS} select conv_id, turn, round(len(list_filter(facts, lambda f: contains(lower(regexp_replace(answer, '\s+', ' ', 'g')), f)))::double / nullif(len(facts), 0), 6) as coverage from ans")
def fact_coverage(t):
    return _answers(t).select("conv_id", "turn", r6(T.fact_coverage(F.col("answer"), F.col("facts")), "coverage"))


@query(rf"""with {ANSWERS}, x as (select conv_id, turn, facts as cited, [facts[1] || 's', 'the', facts[3]] as must from ans where len(facts) = 3)
select conv_id, turn, round(len(list_filter(must, lambda m: len(list_filter(cited, lambda c: contains(c, m) or contains(m, c))) > 0))::double / 3, 6) as recall,
round(len(list_filter(cited, lambda c: list_contains(must, c)))::double / 3, 6) as validity from x""")
def must_cite(t):
    d = _answers(t).where("size(facts) = 3").select("conv_id", "turn", "facts", F.array(F.concat(F.col("facts")[0], F.lit("s")), F.lit("the"), F.col("facts")[2]).alias("must"))
    return d.select("conv_id", "turn", r6(T.must_cite_recall(F.col("facts"), F.col("must")), "recall"), r6(T.citation_validity(F.col("facts"), F.col("must")), "validity"))


# -- citations and cross references, made from documents -----------------------------------------


def _cited(t) -> tuple[DataFrame, DataFrame]:
    d = t("documents")
    answer = F.concat(F.lit("Text [^1] and [^2].\n[^3]: unknown, Page 4\n[^1]: "), "source", F.lit(", Page 1 (id: "), "source", F.lit("_p1_c0)\n[^2]: "), "lang", F.lit(", Page 2\n[^1]: "), "lang", F.lit(", Page 3"))
    one = lambda o, doc, page: F.struct(F.lit(o).alias("ord"), F.concat(F.col(doc), F.lit(f"_p{page}_c0")).alias("chunk_id"), F.col(doc).alias("doc_name"), F.lit(page).alias("page"), F.lit("s").alias("section"))
    c = d.select(F.col("doc_id").alias("qid"), F.inline(F.array(one(0, "source", 1), one(1, "lang", 2), one(2, "lang", 3))))
    return d.select(F.col("doc_id").alias("qid"), answer.alias("answer")), c


@query("""select doc_id as qid, unnest([1, 2, 3, 4])::bigint as pos, unnest([3, 1, 2, 1])::bigint as marker, unnest(['unknown, Page 4', source || ', Page 1', lang || ', Page 2', lang || ', Page 3']) as label, unnest(['', source || '_p1_c0', '', '']) as ref_id from documents""")
def parse_references(t):
    return context.references(_cited(t)[0]).select("qid", long("pos").alias("pos"), long("marker").alias("marker"), "label", "ref_id")


@query("select doc_id as qid, unnest([1, 2])::bigint as marker, unnest([source || '_p1_c0', lang || '_p2_c0']) as chunk_id from documents")
def resolve_citations(t):
    answers, c = _cited(t)
    return context.resolved(context.references(answers), c).select("qid", long("marker").alias("marker"), "chunk_id")


@query("select doc_id as qid, unnest([1, 2])::bigint as marker, unnest([source || '_p1_c0', lang || '_p2_c0']) as chunk_id from documents")
def resolve_plain_citations(t):
    answers, c = _cited(t)
    return context.plain_resolved(context.plain_references(answers), c).select("qid", long("marker").alias("marker"), "chunk_id")


@query("""with c as (select 'c' || doc_id as chunk_id, source as doc_name, (n_chars % 30) || '.' || (doc_id % 3) || ' Part' as section, 'as in Section ' || (n_chars % 7) || ' here' as text, lang from documents),
r as (select distinct doc_name, regexp_extract(text, 'Section (\\d+)', 1) as ref from c where lang = 'fr')
select chunk_id, section from c where lang <> 'fr' and exists (select 1 from r where r.doc_name = c.doc_name and starts_with(c.section, ref))""".replace("\\\\", "\\"))
def xref_sections(t):
    d = t("documents")
    c = d.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("doc_name"), F.concat((F.col("n_chars") % 30).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"), F.lit(" Part")).alias("section"), F.concat(F.lit("as in Section "), (F.col("n_chars") % 7).cast("string"), F.lit(" here")).alias("text"), "lang")
    return context.referenced(c.where("lang = 'fr'").drop("lang").withColumn("qid", F.lit(1)), c.drop("lang")).select("chunk_id", "section")


@query("""with c as (select doc_id, doc_id % 7 as qid, 'c' || doc_id as chunk_id, source as doc_name, (n_chars % 30) || '.' || (doc_id % 3) || ' Part' as section, 'as in Section ' || (n_chars % 7) || case when n_chars % 2 = 0 then '.' || (doc_id % 3) else '' end || ' here' as text, lang from documents),
h as (select * from c where lang <> 'en'), r as (select distinct qid, doc_name, regexp_extract(text, 'Section ([0-9.]+[0-9]|[0-9])', 1) as ref from h)
select distinct r.qid, c.chunk_id, c.section from c join r on r.doc_name = c.doc_name and starts_with(c.section, r.ref) where not exists (select 1 from h where h.qid = r.qid and h.chunk_id = c.chunk_id)""")
def xref_by_query(t):
    part = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("."), (F.col("doc_id") % 3).cast("string"))).otherwise("")
    section = F.concat((F.col("n_chars") % 30).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"), F.lit(" Part"))
    text = F.concat(F.lit("as in Section "), (F.col("n_chars") % 7).cast("string"), part, F.lit(" here"))
    c = t("documents").select((F.col("doc_id") % 7).alias("qid"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("doc_name"), section.alias("section"), text.alias("text"), "lang")
    return context.referenced(c.where("lang <> 'en'").drop("lang"), c.drop("lang", "qid")).select("qid", "chunk_id", "section")


# -- index upkeep ----------------------------------------------------------------------------------


@query("""with m as (select doc_id, n_chars as size from documents where lang <> 'de'), c as (select doc_id, case when source = 'src0' then n_chars + 1 else n_chars end as size from documents where lang <> 'es')
select 'd' || coalesce(c.doc_id, m.doc_id) as name, case when m.doc_id is null then 'new' when c.doc_id is null then 'deleted' when c.size <> m.size then 'modified' else 'unchanged' end as change from c full join m on c.doc_id = m.doc_id""")
def detect_changes(t):
    d = t("documents").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.lit(0).alias("mtime"), F.col("n_chars").alias("size"), "lang", "source")
    now = d.where("lang <> 'es'").withColumn("size", F.when(F.col("source") == "src0", F.col("size") + 1).otherwise(F.col("size")))
    return incremental.changes(now, d.where("lang <> 'de'"))


@query("""with i as (select doc_id, source, row_number() over (order by doc_id) - 1 as ord from documents where lang = 'en')
select doc_id, ord from i union all select doc_id, (select coalesce(max(ord), -1) from i) + row_number() over (order by source, doc_id) as ord from documents where lang = 'fr'""")
def incremental_append(t):
    d = t("documents").select("doc_id", "source", "lang")
    en = d.where("lang = 'en'").drop("lang")
    empty = en.where("false").withColumn("ord", F.lit(0).cast("long"))
    index = incremental.appended(empty, en, ["doc_id"])
    return incremental.appended(index, d.where("lang = 'fr'").drop("lang"), ["source", "doc_id"]).select("doc_id", "ord")


@query("select name from (values ('x')) v(name) where false union all select distinct source from documents where lang <> 'es' or source in (select source from documents where lang = 'en')")
def doc_list(t):
    d = t("documents")
    index = d.select(F.col("source").alias("doc_name"), "lang")
    kept = incremental.without_deleted(index, d.where("lang = 'en'").select(F.col("source").alias("name")).distinct())
    return kept.unionByName(index.where("lang <> 'es'")).select(F.col("doc_name").alias("name")).distinct()


@query("select count(*) as n_chunks, count(distinct source) as n_docs, string_agg(distinct source, ',' order by source) as docs, (select max(len(embedding))::bigint from embeddings) as dim from documents")
def index_stats(t):
    d = records.index_stats(t("documents").select(F.col("source").alias("doc_name")))
    d = d.select(F.col("num_chunks").alias("n_chunks"), F.col("num_docs").alias("n_docs"), F.array_join("docs", ",").alias("docs"))
    return d.crossJoin(t("embeddings").agg(long(F.max(F.size("embedding"))).alias("dim")))


@query("select source, lang as section, row_number() over (partition by source order by min(doc_id)) as pos from documents group by source, lang")
def doc_sections(t):
    d = records.all_sections(t("documents").select(F.col("source").alias("doc_name"), F.col("lang").alias("section"), F.col("doc_id").alias("ord")))
    return d.select(F.col("doc_name").alias("source"), "section", long("pos").alias("pos"))


@query("select doc_id, source || ', Page ' || doc_id as label, md5(doc_id || ':1') as digest from documents order by md5(doc_id || ':1') limit 100")
def sample_chunks(t):
    d = records.sampled(t("documents").select("doc_id", "source"), "doc_id", 100)
    return d.select("doc_id", T.citation_label(F.col("source"), F.col("doc_id")).alias("label"), "digest")


@query("""select event_id, event_type as summary, 2::bigint as n_questions, 'q1|' || user_id as questions from events where value > 10 union all select event_id, '', 0, '' from events where value <= 10 or value is null""")
def enrich_json(t):
    good = F.concat(F.lit('Sure! {"summary": "  '), "event_type", F.lit(' ", "questions": [" q1", "", "'), F.col("user_id").cast("string"), F.lit('"]} bye'))
    d = t("events").select("event_id", T.enrichment(F.when(F.col("value") > 10, good).otherwise("no {json here")).alias("e"))
    return d.select("event_id", F.col("e.summary").alias("summary"), long(F.size("e.questions")).alias("n_questions"), F.array_join("e.questions", "|").alias("questions"))


@query("""select event_id, case when value > 10 then 'find' else event_type end as first, case when value > 10 then 'general' else 'general' end as intent, case when value > 10 then 2 else 1 end::bigint as n, coalesce(value > 10, false) as is_complex from events""")
def planner_json(t):
    good = F.lit('{"sub_queries": [{"text": " find ", "intent": ""}, {"text": "  "}, {"text": "compare", "intent": "lookup"}]}')
    d = t("events").select("event_id", T.planned(F.when(F.col("value") > 10, good).otherwise("none"), F.col("event_type")).alias("p"))
    return d.select("event_id", F.col("p.sub_queries")[0]["text"].alias("first"), F.col("p.sub_queries")[0]["intent"].alias("intent"), long(F.size("p.sub_queries")).alias("n"), F.col("p.is_complex").alias("is_complex"))


@query("""select event_id, case when value > 10 then '{"a": [1, 2]}' else '["x"]' end as json from events""")
def llm_json(t):
    raw = F.when(F.col("value") > 10, F.lit('Well:\n```json\n{"a": [1, 2]}\n```')).otherwise('so ["x"] it is')
    return t("events").select("event_id", T.llm_json(raw).alias("json"))


@query(f"""with {BM25} select qid, string_agg('[Source: ' || coalesce(source, '') || ', Page ' || doc_id || ', Section: ' || case when coalesce(lang, '') = '' then 'N/A' else lang end || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by rank) as context
from lex join documents using (doc_id) where rank <= 5 group by qid""")
def bm25_prompt_contexts(t):
    d = t("documents").select("doc_id", F.coalesce("source", F.lit("")).alias("doc_name"), F.col("doc_id").alias("page"), F.col("lang").alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    hits = search.bm25(t("documents").select("doc_id", "text"), _items(t), "doc_id", 5).select("qid", "rank", "doc_id")
    return records.prompt_contexts(d.join(hits, "doc_id"), 5)


@query("""select 'd' || doc_id as chunk_id, source as doc_name, coalesce(case when quality = 1 then 'good' end, '') as summary, (case when quality = 1 then 1 else 0 end)::bigint as n_questions from documents left join labels using (doc_id)""")
def index_metadata(t):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    good = F.col("quality") == 1
    c = d.select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), F.col("source").alias("doc_name"), F.lit(1).alias("page"), F.col("lang").alias("section"), "text", F.when(good, "good").alias("summary"), F.when(good, F.array(F.lit("q"))).alias("questions"))
    return records.metadata(c).select("chunk_id", "doc_name", "summary", long(F.size("questions")).alias("n_questions"))


@query(f"""with {DENSE20} select qid, 'v' || vec_id as chunk_id, '' as section, round(score, 6) as score, 0.0::double as similarity, 'q' || qid as source_query from hits""")
def retrieved_chunks(t):
    r = _hits(t, 20).select("qid", F.concat(F.lit("v"), "vec_id").alias("chunk_id"), F.lit("d").alias("doc_name"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("section"), F.lit("t").alias("text"), "score", F.lit(None).cast("double").alias("similarity"))
    return records.retrieved(r, F.concat(F.lit("q"), "qid")).select("qid", "chunk_id", "section", r6("score"), "similarity", "source_query")


@query("select source, lang as section, count(*) as n from documents where source = 'src3' and lang <> '' group by source, lang")
def one_document(t):
    c = t("documents").select(F.col("source").alias("doc_name"), F.col("lang").alias("section"), F.col("doc_id").alias("ord"), F.concat(F.lit("d"), "doc_id").alias("chunk_id"))
    s = records.document_sections(c, "src3")
    own = c.where("doc_name = 'src3'").groupBy(F.col("doc_name").alias("source"), "section").agg(F.count(F.lit(1)).alias("n"))
    return own.join(s, "section", "left_semi").select("source", "section", "n")


# -- model replies: verification, enrichment, pipelines ----------------------------------------------


@query(rf"""with x as (select doc_id, text, quality, toxic, {_values('text')} as v, regexp_replace(text[1:length(text) // 2], '\s+', ' ', 'g') as src from documents join labels using (doc_id)),
y as (select *, len(list_filter(v, lambda z: not contains(src, z)))::bigint as mismatches, (2 + quality + (1 - toxic)) / 4.0::double as ratio from x)
select doc_id, 4::bigint as n_claims, concat_ws('|', case when quality = 0 then 'good' end, case when toxic = 1 then 'clean' end) as removed, mismatches,
case when mismatches > 0 then 'low' when ratio >= 0.95 then 'high' when ratio >= 0.75 then 'medium' else 'low' end as confidence, md5(text) as digest from y""")
def verified_answers(t):
    d = t("documents").join(t("labels"), "doc_id")
    claim = lambda name, ok: F.struct(F.lit(f" {name} ").alias("claim"), ok.alias("supported"))
    claims = F.array(claim("a", F.lit(True)), claim("good", F.col("quality") == 1), claim("clean", F.col("toxic") == 0), claim("b", F.lit(True)))
    reply = F.concat(F.lit("Here:\n"), F.to_json(F.struct(claims.alias("claims"), F.lit(" High ").alias("confidence"))))
    half = F.expr("substring(text, 1, length(text) div 2)")
    chunk = F.array(F.struct(F.lit("k").alias("chunk_id"), F.col("source").alias("doc_name"), F.lit(1).alias("page"), half.alias("text")))
    v = d.select("doc_id", "text", verification.verified(F.col("text"), chunk, reply).alias("v"))
    return v.select("doc_id", long(F.size("v.claim_checks")).alias("n_claims"), F.array_join("v.removed_claims", "|").alias("removed"), long(F.size("v.mismatches")).alias("mismatches"), F.col("v.confidence").alias("confidence"), F.md5(F.when(F.col("v.verified_answer") == T.strip(F.col("text")), F.col("text"))).alias("digest"))


@query("""with p as (select doc_id, source, lang, text, length(text) + length('document excerpt:' || chr(10) || chr(10) || chr(10) || 'Enrichment JSON:') as n from documents),
e as (select *, case when n % 2 = 0 then 'len ' || n else '' end as summary, case when n % 2 = 0 then 'Questions answered: a b' else '' end as asked from p)
select doc_id, summary, case when n % 2 = 0 then 2 else 0 end::bigint as n_questions, md5(array_to_string(list_filter([source || ' > ' || lang, summary, asked, text], lambda x: x <> ''), chr(10))) as digest from e""")
def enriched_chunks(t):
    chunks = t("documents").select("doc_id", F.col("source").alias("doc_name"), F.col("lang").alias("section"), "text", F.lit("old").alias("summary"))
    reply = lambda p: F.when(F.length(p) % 2 == 0, F.concat(F.lit('Sure: {"summary": " len '), F.length(p).cast("string"), F.lit(' ", "questions": ["a", "", " b "]}'))).otherwise("[LLM Error] none")
    return enrichment.enriched(chunks, reply).select("doc_id", "summary", long(F.size("questions")).alias("n_questions"), F.md5("embedding_text").alias("digest"))


@query("select doc_id, md5(case when quality = 1 then 'enriched ' || lang else text end) as digest from documents left join labels using (doc_id)")
def embedding_source(t):
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    enriched = F.when(F.col("quality") == 1, F.concat(F.lit("enriched "), "lang")).when(F.col("quality") == 0, "")
    return d.select("doc_id", F.md5(T.embedding_source(enriched, F.col("text"))).alias("digest"))


@query(rf"""with d as (select doc_id, case when doc_id % 3 = 0 then text || ' That  IS' || chr(10) || 'not Found in the files.' else text end as text from documents)
select doc_id, len(list_filter({_MARKERS}, lambda m: contains(lower(regexp_replace(text, '\s+', ' ', 'g')), m))) > 0 as abstained from d""")
def abstained_answers(t):
    said = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" That  IS\nnot Found in the files."))).otherwise(F.col("text"))
    return t("documents").select("doc_id", T.abstained(said).alias("abstained"))


@query(f"""with {VEC}, {_q(1)}, {_topk('h', 'q1', 5)} select qid, round(max(greatest(0, least(1, score))), 6) as best, max(greatest(0, least(1, score))) >= 0.999 as covered from h where vec_id <> qid + 1 or qid % 100 = 0 group by qid""")
def coverage_gates(t):
    v, _ = _vectors(t)
    hits = search.dense(v, _shifted(t, 1), "vec_id", 5).withColumn("similarity", V.similarity(F.col("score")))
    return search.covered(hits.where((F.col("vec_id") != F.col("qid") + 1) | (F.col("qid") % 100 == 0)), 0.999).select("qid", r6("best"), "covered")


@query(rf"""with b as (select doc_id, text, source, n_chars, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')[1:3] as facts from documents),
r as (select doc_id, 'agentic' as pipeline, text as answer, 'k' || doc_id as cited, facts, text[1:length(text) // 2] as chunk, n_chars / 10.0::double as latency_ms, 3 as calls from b
  union all select doc_id, 'traditional', text[length(text) // 2 + 1:], 'x', facts, text[1:length(text) // 2], n_chars / 20.0::double, 1 from b),
v as (select *, {_values('answer')} as v, regexp_replace(chunk, '\s+', ' ', 'g') as src, lower(regexp_replace(answer, '\s+', ' ', 'g')) as flat from r),
m as (select pipeline, latency_ms, calls, length(answer) as tokens, len(list_filter(facts, lambda f: contains(flat, f)))::double / nullif(len(facts), 0) as fact_coverage,
  case when cited = 'x' then 0.0 else 1.0 end as citation_validity, len(list_filter(v, lambda y: contains(src, y)))::double / nullif(len(v), 0) as grounding,
  len(list_filter({_MARKERS}, lambda p: contains(flat, p))) > 0 as gone, doc_id % 7 = 0 as out, doc_id % 2 = 0 as labelled from v)
select pipeline, count(*) as num_queries, round(avg(fact_coverage), 6) as fact_coverage, round(avg(citation_validity), 6) as citation_validity, round(avg(grounding), 6) as grounding, round(avg(gone::int), 6) as abstain_rate,
round(avg(calls), 6) as llm_calls, round(avg(tokens), 6) as total_tokens, round(avg(case when labelled then 0.5 end), 6) as precision, round(avg(case when labelled then 1 end), 6) as recall, round(avg(case when labelled then 1 end), 6) as ndcg,
round(avg(case when out then gone::int end), 6) as resilience, round(avg(latency_ms), 6) as avg_latency_ms, round(quantile_cont(latency_ms, 0.5), 6) as p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) as p95_latency_ms from m group by pipeline""")
def pipeline_scorecard(t):
    d = t("documents").withColumn("query", F.concat(F.lit("q"), "doc_id"))
    own = F.concat(F.lit("k"), "doc_id")
    first, last = F.expr("substring(text, 1, length(text) div 2)"), F.expr("substring(text, length(text) div 2 + 1)")
    usage = lambda calls, answer: F.struct(F.lit(calls).alias("calls"), F.length(answer).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"))

    def results(pipeline: str, answer: Column, cited: Column, parts: float, calls: int) -> DataFrame:
        chunk = F.array(F.struct(own.alias("chunk_id"), F.col("source").alias("doc_name"), first.alias("text")))
        return d.select("query", F.lit(pipeline).alias("pipeline"), answer.alias("answer"), F.lit("n/a").alias("confidence"), F.array(F.struct(cited.alias("chunk_id"), F.col("source").alias("doc_name"))).alias("citations"), chunk.alias("chunks"), usage(calls, answer).alias("usage"), (F.col("n_chars") / parts).alias("total_latency_ms"))

    labels = d.select("query", F.when(F.col("doc_id") % 2 == 0, F.array(own)).alias("relevant"), T.first_tokens(F.col("text"), 3).alias("expected_facts"), F.array("source").alias("must_cite"), (F.col("doc_id") % 7 == 0).alias("out_of_scope"))
    both = results("agentic", F.col("text"), own, 10.0, 3).unionByName(results("traditional", last, F.lit("x"), 20.0, 1))
    card, _ = harness.compare(both, labels, 2)
    return card.select("pipeline", "num_queries", *(r6(c) for c in card.columns if c not in ("pipeline", "num_queries", "must_cite_recall")))


# -- small shapes -----------------------------------------------------------------------------------


@query(f"""with {BM25} select qid, rank, doc_id, left(coalesce(text, ''), 240) as snippet from lex join documents using (doc_id) where rank <= 5""")
def hit_snippets(t):
    hits = search.bm25(t("documents").select("doc_id", "text"), _items(t), "doc_id", 5)
    return t("documents").select("doc_id", "text").join(hits, "doc_id").select("qid", long("rank").alias("rank"), "doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("""with c as (select doc_id, source, case when doc_id % 5 = 0 then 'appendix ' || (doc_id % 2) else (doc_id * 37 % 101)::varchar end as page, 'd_c' || case when doc_id % 11 = 0 then 'x' else (doc_id * 13 % 17)::varchar end as chunk_id from documents)
select doc_id, row_number() over (partition by source order by try_cast(page as int) is null, try_cast(page as int), page, coalesce(try_cast(nullif(regexp_extract(chunk_id, '_c(\\d+)$', 1), '') as int), 0), doc_id) as pos from c""".replace("\\\\", "\\"))
def page_order(t):
    page = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("appendix "), (F.col("doc_id") % 2).cast("string"))).otherwise((F.col("doc_id") * 37 % 101).cast("string"))
    chunk = F.concat(F.lit("d_c"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise((F.col("doc_id") * 13 % 17).cast("string")))
    w = Window.partitionBy("source").orderBy(*T.page_key(F.col("page")), T.chunk_index(F.col("chunk_id")), "doc_id")
    return t("documents").select("doc_id", "source", page.alias("page"), chunk.alias("chunk_id")).select("doc_id", long(F.row_number().over(w)).alias("pos"))


@query("""select page_id, list_last(string_split(regexp_replace(url, '/+$', ''), '/')) as stem, 'tar' as archive from pages""")
def file_stems(t):
    name = F.concat(F.regexp_replace("url", "/+$", ""), F.lit(".pdf"))
    return t("pages").select("page_id", T.file_stem(name).alias("stem"), T.file_stem(F.concat(F.lit("/a.b/"), F.lit("tar.gz"))).alias("archive"))


@query("""select doc_id, '{"query":"q' || doc_id || '","pipeline":"agentic","answer":"a","confidence":"high","citations":[{"marker":1,"chunk_id":"k"}],"retrieved_chunks":["k"],"stages":[{"name":"planner","latency_ms":0.13,"llm_calls":1,"prompt_tokens":2,"completion_tokens":3,"total_tokens":5}],"total_latency_ms":1.24,"total_llm_calls":2,"total_tokens":' || (n_chars + 4) || '}' as json from documents""")
def wire_results(t):
    usage = lambda calls, given, made: F.struct(F.lit(calls).alias("calls"), given.alias("prompt_tokens"), F.lit(made).alias("completion_tokens"))
    stage = F.struct(F.lit("planner").alias("name"), F.lit(0.128).alias("latency_ms"), usage(1, F.lit(2), 3).alias("usage"))
    d = t("documents").select(
        F.col("doc_id").alias("qid"), F.concat(F.lit("q"), "doc_id").alias("query"), F.lit("agentic").alias("pipeline"), F.lit("a").alias("answer"), F.lit("high").alias("confidence"),
        F.array(F.struct(F.lit(1).alias("marker"), F.lit("k").alias("chunk_id"))).alias("citations"), F.array(F.struct(F.lit("k").alias("chunk_id"), F.lit("t").alias("text"))).alias("chunks"),
        F.array(stage).alias("stages"), F.lit(1.239).alias("total_latency_ms"), usage(2, F.col("n_chars"), 4).alias("usage"),
    )
    return records.wire(d).select(F.col("qid").alias("doc_id"), "json")


def _mixed(t) -> DataFrame:
    """Answers whose first reference is found by id or by page, or not at all, and the chunks as an array."""
    label = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(", Page 1 (id: "), "source", F.lit("_p1_c0)"))).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit(", Page 2"))).otherwise("nothing, Page 9")
    answer = F.concat(F.lit("It is so [^1], or so [^2].\n[^1]: "), label, F.lit("\n[^2]: "), "lang", F.lit(", Page 3\n[^2]: "), "source", F.lit(", Page 1"))
    one = lambda doc, page: F.struct(F.concat(F.col(doc), F.lit(f"_p{page}_c0")).alias("chunk_id"), F.col(doc).alias("doc_name"), F.lit(page).alias("page"), F.lit("s").alias("section"))
    return t("documents").select(F.col("doc_id").alias("qid"), answer.alias("answer"), F.array(one("source", 1), one("lang", 2), one("lang", 3)).alias("chunks"))


MIXED = """with v as (select doc_id as qid, case doc_id % 3 when 0 then source || '_p1_c0' when 1 then lang || '_p2_c0' end as a, lang || '_p3_c0' as b from documents)
select qid, 1::bigint as marker, a as chunk_id from v where a is not null union all select qid, 2, b from v"""


@query(MIXED)
def cited_in_rows(t):
    d = _mixed(t).select("qid", F.inline(context.cited(F.col("answer"), F.col("chunks"))))
    return d.select("qid", long("marker").alias("marker"), "chunk_id")


@query(MIXED)
def plain_cited_in_rows(t):
    d = _mixed(t).select("qid", F.inline(context.plain_cited(F.col("answer"), F.col("chunks"))))
    return d.select("qid", long("marker").alias("marker"), "chunk_id")


@query(MIXED)
def resolve_mixed_citations(t):
    d = _mixed(t)
    chunks = d.select("qid", F.posexplode("chunks").alias("ord", "c")).select("qid", "ord", "c.*")
    return context.resolved(context.references(d), chunks).select("qid", long("marker").alias("marker"), "chunk_id")
