"""Retrieval: BM25, exact dense search, rank fusion, document-scoped search, hit merging.

BM25 and dense search score in Arrow batches: a batch of documents against the broadcast query set at once, in numpy; each
task hands on its best k of a query only, so what is shuffled does not grow with the number of documents that match.
"""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallgrove.functions.text import tokens
from tallgrove.functions.vectors import similarity
from tallgrove.operators import incremental
from tallgrove.operators.batches import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60
#: Rows of a query set up to which it is broadcast; beyond it Spark joins as it likes.
SMALL = 200_000
#: Queries that are broadcast at once: vectors (8 bytes a dimension each), or terms with weights (16 bytes a term).
BLOCK = 20_000
#: Bytes a core below which a table is dealt out to all cores.
SPLIT = 16 << 20
#: Scores that are held at once.
CELLS = 1 << 19
#: Hits that a task keeps for all queries of a block; hits that a query asks for beyond which a task keeps none but hands on all; rows of a batch of hits.
HELD, LONG, PIECE = 1 << 20, 1 << 18, 1 << 16


def near(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is too small to have a split for each.

    A small file is often one row group, so one task; what is moved is at most ``SPLIT`` a core. Larger tables stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT else df


def ranked(df: DataFrame, score: str, key: str, by: str = "qid", k: int | None = None) -> DataFrame:
    """Adds rank within ``by``: score descending (ties to nine digits by key); keeps the first k."""
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col(key))
    df = df.withColumn("rank", F.row_number().over(w))
    return df if k is None else df.where(F.col("rank") <= k)


class Best:
    """The best keys of each query seen so far, as many as ``k`` has for it: scores to nine digits descending, then keys.

    Scores that reach a query's last place wait until there are many of them, and are then sorted together with the best.
    """

    def __init__(self, k: np.ndarray) -> None:
        self.k, self.known = k, np.empty(0, object)
        self.q, self.at, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.least = np.where(k > 0, -np.inf, np.inf)  # what a score has to reach
        self.new, self.waiting = [], 0

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        """Scores (keys, queries) of keys not seen before; -inf is none."""
        row, q = np.nonzero((scores >= self.least - 1e-9) & (scores > -np.inf))
        if len(row):
            used, at = np.unique(row, return_inverse=True)
            self.new.append((keys[used], at, q, scores[row, q]))
            self.waiting += len(row)
        if self.waiting > max(CELLS // 4, len(self.q)):
            self.settle()

    def settle(self) -> None:
        """Puts what waits in its place."""
        if not self.new:
            return
        groups = [(self.known, self.at, self.q, self.scores)] * bool(len(self.q)) + self.new
        before = np.cumsum([0, *(len(g[0]) for g in groups)])
        known, q, scores = (np.concatenate([g[i] for g in groups]) for i in (0, 2, 3))
        at = np.concatenate([g[1] + n for g, n in zip(groups, before)])
        self.new, self.waiting = [], 0
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(known, kind="stable")] = np.arange(len(known))
        order = np.lexsort((rank[at], -np.round(scores, 9), q))
        q = q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k[q]]
        used, self.at = np.unique(at[order], return_inverse=True)
        self.known, self.scores = known[used], scores[order]
        counts = np.minimum(np.bincount(q, minlength=len(self.k)), self.k)
        self.q = np.repeat(np.arange(len(self.k)), counts)
        full = (counts >= self.k) & (counts > 0)
        self.least[full] = np.round(self.scores[np.cumsum(counts)[full] - 1], 9)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the query, key, score) of the best."""
        self.settle()
        return self.q, self.known[self.at], self.scores


class Collected:
    """Scores of batches as rows (qid, key, score): at the end the best of each query, as many as ``k`` has for it; of those with more than ``LONG`` all, as they come."""

    def __init__(self, qids: list, schema: pa.Schema, k: np.ndarray) -> None:
        self.arrow, self.qids, self.whole = schema, qids, k > LONG
        self.best = Best(np.where(self.whole, 0, k))

    def rows(self, q: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(q), PIECE):
            own = slice(s, s + PIECE)
            yield pa.record_batch([pa.array([self.qids[i] for i in q[own]], self.arrow.field(0).type), pa.array(keys[own].tolist(), self.arrow.field(1).type), pa.array(scores[own])], self.arrow.names)

    def add(self, keys: np.ndarray, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.whole.any():
            at, q = np.nonzero((scores > -np.inf) & self.whole)
            yield from self.rows(q, keys[at], scores[at, q])
        if not self.whole.all():
            self.best.add(keys, scores)

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield from self.rows(*self.best.rows())


def places(k: int | list | None, queries: int) -> np.ndarray:
    """How many hits each query asks for; with None all."""
    return np.broadcast_to(np.asarray(LONG + 1 if k is None else k, np.int64), queries)


def blocks_of(queries: DataFrame, k: int | str | None) -> int:
    """In how many blocks queries (qid[, k]) are taken: ``BLOCK`` of them at most, and about ``HELD`` hits that a task keeps."""
    most = F.col(k) if isinstance(k, str) else F.lit(0 if k is None else k)
    n, held = queries.agg(F.count(F.lit(1)), F.sum(F.when(most <= LONG, most).otherwise(0))).first()
    return max(1, -(-n // BLOCK), -(-(held or 0) // HELD))


def best_of(df: DataFrame, columns: list[str], key: str, qids: list, qid_type: str, k: int | list | None, scorer: Callable) -> DataFrame:
    """(qid, key, score): of each task the best k of each query (a number, or one for each), with k None all. ``scorer()`` makes a function of batches to scores (rows, queries). Null keys are not found."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"qid {qid_type}, `{key}` {kind}, score double"
    if not qids:
        return df.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, out = scorer(), Collected(qids, arrow, places(k, len(qids)))
        step = max(1, CELLS // len(qids))
        for b in it:
            for s in range(0, b.num_rows, step):
                own = b.slice(s, step)
                yield from out.add(own.column(0).to_numpy(zero_copy_only=False), score(own))
        yield from out.rest()

    return small_batches(df.where(F.col(key).isNotNull()).select(key, *columns)).mapInArrow(task, schema)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, idf): documents that hold the term, and the raw inverse document frequency."""
    df = _counts(docs, text)
    n = df.where("term is null").select(F.col("df").alias("n"))
    return df.where("term is not null").crossJoin(F.broadcast(n)).select("term", "df", _idf().alias("idf"))


def _idf() -> Column:
    return F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def _counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, df, length): documents that hold a term; the null term has all documents and their tokens. One pass; what is shuffled is counted by batches before."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(0)
            flat = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            once = np.unique(row * (len(flat.dictionary) + 1) + flat.indices.to_numpy()) % (len(flat.dictionary) + 1)
            df = np.bincount(once, minlength=len(flat.dictionary))
            terms = pa.concat_arrays([flat.dictionary, pa.nulls(1, pa.string())])
            yield pa.record_batch([terms, pa.array(np.append(df, len(lists))), pa.array([*[None] * len(df), len(row)], pa.int64())], ["term", "df", "length"])

    t = small_batches(docs.select(tokens(F.col(text)).alias("__t"))).mapInArrow(count, "term string, df long, length long")
    return t.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))


def _statistics(docs: DataFrame, wanted: DataFrame, text: str) -> tuple[float, list]:
    """(mean length, [(term, idf)] of the wanted terms) by one job over the documents; nothing is returned but these and one row a document frequency."""
    counts = _counts(docs, text).join(near(wanted).withColumn("own", F.lit(True)), "term", "left")
    # terms that are not wanted matter by their document frequency only, for the mean
    rows = counts.groupBy("df", F.when(F.col("own") | F.col("term").isNull(), F.col("term")).alias("term"), F.col("term").isNull().alias("every"), F.col("own")).agg(F.count(F.lit(1)).alias("k"), F.max("length").alias("length")).toArrow().to_pylist()
    every = [r for r in rows if r["every"]]
    if not every:
        return 0.0, []
    n = every[0]["df"]
    idf = lambda df: float(np.log(n - df + 0.5) - np.log(df + 0.5))
    terms = [r for r in rows if not r["every"]]
    mean = sum(r["k"] * idf(r["df"]) for r in terms) / max(1, sum(r["k"] for r in terms))
    return every[0]["length"] / n, [(r["term"], idf(r["df"]) if idf(r["df"]) >= 0 else EPSILON * mean) for r in terms if r["own"]]


def weights_of(rows: list[dict], idf_of: dict[str, float]) -> tuple[list, tuple]:
    """(qids, weights) of query terms (qid, term, times): the terms, where the queries of each begin, the queries and their weights."""
    qids = sorted({r["qid"] for r in rows}, key=lambda q: (q is None, q))
    at, number = {q: i for i, q in enumerate(qids)}, {}
    own = [r for r in rows if r["term"] in idf_of]
    term = np.array([number.setdefault(r["term"], len(number)) for r in own], np.int64)
    weight = np.array([r["times"] * idf_of[r["term"]] for r in own])
    order = np.argsort(term, kind="stable")
    return qids, (list(number), np.searchsorted(term[order], np.arange(len(number) + 1)), np.array([at[r["qid"]] for r in own], np.int64)[order], weight[order])


def _weighted(weights: tuple, n: int) -> Callable:
    """A function of occurrences (document from 0 on, term, times, the document's length) to the BM25 scores (documents, n queries) of that many documents."""
    number, start, owner, weight = weights
    dense = len(number) * n <= 4 * CELLS  # then the weights are a matrix, and scores products of it
    matrix = np.zeros((len(number), n) if dense else (0, 0))
    if dense:
        np.add.at(matrix, (np.repeat(np.arange(len(number)), np.diff(start)), owner), weight)

    def score(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, docs: int, mean: float) -> np.ndarray:
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)) if len(doc) else np.zeros(0)
        scores = np.zeros(docs * n)
        if dense:
            step = max(1, CELLS // max(1, len(number)))
            for s in range(0, docs, step):
                x, y = np.searchsorted(doc, [s, s + step])
                rows = np.zeros((min(step, docs - s), len(number)))
                rows[doc[x:y] - s, term[x:y]] = part[x:y]
                scores[s * n : (s + len(rows)) * n] = (rows @ matrix).ravel()
        elif len(doc):
            # every (document, term) meets the queries of the term, about CELLS meetings at once
            times = start[term + 1] - start[term]
            ends = np.cumsum(times)
            cuts = np.searchsorted(ends, np.arange(0, ends[-1] + CELLS, CELLS), side="right")
            for x, y in zip(cuts, cuts[1:]):
                t = times[x:y]
                entry = np.repeat(start[term[x:y]] - np.cumsum(t) + t, t) + np.arange(t.sum())
                scores += np.bincount(np.repeat(doc[x:y], t) * n + owner[entry], np.repeat(part[x:y], t) * weight[entry], len(scores))
        scores = scores.reshape(docs, n)
        return np.where(scores > 0, scores, -np.inf)

    return score


def bm25(docs: DataFrame, queries: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
    """(qid, rank, key, score) of the k best documents of each query with a score above 0.

    ``queries`` has qid and text, taken in blocks of at most ``BLOCK``. The documents are read twice: once for the
    statistics, once (a block) to be scored.
    """
    spark = docs.sparkSession
    terms = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    docs = spread(docs.select(key, text))
    mean, idf = _statistics(docs, terms.select("term").distinct(), text)
    idf_of = dict(idf)
    blocks = blocks_of(terms.select("qid").distinct(), k)
    kind = queries.schema["qid"].dataType.simpleString()
    t = docs.select(F.col(key), tokens(F.col(text)).alias("__t"))
    out = None
    for i in range(blocks):
        own = (terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)).toArrow().to_pylist()
        qids, weights = weights_of(own, idf_of)
        shared = spark.sparkContext.broadcast(weights)

        def scorer(shared=shared, n=len(qids)):
            score = _weighted(shared.value, n)
            terms = pa.array(shared.value[0], pa.string())
            width = len(terms) + 1

            def tokens_of(b: pa.RecordBatch) -> np.ndarray:
                lists = b.column(1)
                length = np.diff(lists.offsets.to_numpy())
                found = pc.index_in(lists.flatten(), terms).fill_null(-1).to_numpy()
                hit = np.flatnonzero(found >= 0)
                pair, tf = np.unique(np.repeat(np.arange(len(length)), length)[hit] * width + found[hit], return_counts=True)
                doc, term = np.divmod(pair, width)
                return score(doc, term, tf, length[doc], len(length), mean)

            return tokens_of

        best = best_of(t, ["__t"], key, qids, kind, k, scorer)
        out = best if out is None else out.unionByName(best)
    return ranked(out, "score", key, k=k).select("qid", "rank", key, "score")


def _vector_blocks(queries: DataFrame, columns: list[str], k: int | str | None) -> Iterator[tuple[list, object, dict]]:
    """Blocks of queries (qid, q, columns): ids, the broadcast matrix of their vectors, and the columns as lists."""
    wanted = queries.select("qid", "q", *columns).where("q is not null")
    blocks = blocks_of(wanted, k)
    for i in range(blocks):
        own = (wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)).toArrow()
        qids = own.column("qid").to_pylist()
        matrix = np.array(own.column("q").to_pylist(), np.float64).reshape(len(qids), -1 if qids else 0)
        yield qids, queries.sparkSession.sparkContext.broadcast(matrix), {c: own.column(c).to_pylist() for c in columns}


def _products(b: pa.RecordBatch, column: int, queries: np.ndarray) -> np.ndarray:
    """Inner products (rows, queries)."""
    return b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) @ queries.T


def dense(vectors: DataFrame, queries: DataFrame, key: str, k: int | str | None, vector: str = "embedding") -> DataFrame:
    """(qid, rank, key, score): exact inner products of each query (qid, q) with every vector, best k; with k None all of them, without ranks.

    k may name a column of the queries: then scores come without ranks, among them as many of the best as the query asks for.

    Queries are broadcast in blocks of about ``BLOCK`` at most, each block in a scan of its own over the
    vectors; every task keeps its best k of a query before the shuffle. Null vectors are not found.
    """
    kind, out = queries.schema["qid"].dataType.simpleString(), None
    for qids, shared, more in _vector_blocks(queries, [k] if isinstance(k, str) else [], k):

        def scorer(shared=shared):
            return lambda b: _products(b, 1, shared.value)

        best = best_of(spread(vectors).where(F.col(vector).isNotNull()), [vector], key, qids, kind, more[k] if isinstance(k, str) else k, scorer)
        out = best if out is None else out.unionByName(best)
    return ranked(out, "score", key, k=k).select("qid", "rank", key, "score") if isinstance(k, int) else out


def scoped(vectors: DataFrame, queries: DataFrame, key: str, k: int, doc: str, vector: str = "embedding") -> DataFrame:
    """(qid, rank, key, score): of each query (qid, q, doc, budget) the best k vectors of its document among the ``budget`` best of all.

    The best of the document are found first; then those are counted, in a second scan, that come before each of them.
    """
    kind, out = queries.schema["qid"].dataType.simpleString(), None
    for qids, shared, more in _vector_blocks(queries, [doc, "budget"], k):
        names = pa.array(more[doc]).dictionary_encode(null_encoding="encode")
        wanted, names = names.indices.to_numpy(), names.dictionary

        def scorer(shared=shared, names=names, wanted=wanted):
            def score(b: pa.RecordBatch) -> np.ndarray:
                own = pc.index_in(b.column(2), names.cast(b.column(2).type)).fill_null(-1).to_numpy()
                return np.where(own[:, None] == wanted, _products(b, 1, shared.value), -np.inf)

            return score

        found = vectors.where(F.col(vector).isNotNull())
        best = ranked(best_of(found, [vector, doc], key, qids, kind, k, scorer), "score", key, k=k).select("qid", "rank", key, "score").toArrow()  # k rows a query
        at = {q: i for i, q in enumerate(qids)}
        place = [(at[q], r - 1) for q, r in zip(best.column("qid").to_pylist(), best.column("rank").to_pylist())]
        scores = np.full((len(qids), k), np.inf)
        keys = np.zeros((len(qids), k), object)
        for (i, r), score, x in zip(place, best.column("score").to_pylist(), best.column(key).to_pylist()):
            scores[i, r], keys[i, r] = np.round(score, 9), x

        def count(it: Iterator[pa.RecordBatch], shared=shared, scores=scores, keys=keys) -> Iterator[pa.RecordBatch]:
            n = np.zeros(scores.shape, np.int64)
            for b in it:
                for s in range(0, b.num_rows, step):
                    own = b.slice(s, step)
                    x, names = np.round(_products(own, 1, shared.value), 9), np.array(own.column(0).to_pylist(), object)
                    for r in range(scores.shape[1]):
                        n[:, r] += (x > scores[:, r]).sum(axis=0)
                        row, q = np.nonzero(x == scores[:, r])
                        np.add.at(n[:, r], q, [names[i] < keys[j, r] for i, j in zip(row, q)])
            i, r = np.nonzero(np.isfinite(scores))
            yield pa.record_batch([pa.array(i), pa.array(r), pa.array(n[i, r])], ["i", "r", "n"])

        step = max(1, CELLS // max(1, len(qids)))
        counts = small_batches(found.select(key, vector)).mapInArrow(count, "i long, r long, n long").groupBy("i", "r").agg(F.sum("n").alias("n"))
        before = {(r.i, r.r): r.n for r in counts.collect()} if place else {}
        keep = pa.array([before.get(p, 0) < more["budget"][p[0]] for p in place], pa.bool_())
        part = found.sparkSession.createDataFrame(best.filter(keep))
        out = part if out is None else out.unionByName(part)
    return out


def fused(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """(qid, rank, key, score, similarity): reciprocal ranks of two lists added up; ``a`` gives the similarity."""
    left = a.select("qid", key, F.col("rank").alias("ra"), F.col("score").alias("sa"))
    right = b.select("qid", key, F.col("rank").alias("rb"))
    both = left.join(right, ["qid", key], "full_outer")
    term = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    scored = both.select("qid", key, (term("ra") + term("rb")).alias("score"), similarity(F.col("sa")).alias("similarity"))
    return ranked(scored, "score", key, k=k).select("qid", "rank", key, "score", "similarity")


def counted_ranks(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Adds rank as ``ranked`` does, for lists of any length: those of more than ``incremental.RANGE`` rows are numbered in ranges, so no task holds such a list."""
    many = rows.groupBy("qid").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > incremental.RANGE).select("qid")
    plain = lambda d: ranked(d, score, key).withColumn("rank", F.col("rank").cast("long"))
    if many.isEmpty():
        return plain(rows)
    many = near(many)
    short, order = plain(rows.join(many, "qid", "left_anti")), rows.join(many, "qid", "left_semi")
    order = order.withColumn("__s", -F.round(score, 9))
    order = incremental.numbered(order, ["qid", "__s", key], "__n").drop("__s")
    first = order.groupBy("qid").agg(F.min("__n").alias("__first"))
    return short.unionByName(order.join(near(first), "qid").withColumn("rank", (F.col("__n") - F.col("__first") + 1).cast("long")).drop("__n", "__first"))


def scoped_fused(a: DataFrame, b: DataFrame, budgets: DataFrame, members: DataFrame, key: str, k: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, rank, key, score, similarity): the best k of each query's own document among the ``budget`` best of the fused list.

    ``a`` and ``b`` have scores (qid, key, score), the ``budget`` best of each query at least; ``budgets`` (qid, doc, budget); ``members`` (key, doc). A budget may be
    as large as there are chunks: ranks of long lists come from counting in ranges. ``keep`` writes a table that is read several times.
    """
    wide = lambda d, r: counted_ranks(keep(d), "score", key).withColumnRenamed("rank", r).join(near(budgets.select("qid", "budget")), "qid").where(F.col(r) <= F.col("budget"))
    left = wide(a, "ra").select("qid", key, "ra", F.col("score").alias("sa"))
    right = wide(b, "rb").select("qid", key, "rb")
    both = left.join(right, ["qid", key], "full_outer")
    term = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    fused_ = both.select("qid", key, (term("ra") + term("rb")).alias("score"), similarity(F.col("sa")).alias("similarity"))
    found = counted_ranks(keep(fused_), "score", key).join(near(budgets), "qid").where(F.col("rank") <= F.col("budget"))
    own = found.join(members.select(key, F.col("doc").alias("__doc")), key).where(F.col("doc") == F.col("__doc"))
    w = Window.partitionBy("qid").orderBy("rank")
    return own.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).select("qid", F.col("__n").alias("rank"), key, "score", "similarity")


def over_fetch(top_k: int, n: int, rerank: bool, factor: int = 4) -> int:
    return min(factor * top_k, n) if rerank else top_k


def reranked(hits: DataFrame, score: Column, k: int, key: str) -> DataFrame:
    """Hits by a re-ranker's score (any Column, e.g. an Arrow UDF over query and text), old rank on ties."""
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    df = hits.withColumn("rerank_score", score)
    return df.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def scoped_budget(n_doc: Column, n: Column, top_k: int) -> Column:
    """How many hits to fetch so that about top_k are of one document."""
    return F.least(n, F.greatest(F.lit(3 * top_k), F.floor(top_k / (n_doc / n))))


def merged(hits: DataFrame, key: str) -> DataFrame:
    """Hits of several sub-queries (qid, sub, rank, key, score): each key once, its best score, first seen on ties; re-ranked."""
    w = Window.partitionBy("qid", key).orderBy(F.round("score", 9).desc(), "sub", "rank")
    best = hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "rank")
    return ranked(best, "score", key)


def covered(hits: DataFrame, gate: float = 0.45) -> DataFrame:
    """(qid, best, covered): whether the best similarity of a sub-query reaches the gate."""
    best = F.coalesce(F.max("similarity"), F.lit(0.0))
    return hits.groupBy("qid").agg(best.alias("best"), ((F.count("similarity") > 0) & (best >= gate)).alias("covered"))
