"""The persisted inverted index: postings by bucket of terms, and statistics that add up over segments.

A segment has three tables. ``postings`` (bucket, term, key, doc, seg, tf, length) lies in a folder a bucket of terms, sorted by term, cut by
key so that no file grows with the corpus. ``terms`` (bucket, term, df) and ``dfs`` (df, n: how many terms have that document
frequency) are signed changes: their sums over all segments are the statistics, so appending and deleting read no text of other segments.
A search reads the buckets of its terms only; postings carry lengths, so no text is read.
"""
from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallgrove.functions.text import tokens
from tallgrove.operators import search
from tallgrove.operators.batches import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets of terms, fixed for an index when it is built.
BUCKETS = 64
#: Keys whose postings of a bucket go to one file at most.
SHARD = 1 << 15


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(chunks: DataFrame, key: str, doc: str, text: str = "text") -> DataFrame:
    """(term, key, doc, seg, tf, length) of chunks (key, doc, seg, text): counted in the row, nothing is shuffled."""
    kinds = dict(chunks.dtypes)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(3)
            flat = lists.flatten().dictionary_encode()
            length = np.diff(lists.offsets.to_numpy())
            width = max(1, len(flat.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(len(length)), length) * width + flat.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(pair, width)
            at = pa.array(row)
            yield pa.record_batch(
                [flat.dictionary.take(pa.array(term)), *(b.column(i).take(at) for i in range(3)), pa.array(tf, pa.int32()), pa.array(length[row], pa.int32())],
                ["term", key, doc, "seg", "tf", "length"],
            )

    schema = f"term string, `{key}` {kinds[key]}, `{doc}` {kinds[doc]}, seg {kinds['seg']}, tf int, length int"
    return small_batches(chunks.select(key, doc, "seg", tokens(F.col(text)).alias("__t"))).mapInArrow(count, schema)


def write_postings(rows: DataFrame, path: str, key: str, chunks: int, buckets: int) -> None:
    """Postings below ``path``, a folder a bucket; ``chunks`` is about how many keys there are."""
    shards = -(-max(1, chunks) // SHARD)
    rows = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).withColumn("__part", (F.col("bucket") + buckets * F.pmod(F.xxhash64(key), F.lit(shards))).cast("int"))
    rows = rows.repartitionById(buckets * shards, "__part").sortWithinPartitions("bucket", "term", key).drop("__part")
    rows.write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def term_counts(rows: DataFrame, buckets: int, sign: int = 1) -> DataFrame:
    """(bucket, term, df) of postings, times ``sign``."""
    counts = rows.groupBy("term").agg((F.count(F.lit(1)) * sign).cast("long").alias("df"))
    return counts.select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "df")


def summed(terms: DataFrame) -> DataFrame:
    """(bucket, term, df): changes added up; terms that no chunk holds any longer are left out."""
    return terms.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df <> 0")


def write_statistics(change: DataFrame, before: DataFrame | None, path: str) -> None:
    """The tables ``terms`` and ``dfs`` of a segment below ``path``, from its change (bucket, term, df) and the terms before it."""
    spark = change.sparkSession
    summed(change).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    own = spark.read.schema("term string, df long, bucket int").parquet(f"{path}/terms")
    old = summed(before).select("term", F.col("df").alias("old")) if before is not None else spark.createDataFrame([], "term string, old long")
    both = own.join(old, "term", "left").select(F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.col("df")).alias("new"))
    moved = both.select(F.explode(F.array(F.struct(F.col("old").alias("df"), F.lit(-1).alias("n")), F.struct(F.col("new").alias("df"), F.lit(1).alias("n")))).alias("x"))
    moved.where("x.df > 0").groupBy("x.df").agg(F.sum("x.n").alias("n")).where("n <> 0").coalesce(1).write.parquet(f"{path}/dfs")


def _idf(df: Column, n: int) -> Column:
    return F.ln(F.lit(n) - df + 0.5) - F.ln(df + 0.5)


def idf_of(terms: DataFrame, dfs: DataFrame, n: int, wanted: list[str], buckets: list[int]) -> dict[str, float]:
    """{term: idf} of the wanted terms; those in more than half of ``n`` chunks get a share of the mean over all terms."""
    spark = terms.sparkSession
    mean = dfs.groupBy("df").agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * _idf(F.col("df"), n)) / F.sum("n")).alias("m")).first().m or 0.0
    own = spark.createDataFrame([(w,) for w in wanted], "term string")
    found = summed(terms.where(F.col("bucket").isin(buckets)).join(F.broadcast(own), "term")).select("term", _idf(F.col("df"), n).alias("idf")).collect()
    return {r.term: r.idf if r.idf >= 0 else search.EPSILON * mean for r in found}


def query_terms(queries: DataFrame, buckets: int) -> DataFrame:
    terms = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    return terms.withColumn("bucket", bucket_of(F.col("term"), buckets))


def by_key(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, document numbers, terms, tf, lengths) of rows (key, t, tf, length) sorted by key, no key in two of them."""
    held: list[pa.RecordBatch] = []
    for b in _then_none(it):
        if b is not None and not b.num_rows:
            continue
        own = pa.Table.from_batches([*held, b] if b is not None else held) if held or b is not None else None
        if own is None or not own.num_rows:
            return
        codes = own.column(0).combine_chunks().dictionary_encode()
        code = codes.indices.to_numpy()
        new = np.concatenate([[True], code[1:] != code[:-1]])
        end = own.num_rows if b is None else int(np.flatnonzero(new)[-1])  # the last key may go on
        held = own.slice(end).to_batches() if b is not None else []
        if end:
            doc = np.cumsum(new[:end]) - 1
            keys = np.array(codes.dictionary.take(pa.array(code[:end][new[:end]])).to_pylist(), object if not pa.types.is_integer(own.column(0).type) else np.int64)
            yield keys, doc, *(own.column(i).to_numpy()[:end] for i in (1, 2, 3))


def _then_none(it: Iterator) -> Iterator:
    yield from it
    yield None


def scores_of(matched: DataFrame, key: str, qids: list, qid_type: str, weights: tuple, mean: float, k: int | list | None) -> DataFrame:
    """(qid, key, score) of postings (key, t, tf, length): the k best of each query (a number, or one for each) in each task, or with None all above 0."""
    spark = matched.sparkSession
    shared, schema = spark.sparkContext.broadcast(weights), f"qid {qid_type}, `{key}` {dict(matched.dtypes)[key]}, score double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = search._weighted(shared.value, len(qids))
        out = search.Collected(qids, arrow, search.places(k, len(qids)))
        step = max(1, search.CELLS // len(qids))
        for keys, doc, term, tf, length in by_key(it):
            for s in range(0, len(keys), step):
                x, y = np.searchsorted(doc, [s, s + step])
                own = keys[s : s + step]
                yield from out.add(own, score(doc[x:y] - s, term[x:y], tf[x:y], length[x:y], len(own), mean))
        yield from out.rest()

    rows = matched.select(key, "t", "tf", "length").repartition(key).sortWithinPartitions(key)
    return small_batches(rows).mapInArrow(task, schema)


def bm25(postings: DataFrame, terms: DataFrame, dfs: DataFrame, n: int, length: int, queries: DataFrame, key: str, k: int | str | None, buckets: int, live: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``search.bm25`` from an inverted index of ``n`` chunks with ``length`` tokens: (qid, rank, key, score); with k None all scores, without ranks.

    k may name a column of the queries: then scores come without ranks, among them as many of the best as the query asks for.

    Queries (qid, text) are taken in blocks of at most ``search.BLOCK``. ``live`` drops postings of deleted documents.
    """
    spark = postings.sparkSession
    rows = query_terms(queries, buckets)
    limits = queries.select("qid", k) if isinstance(k, str) else rows.select("qid").distinct()
    blocks = search.blocks_of(limits, k)
    kind, out = queries.schema["qid"].dataType.simpleString(), None
    for i in range(blocks):
        block = lambda d, i=i: (d if blocks == 1 else d.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)).toArrow().to_pylist()
        own = block(rows)
        if not own or not n:
            continue
        where = sorted({r["bucket"] for r in own})
        qids, weights = search.weights_of(own, idf_of(terms, dfs, n, sorted({r["term"] for r in own}), where))
        numbers = spark.createDataFrame(list(enumerate(weights[0])), "t long, term string")
        matched = live(postings.where(F.col("bucket").isin(where)).join(F.broadcast(numbers), "term"))
        most = {r["qid"]: r[k] for r in block(limits)} if isinstance(k, str) else None
        part = scores_of(matched, key, qids, kind, weights, length / n, k if most is None else [most[q] for q in qids])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"qid {kind}, `{key}` {dict(postings.dtypes)[key]}, score double")
    return search.ranked(out, "score", key, k=k).select("qid", "rank", key, "score") if isinstance(k, int) else out


def united(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Tables with folders of their own for partitions, as one; columns that some lack are null there. None if there are none."""
    out = None
    for p in paths:
        d = spark.read.parquet(p)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
