"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (orders 1 to 3) of every training text into ``BUCKETS`` hash
buckets a language, inside each task; Spark sums the counts; the log-probability matrix (512
KB a language) is broadcast, and texts are scored in numpy by
gathering matrix rows for all n-grams of a batch and adding them up by document.

The matrix holds ``BLOCK`` languages at most (32 MB). Of more languages, each block in code point order has a matrix and a pass over the
texts of its own; what is known so far (best language, its log score, log of the sum of all) goes from one pass to the
next through a table in the shared folder, so any number of languages is told apart in bounded memory.

Defined results: ``und`` with score 0 for a null text, one without a letter, and when
nothing was learned; ties go to the language first in code point order; texts are read
whole; repeated rows get equal results; an empty table gives an empty table; a null id is
neither held out nor learned from; a null language is not learned from; a column named like the output is replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import free_name, parts, small_batches, written

BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
#: Languages of one matrix.
BLOCK = 64
#: Code points that numpy handles at once.
SLICE = 1 << 18
#: Odd multipliers that mix the code points of an n-gram.
MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of the lower-cased text, in slices that overlap by the largest order."""
    most = max(ORDERS)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(points), SLICE):
        end = min(start + SLICE, len(points))
        c = points[start : min(len(points), end + most - 1)]
        with np.errstate(over="ignore"):
            h = np.zeros(len(c), np.uint32)
            for n in ORDERS:
                if len(c) < n:
                    break
                h = h[: len(c) - n + 1] * np.uint32(31) + c[n - 1 :] * np.uint32(MIX[n - 1])
                g = h[: end - start] ^ np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF)
                yield ((g * np.uint32(MIX[0])) >> np.uint32(16)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """What is learned: blocks of languages, each learned when it is asked for."""

    def __init__(self, train: DataFrame, lang: str = "lang", text: str = "text") -> None:
        self.rows = small_batches(train).where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray, bool]]:
        """(languages in code point order, their (BUCKETS + 1, languages) log weights, whether more follow); the prior is row BUCKETS."""
        rows, more = self.rows, True
        while more:
            names = [r.lang for r in rows.select("lang").distinct().orderBy("lang").limit(BLOCK + 1).collect()]
            more = len(names) > BLOCK
            if names:
                yield *learned(rows.where(F.col("lang") <= names[:BLOCK][-1])), more
                rows = rows.where(F.col("lang") > names[:BLOCK][-1])


def fit(train: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    return Model(train, lang, text)


def learned(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages (those with a text that has a letter) and log weights of the rows; the prior is the log of the number of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for label, value in zip(b.column(0), b.column(1)):
                value = value.as_py()
                if not has_letter(value):
                    continue
                c = counts.setdefault(label.as_py(), np.zeros(BUCKETS + 1, np.int64))
                for idx in buckets_of(value):
                    c[:BUCKETS] += np.bincount(idx, minlength=BUCKETS) if len(idx) > BUCKETS // 8 else 0
                    if len(idx) <= BUCKETS // 8:
                        np.add.at(c, idx, 1)
                c[BUCKETS] += 1
        for label, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([label] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BLOCK * (BUCKETS + 1) rows
    names = sorted(set(got.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(names)}
    c = np.zeros((BUCKETS + 1, len(names)))
    c[got.column("bucket").to_numpy(), [at[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    grams = c[:BUCKETS] + SMOOTHING
    return names, np.log(np.concatenate([grams / grams.sum(axis=0), c[BUCKETS:]]))


def scores(texts: list[str], logs: np.ndarray) -> np.ndarray:
    """Log scores (texts, languages): rows gathered for a group of texts at once, added by text."""
    totals = np.repeat(logs[BUCKETS:], len(texts), axis=0)
    held: list[np.ndarray] = []
    owner: list[int] = []
    size = 0

    def add() -> None:
        rows = np.add.reduceat(logs[np.concatenate(held)], np.cumsum([0, *map(len, held[:-1])]), axis=0)
        np.add.at(totals, owner, rows)
        held.clear(), owner.clear()

    for i, value in enumerate(texts):
        for idx in buckets_of(value):
            held.append(idx)
            owner.append(i)
            size += len(idx)
            if size * logs.shape[1] > 4 * SLICE:
                add()
                size = 0
    if held:
        add()
    return totals


def _guess(shared: object):
    """The UDF of one block of languages: (text, what is known so far) to what is known then."""
    kind = pa.struct([("lang", pa.string()), ("top", pa.float64()), ("total", pa.float64())])

    @F.arrow_udf("lang string, top double, total double")
    def guess(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names, logs = shared.value
        for texts, known in it:
            start = 0
            for batch in parts([texts]):
                rows, old = [x.as_py() for x in batch], known.slice(start, len(batch)).to_pylist()
                start += len(batch)
                told = [i for i, x in enumerate(rows) if has_letter(x)]
                if told:
                    t = scores([rows[i] for i in told], logs)
                    best = t.argmax(axis=1)
                    top = t[np.arange(len(told)), best]
                    total = top + np.log(np.exp(t - top[:, None]).sum(axis=1))
                    for i, b, x, y in zip(told, best, top, total):
                        now = {"lang": names[b], "top": float(x), "total": float(y)}
                        if old[i] is not None:  # an equal score belongs to the language before
                            now = {**(now if x > old[i]["top"] else old[i]), "total": float(np.logaddexp(old[i]["total"], y))}
                        old[i] = now
                yield pa.array(old, kind)

    return guess


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Adds ``out``: struct(lang, score); score is the posterior probability of the language."""
    state = free_name(df, "language")
    df = small_batches(df).withColumn(state, F.lit(None).cast("struct<lang:string,top:double,total:double>"))
    for names, matrix, more in model.blocks():
        if not names:
            continue
        shared = df.sparkSession.sparkContext.broadcast((names, matrix))
        df = df.withColumn(state, _guess(shared)(F.col(text), F.col(state)))
        df = written(df) if more else df
    s = F.col(state)
    found = F.struct(F.coalesce(s["lang"], F.lit("und")).alias("lang"), F.when(s["lang"].isNull(), 0.0).otherwise(F.exp(F.least(s["top"] - s["total"], F.lit(0.0)))).alias("score"))
    return df.withColumn(out, found).drop(state)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from two thirds of the labelled documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3) != 1)
    done = predict(docs.select("doc_id", "text"), fit(train))
    return done.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
