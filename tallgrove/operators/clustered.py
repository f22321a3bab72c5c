"""Exact dense search that skips files: vectors lie in cells around centroids, and a cell is read only if its bound reaches a query's k-th best score.

The inner product of a query q with a vector within ``radius`` of a centroid c is at most  q c + |q| radius.  A first pass reads the cells nearest to the queries
and gives each its k-th best score so far; a second one reads the other cells whose bound reaches it. What is skipped cannot be among the best k, so
results equal those of a full scan. Centroids come from a bounded sample and only decide what lies together.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.operators import search

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Vectors that the centroids are made of at most, rounds of making them, and cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 8, 4096
#: What a bound is raised by, as scores are compared to nine digits.
SLACK = 2e-9


def centroids(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Means of the sample's nearest groups, after a few rounds from different vectors of it."""
    own = np.unique(sample, axis=0)
    c = own[np.random.default_rng(seed).permutation(len(own))[:cells]]
    for _ in range(ROUNDS):
        near = np.argmin((c * c).sum(axis=1) - 2 * sample @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Clustered:
    """Vectors in cells below ``path``: ``vectors`` (a folder a cell) and ``cells`` (cell, centroid, radius, n)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        #: Cells that the last search read, and all that there are.
        self.read: set[int] = set()
        self.cells: set[int] = set()

    def build(self, vectors: DataFrame, key: str, vector: str = "embedding", cells: int = 64) -> None:
        """Writes vectors (key, vector); null ones are left out. About the square root of their number is a good number of cells, ``MOST_CELLS`` at most."""
        rows = vectors.select(key, F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        every = max(1, rows.count() // SAMPLE)
        held = rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select("v").limit(2 * SAMPLE).toArrow().column(0).combine_chunks()
        sample = held.flatten().to_numpy().reshape(len(held), -1) if len(held) else np.zeros((0, 1))
        c = centroids(sample, min(cells, MOST_CELLS)) if len(sample) else sample
        shared = self.spark.sparkContext.broadcast(c)  # at most MOST_CELLS vectors
        kind = dict(vectors.dtypes)[key]

        def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in it:
                if b.num_rows:
                    v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                    cell = np.argmin((c * c).sum(axis=1) - 2 * v @ c.T, axis=1)
                    yield pa.record_batch([*b.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(((v - c[cell]) ** 2).sum(axis=1)))], [key, "v", "cell", "far"])

        found = rows.mapInArrow(assign, f"`{key}` {kind}, v array<double>, cell int, far double")
        spread = F.pmod(F.xxhash64(key), F.lit(8))  # a large cell is several files
        found.repartition("cell", spread).write.partitionBy("cell").parquet(f"{self.path}/vectors")
        sizes = self.spark.read.schema(f"`{key}` {kind}, v array<double>, far double, cell int").parquet(f"{self.path}/vectors").groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"))
        means = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cell int, centroid array<double>")
        means.join(sizes, "cell").write.parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, key: str, k: int) -> DataFrame:
        """``search.dense`` of all vectors for queries (qid, q): (qid, rank, key, score)."""
        about = self.spark.read.parquet(f"{self.path}/cells").toArrow()
        ids, n, radius = (about.column(x).to_numpy() for x in ("cell", "n", "radius"))
        self.read, self.cells = set(), set(ids.tolist())
        own = queries.select("qid", "q").where("q is not null").toArrow() if len(ids) else None
        vectors = self.spark.read.parquet(f"{self.path}/vectors") if len(ids) else None
        if own is None or not own.num_rows:
            kind, of = queries.schema["qid"].dataType.simpleString(), dict(vectors.dtypes)[key] if vectors is not None else "long"
            return self.spark.createDataFrame([], f"qid {kind}, rank int, `{key}` {of}, score double")
        q = np.array(own.column("q").to_pylist(), np.float64)
        close = q @ np.array(about.column("centroid").to_pylist(), np.float64).T
        order = np.argsort(-close, axis=1, kind="stable")
        enough = np.cumsum(n[order], axis=1) - n[order] < k  # the nearest cells until they hold k vectors
        first = sorted({int(ids[i]) for i in order[enough]})
        part = lambda cells: search.dense(vectors.where(F.col("cell").isin(cells)).drop("cell"), queries, key, k, "v")
        hits = part(first)
        least = {r.qid: r.score for r in hits.where(F.col("rank") == k).select("qid", "score").collect()}
        bound = close + np.sqrt((q * q).sum(axis=1))[:, None] * radius
        reach = bound >= np.array([least.get(x, -np.inf) for x in own.column("qid").to_pylist()])[:, None] - SLACK
        more = sorted({int(i) for i in ids[reach.any(axis=0)]} - set(first))
        self.read = {*first, *more}
        both = hits.drop("rank").unionByName(part(more).drop("rank")) if more else hits.drop("rank")
        return search.ranked(both, "score", key, k=k).select("qid", "rank", key, "score")
