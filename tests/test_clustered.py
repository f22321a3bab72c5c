"""Dense search by cells equals a full scan, and skips what it may."""
import numpy as np
from pyspark.sql import functions as F

from tallgrove.operators import search
from tallgrove.operators.clustered import Clustered


def test_cells_are_skipped_and_results_stay(spark, tmp_path):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 8)) * 4
    rows = [(int(i), (centres[i % 12] + draw.normal(size=8) * 0.1).tolist()) for i in range(600)] + [(1000, None), (1001, centres[0].tolist()), (1002, centres[0].tolist())]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(i, centres[i].tolist()) for i in range(3)] + [(3, [0.0] * 8), (4, None)], "qid long, q array<double>")
    rank = lambda d: sorted((r.qid, r["rank"], r.id, round(r.score, 9)) for r in d.collect())
    index = Clustered(spark, str(tmp_path / "c"))
    index.build(v, "id", cells=24)
    some = q.where("qid < 3")
    for k in (1, 5, 70):
        assert rank(index.search(some, "id", k)) == rank(search.dense(v, some, "id", k))
        assert 0 < len(index.read) < len(index.cells)
    assert rank(index.search(q, "id", 10)) == rank(search.dense(v, q, "id", 10)) and index.read == index.cells  # all are equally far from nothing
    assert rank(index.search(some, "id", 1000)) == rank(search.dense(v, some, "id", 1000))
    assert index.search(q.limit(0), "id", 3).count() == 0
    empty = Clustered(spark, str(tmp_path / "e"))
    empty.build(v.where(F.col("embedding").isNull()), "id")
    assert empty.search(q, "id", 3).count() == 0
