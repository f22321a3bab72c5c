"""Daily sums of the query log, and percentiles by rank selection, against plain ones."""
import glob
import os
import random

import numpy as np
from pyspark.sql import functions as F

from tallgrove.operators import evaluation, records, rollups
from tallgrove.sources.store import kept


def queries_on(spark, *days):
    rows = [(i, f"q{i % 3}", f"{d} 12:00:00", 5, float(i + 1), i % 2 == 0) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "qid long, query string, timestamp string, top_k int, latency_ms double, cache_hit boolean").withColumn("timestamp", F.to_timestamp("timestamp"))


def rounded(row):
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.asDict().items()}


def test_statistics_read_the_days_of_their_window_only(spark, tmp_path):
    log = records.QueryLog(spark, str(tmp_path / "log"))
    results = spark.createDataFrame([(i, 1, 0.1 * i, None if i % 2 else 1.0 * i) for i in range(0, 12, 2)], "qid long, rank int, similarity double, rerank_score double")
    days = [f"2024-01-{d:02d}" for d in (1, 2, 3, 20, 24, 25, 28, 30, 31, 31)]
    log.log_queries(queries_on(spark, *days), results)
    plain = lambda: (rounded(evaluation.query_stats(log.table("queries"), "2024-01-31", 7).first()), [rounded(r) for r in evaluation.top_queries(log.table("queries"), 5).collect()])
    ours = lambda: (rounded(log.query_stats("2024-01-31", 7).first()), [rounded(r) for r in log.top_queries(5).collect()])
    assert ours() == plain() and log.rolled_up().count() == 0
    log.roll_up(["2024-01-01", "2024-01-24", "2024-01-25", "2024-01-31"])
    assert ours() == plain() and {str(r.day) for r in log.rolled_up().collect()} == {"2024-01-01", "2024-01-24", "2024-01-25", "2024-01-31"}
    log.log_queries(queries_on(spark, "2024-01-25", "2024-01-29"), results)  # late rows of a day that has sums
    log.roll_up(["2024-01-25"])  # again: nothing counts twice
    want = plain()
    assert ours() == want and want[0]["total_queries"] == 8
    for f in glob.glob(f"{log.path}/queries/day=*/*.parquet") + glob.glob(f"{log.path}/daily/day=*/*.parquet"):
        day = f.split("day=")[1][:10]
        if day < "2024-01-24" or "/queries/" in f and day in ("2024-01-24", "2024-01-25", "2024-01-31"):
            with open(f, "r+b") as x:  # the footer stays
                x.seek(4)
                x.write(b"\xff" * 24)
            crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
            os.path.exists(crc) and os.remove(crc)
    assert rounded(log.query_stats("2024-01-31", 7).first()) == want[0]


def test_percentiles_of_any_group(spark):
    r = random.Random(2)
    groups = {
        "one": [5.0], "same": [2.5] * 400, "hot": [r.gauss(0, 1) for _ in range(3000)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 308) for _ in range(800)], "ends": [-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1e-323],
        "steps": [float(i % 7) for i in range(500)], None: [float(i) for i in range(37)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    ps = [0.0, 0.01, 0.5, 0.95, 0.99, 1.0]
    for cells, leaves in ((64, 100), (1024, 100_000)):
        got = {x.k: x.percentiles for x in rollups.percentiles(df, "k", "v", ps, kept, cells, leaves).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            s = sorted(vs)
            for p, x in zip(ps, got[k]):
                h = (len(s) - 1) * p
                a, b = s[int(np.floor(h))], s[int(np.ceil(h))]
                assert x == a if a == b else np.isclose(x, a + (b - a) * (h - np.floor(h)), rtol=1e-12, atol=0) or (k == "ends" and abs(b) > 1e308), (k, p, x)
    assert rollups.percentiles(df.limit(0), "k", "v", ps, kept).count() == 0
