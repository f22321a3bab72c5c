"""Query-log statistics from daily sums, and exact percentiles by rank selection.

A day's rows of a query add up to one row, from which the statistics of any window are sums; the queries of a window are the different ones of its rows.
Percentiles are found by histograms that are refined around the wanted ranks, so that a group of any size is never held by one task.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrove.operators.search import near

#: Columns of a log that are averaged: the sum and the number of values of each are kept.
AVERAGED = ("latency_ms", "num_results", "avg_similarity", "avg_rerank_score")


def daily(log: DataFrame) -> DataFrame:
    """(day, query, n, cache_hits, sum_* and count_* of ``AVERAGED``): one row a day and query, which add up."""
    day = F.to_date("timestamp").alias("day")
    sums = [f for c in AVERAGED for f in (F.sum(F.col(c).cast("double")).alias(f"sum_{c}"), F.count(c).alias(f"count_{c}"))]
    return log.groupBy(day, "query").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)).cast("long").alias("cache_hits"), *sums)


def _mean(c: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(f"sum_{c}"), F.sum(f"count_{c}")), F.lit(0.0))


def query_stats(days: DataFrame, today: str, window: int) -> DataFrame:
    """``evaluation.query_stats`` of the log that the daily rows came from."""
    d = days.where(F.col("day") >= F.date_sub(F.lit(today).cast("date"), window))
    total, hits = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("cache_hits"), F.lit(0))
    return d.agg(
        total.cast("long").alias("total_queries"), _mean("latency_ms").alias("avg_latency_ms"), _mean("num_results").alias("avg_results"), _mean("avg_similarity").alias("avg_similarity"),
        _mean("avg_rerank_score").alias("avg_rerank_score"), hits.cast("long").alias("cache_hits"), F.count_distinct("query").alias("unique_queries"),
        F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("cache_hit_rate"),
    )


def top_queries(days: DataFrame, limit: int = 10) -> DataFrame:
    """``evaluation.top_queries`` of the log that the daily rows came from."""
    mean = lambda c: F.try_divide(F.sum(f"sum_{c}"), F.sum(f"count_{c}")).alias(c)
    g = days.groupBy("query").agg(F.sum("n").cast("long").alias("n"), mean("latency_ms").alias("avg_latency_ms"), mean("avg_similarity"))
    return g.orderBy(F.desc("n"), "query").limit(limit)


def _magnitude(x: Column) -> Column:
    """Grows with x: the binary logarithm of its size, from 0 on, with its sign."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


#: Cells of a histogram, and values of a cell up to which they are sorted in one task.
CELLS, LEAVES = 1024, 100_000


def percentiles(df: DataFrame, by: str, value: str, ps: list[float], keep: Callable[[DataFrame], DataFrame], cells: int | None = None, leaves: int | None = None) -> DataFrame:
    """(by, percentiles array in the order of ``ps``): exact, with linear interpolation, of the values of each group that are not null or NaN.

    Each pass counts the values of the cells that a wanted rank may be in and goes on with the cell that it is in: its least and greatest value, and how many are below.
    Cells of one value or of at most ``leaves`` end the search. A pass reads the column once and shuffles counts; a row of state is a group's rank.
    Groups without values are left out. ``keep`` writes a table.
    """
    cells, leaves = cells or CELLS, leaves or LEAVES
    rows = df.select(F.col(by).alias("__by"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    sizes = keep(rows.groupBy("__by").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    at = F.array(*(F.lit(float(p)) for p in ps))
    wanted = F.array_sort(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor((F.col("n") - 1) * p), F.ceil((F.col("n") - 1) * p))))))
    open_ = sizes.select("__by", "low", "high", "n", F.lit(0).cast("long").alias("below"), F.explode(wanted).alias("r"))
    found = None
    while True:
        # several ranks share a cell until they part
        spans = open_.groupBy("__by", "low", "high", "n", "below").agg(F.collect_set("r").alias("rs"))
        done = spans.where("low = high").select("__by", F.explode("rs").alias("r"), F.col("low").alias("x"))
        last = spans.where(f"low <> high and n <= {leaves}")
        inside = lambda s: rows.join(near(s.withColumnRenamed("__by", "__of")), F.col("__by").eqNullSafe(F.col("__of")) & F.col("v").between(F.col("low"), F.col("high")))
        ends = inside(last).groupBy("__of", "below", F.col("rs")).agg(F.array_sort(F.collect_list("v")).alias("vs"))
        ends = ends.select(F.col("__of").alias("__by"), F.explode("rs").alias("r"), "vs", "below").select("__by", "r", F.get("vs", (F.col("r") - F.col("below")).cast("int")).alias("x"))
        part = keep(done.unionByName(ends))
        found = part if found is None else found.unionByName(part)
        more = spans.where(f"low <> high and n > {leaves}")
        if more.isEmpty():
            break
        # cells are even on a scale of magnitudes, which may differ by hundreds of decades, and from there on within a factor of four
        near_ = ((F.col("low") > 0) & (F.col("high") <= 4 * F.col("low"))) | ((F.col("high") < 0) & (F.col("low") >= 4 * F.col("high")))
        even = lambda f: F.try_divide(f(F.col("v")) - f(F.col("low")), f(F.col("high")) - f(F.col("low")))
        share = F.when(near_, even(lambda x: x)).otherwise(even(_magnitude))
        cell = F.when(F.col("v") == F.col("high"), cells).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1)))
        counts = inside(more).groupBy("__of", "low", "high", "below", "rs", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("__of", "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("from", F.col("below") + before).withColumn("r", F.explode("rs")).where((F.col("r") >= F.col("from")) & (F.col("r") < F.col("from") + F.col("n")))
        open_ = keep(counts.select(F.col("__of").alias("__by"), F.col("a").alias("low"), F.col("b").alias("high"), "n", F.col("from").cast("long").alias("below"), "r"))
    ranks = found.groupBy("__by").agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("xs"))
    both = sizes.select(F.col("__by").alias("__b"), "n").join(ranks, F.col("__b").eqNullSafe(F.col("__by")))

    def between(p: Column) -> Column:
        h = (F.col("n") - 1) * p
        a, b = F.col("xs")[F.floor(h)], F.col("xs")[F.ceil(h)]
        return F.when(a == b, a).otherwise(a + (b - a) * (h - F.floor(h)))

    return both.select(F.col("__by").alias(by), F.transform(at, between).alias("percentiles"))
