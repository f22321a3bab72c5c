"""Change detection and index upkeep."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, change): new, modified, deleted or unchanged files, from (name, mtime, size) of both sides."""
    c = current.select("name", F.col("mtime").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("here"))
    m = manifest.select("name", F.col("mtime").alias("m2"), F.col("size").alias("s2"), F.lit(True).alias("known"))
    both = c.join(m, "name", "full_outer")
    change = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "deleted").when((F.col("m1") != F.col("m2")) | (F.col("s1") != F.col("s2")), "modified").otherwise("unchanged")
    return both.select("name", change.alias("change"))


#: Rows that one task numbers.
RANGE = 1_000_000


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds dense numbers from 1 on in the order of some columns.

    Rows are cut into ranges of about ``RANGE`` by bounds from a sample (any bounds give the same numbers), ranked inside their
    range, and the ranges' offsets are added: no task sees more than a range, however the first column is spread.
    """
    n = df.count()
    key = F.struct(*order)
    ranges = -(-n // RANGE)
    part = F.lit(0)
    if ranges > 1:
        kinds = dict(df.dtypes)
        sample = df.select(*order).sample(min(1.0, 20 * ranges / n), seed=7).collect()
        bounds = sorted(sample, key=lambda r: tuple((v is not None, v) for v in r))[10::20]
        if bounds:
            part = F.size(F.filter(F.array(*(F.struct(*(F.lit(r[c]).cast(kinds[c]).alias(c) for c in order)) for r in bounds)), lambda b: b <= key))
    rows = df.withColumn("__p", part)
    ahead = F.coalesce(F.sum("k").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy(F.col("__p").alias("q")).agg(F.count(F.lit(1)).alias("k")).select("q", ahead.alias("__a"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return rows.withColumn("__i", inside).join(F.broadcast(offsets), F.col("__p") == F.col("q")).withColumn(name, (F.col("__a") + F.col("__i")).cast("long")).drop("__p", "__i", "q", "__a")


def appended(index: DataFrame, fresh: DataFrame, order: list[str]) -> DataFrame:
    """Index rows plus new rows, whose ``ord`` goes on densely after the largest one, in the order of some columns."""
    top = index.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("__top"))
    rows = numbered(fresh, order, "__ord").crossJoin(F.broadcast(top)).withColumn("ord", (F.col("__top") + F.col("__ord")).cast("long"))
    return index.unionByName(rows.select(index.columns))


def without_deleted(index: DataFrame, current: DataFrame, doc: str = "doc_name") -> DataFrame:
    """Index rows whose document is still there."""
    return index.join(current.select(F.col("name").alias("__n")), F.col(doc) == F.col("__n"), "left_semi")
