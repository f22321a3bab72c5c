"""Shared helpers of the training-data operators."""
from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the characters that separate words in every operator here.
WHITE = r"\x20\x09-\x0D"
#: Where intermediates go if spark.checkpoint.dir is unset and all of Spark is one process on one machine (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20
#: Bytes of a row group of intermediate tables, which a task holds when it writes and reads large values.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands at most ``ARROW_BYTES`` (and one row) at once to Python workers, so that neither they nor the JVM's buffers grow with the rows."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key)
    if not re.fullmatch(r"\d+b?", now) or int(now.rstrip("b")) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df


def session_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one that spark.checkpoint.dir names; a cluster without that setting is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        top = LOCAL_CHECKPOINTS
    return f"{top.rstrip('/')}/tallgrove-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder for one intermediate table."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application. Call it once the results that were made from them are stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: cuts lineage, survives executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    out = df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    (out.partitionBy(*parts) if parts else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns; maps and variants, which Spark does not hash, by their JSON."""
    plain = lambda c: not re.search('"(map|variant)"', df.schema[c].dataType.json())
    return F.xxhash64(*(F.col(f"`{c}`") if plain(c) else F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns))


def batches(it, columns: int = 0, most: int = 8 << 20):
    """Arrow batches cut so that none holds more than about ``most`` bytes of the text column."""
    for b in it:
        start, size = 0, 0
        column = b.column(columns)
        for i in range(b.num_rows):
            v = column[i]
            size += 16 if not v.is_valid else len(v.as_buffer() or b"")
            if size > most:
                yield b.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def near(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; else it is joined as Spark plans it."""
    return F.broadcast(df) if df.count() <= most else df


def parts(texts, most: int = 2 << 20):
    """Arrow arrays of texts cut so that none holds more than about ``most`` bytes: an iterator UDF then keeps little at once."""
    for a in texts:
        start, size = 0, 0
        for i, v in enumerate(a):
            size += 16 if not v.is_valid else len(v.as_buffer() or b"")
            if size > most:
                yield a.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < len(a):
            yield a.slice(start)
