"""The reply store: what a model answers is written once and read back, so that no action calls it again.

A reply's key is a hash of the model's name, the system prompt and the prompt. Different prompts of a batch that have no usable reply yet are asked once
each; a reply that failed is kept as what happened, but asked again by the next batch. Calls are charged to one row of the batch that made them; rows that share
a prompt, or find an older reply, cost nothing. So the calls that are reported are the calls that were made, however often a result is read.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.functions import models
from tallgrove.operators.search import near
from tallgrove.sources.store import kept, scratch

STORED = f"key string, first string, reply struct<{models.COMPLETION.replace(' ', ':').replace(',:', ',')}>, run string"
#: A reply that costs nothing, with its text.
FREE = ("calls", "prompt_tokens", "completion_tokens", "latency_ms")


class Replies:
    """Replies below ``path``, which any number of runs share; without a path, of this run only."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark)

    def table(self) -> DataFrame:
        """(key, first, reply, run) of all runs."""
        try:
            return self.spark.read.schema(STORED).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], STORED)

    def ask(self, rows: DataFrame, call: models.Call | None, system: str, prompt: Column, out: str, when: Column | None = None, model: str = "model", by: str = "qid") -> DataFrame:
        """``rows`` with ``out``, the completion of each prompt; null where ``when`` does not hold. Written: neither rows nor replies are made again.

        Without a model nothing is stored: every text says so and no call is counted.
        """
        when = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
        if call is None:
            return kept(rows.withColumn(out, F.when(when, models.completion(None, system, prompt))))
        text = F.coalesce(prompt, F.lit(""))
        rows = kept(rows.withColumn("__prompt", F.when(when, text)).withColumn("__key", F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(system), "__prompt"), 256)))
        run, asked = uuid.uuid4().hex, rows.where("__prompt is not null")
        have = self.table().where(~models.failed(F.col("reply.text"))).select(F.col("key").alias("__key"))
        asked = asked.groupBy("__key").agg(F.first("__prompt").alias("prompt"), F.min(F.col(by).cast("string")).alias("first")).join(have, "__key", "left_anti")
        new = asked.select(F.col("__key").alias("key"), "first", models.completion(call, system, F.col("prompt")).alias("reply"), F.lit(run).alias("run"))
        new.write.mode("append").parquet(self.path)
        own = (F.col("run") == run).alias("own")
        known = self.table().where((F.col("run") == run) | ~models.failed(F.col("reply.text"))).select(F.col("key").alias("__key"), "first", "reply", own)
        known = known.groupBy("__key").agg(F.max_by(F.struct("first", "reply", "own"), "own").alias("__r"))
        # a prompt that many rows share is one row of the store
        told = rows.join(near(known.join(rows.select("__key").distinct(), "__key", "left_semi")), "__key", "left")
        charged = F.col("__r.own") & (F.col("__r.first") == F.col(by).cast("string"))
        free = F.struct(F.col("__r.reply.text").alias("text"), *(F.lit(0).cast("double" if c == "latency_ms" else "long").alias(c) for c in FREE))
        done = F.when(F.col("__prompt").isNull(), None).when(charged, F.col("__r.reply")).otherwise(free)
        return kept(told.withColumn(out, done).drop("__prompt", "__key", "__r"))
