"""The enrichment stage: summary, questions and the text to be embedded, written back to the chunks."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrove.functions import text as T

MADE = ("summary", "questions", "embedding_text")


def prompt(text: Column) -> Column:
    return F.concat(F.lit("document excerpt:\n"), F.coalesce(text, F.lit("")), F.lit("\n\nEnrichment JSON:"))


def enriched(chunks: DataFrame, llm: Callable[[Column], Column], most: int = 5) -> DataFrame:
    """Chunks with summary, at most ``most`` questions and embedding_text from a model's replies; a reply that is no JSON, or an error's text, gives none, and the text is embedded alone."""
    kept = [c for c in chunks.columns if c.lower() not in MADE]
    d = chunks.select(*kept).withColumn("__e", T.enrichment(llm(prompt(F.col("text"))), most))
    e = F.col("__e")
    whole = T.embedding_text(F.col("doc_name").cast("string"), F.col("section"), e["summary"], e["questions"], F.col("text"))
    return d.select(*kept, e["summary"].alias("summary"), e["questions"].alias("questions"), whole.alias("embedding_text"))
