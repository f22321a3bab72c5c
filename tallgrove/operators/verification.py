"""Claim checks: a verifier's JSON reply, the verified answer, removed claims, and a confidence that values not found in the sources veto."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallgrove.functions import text as T

CLAIM = "struct<claim:string,supported:boolean,cited_chunk_id:string,reason:string>"


def prompt(answer: Column, chunks: Column) -> Column:
    """What a verifier is asked: the answer and all sources (array of struct with chunk_id, doc_name, page, text)."""
    source = F.transform(chunks, lambda c: F.concat(F.lit("[id: "), c["chunk_id"], F.lit(" | "), c["doc_name"].cast("string"), F.lit(" p"), c["page"].cast("string"), F.lit("]\n"), c["text"]))
    return F.concat(F.lit("ANSWER:\n"), F.coalesce(answer, F.lit("")), F.lit("\n\nSOURCES:\n"), F.array_join(source, "\n\n"), F.lit("\n\nReturn the verification JSON."))


def supported_ratio(checks: Column) -> Column:
    """Share of supported claims of an array; 0 without claims."""
    return F.when(F.size(checks) > 0, F.size(F.filter(checks, lambda c: c["supported"])) / F.size(checks)).otherwise(F.lit(0.0))


def verified(answer: Column, chunks: Column, reply: Column, value_check: bool = True) -> Column:
    """struct(verified_answer, confidence, claim_checks, removed_claims, mismatches) from a verifier's reply.

    Without an answer, without sources or without JSON in the reply the answer stays as it is, at low confidence.
    """
    none, no_texts = F.array().cast(f"array<{CLAIM}>"), F.array().cast("array<string>")
    v = F.try_parse_json(T.llm_json(reply))
    usable = (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(F.size(chunks), F.lit(0)) > 0) & F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("")), F.lit("OBJECT"))
    text = lambda c, f: T.strip(F.coalesce(c[f], F.lit(""))).alias(f)
    claims = F.coalesce(F.try_variant_get(v, "$.claims", f"array<{CLAIM}>"), none)
    claims = F.transform(claims, lambda c: F.struct(text(c, "claim"), F.coalesce(c["supported"], F.lit(False)).alias("supported"), text(c, "cited_chunk_id"), text(c, "reason")))
    checks = F.when(usable, claims).otherwise(none)
    removed = F.transform(F.filter(checks, lambda c: ~c["supported"] & (c["claim"] != "")), lambda c: c["claim"])
    given = F.nullif(F.try_variant_get(v, "$.verified_answer", "string"), F.lit(""))
    final = F.when(usable, T.strip(F.coalesce(given, answer))).otherwise(answer)
    said = F.lower(T.strip(F.coalesce(F.nullif(F.try_variant_get(v, "$.confidence", "string"), F.lit("")), F.lit("low"))))
    bad = T.value_mismatches(final, F.array_join(F.transform(chunks, lambda c: c["text"]), " ")) if value_check else no_texts
    bad = F.when(usable, bad).otherwise(no_texts)
    level = F.when(usable, T.confidence(said, supported_ratio(checks), bad)).otherwise("low")
    return F.struct(final.alias("verified_answer"), level.alias("confidence"), checks.alias("claim_checks"), removed.alias("removed_claims"), bad.alias("mismatches"))
