"""Text functions as Column expressions."""
from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.isspace has it.
WS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased words between white space; punctuation stays; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), rf"(?U){WS}+"), lambda x: x != "")


def first_tokens(c: Column, n: int) -> Column:
    """The first ``n`` of ``tokens``; the rest of the text is not cut."""
    begun = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"(?U)^{WS}+", "")
    return F.slice(F.filter(F.split(begun, rf"(?U){WS}+", n + 1), lambda x: x != ""), 1, n)


def normalize(c: Column) -> Column:
    """Lower case, runs of white space as one space; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


#: Sentence ends, and section headers in the order in which they are tried.
SENTENCE_END = r"(?<=[.!?])\s+|\n\s*\n|\n(?=\d+[.)]\s)|\n(?=[A-Z])"
HEADERS = (
    r"^(\d+\.\d*\.?\d*)\s+([A-Z][^\n]+)",
    r"^([A-Z][A-Z\s]{3,}[A-Z])$",
    r"^(STEP\s+\d+[:\.])\s*(.+)",
    r"^(Procedure\s+\d+[:\.])\s*(.+)",
)
#: Patterns of values in answers: addresses, Windows paths, unix paths of two segments or more, numbers.
VALUES = (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"[A-Za-z]:\\[^\s]+", r"(?:/[\w.-]+){2,}", r"\b\d+(?:\.\d+)?\b")
#: Phrases by which an answer abstains.
ABSTAINS = (
    "not in the", "could not find", "couldn't find", "no information", "does not contain", "doesn't contain",
    "not available in", "not found in", "unable to find", "insufficient information",
)


def sentences(c: Column) -> Column:
    """Sentences in order, stripped, empties dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_END), strip), lambda x: x != "")


def is_header(line: Column) -> Column:
    """Whether a stripped line is a section header of one of the four kinds."""
    out = F.lit(False)
    for p in HEADERS:
        out = out | line.rlike(p)
    return out


def value_tokens(c: Column) -> Column:
    """Different values of a text, of two characters or more, in order of pattern, then place."""
    found = F.concat(*(F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0)) for p in VALUES))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 1))


def answer_body(c: Column) -> Column:
    """An answer before its references, footnote marks blanked."""
    return F.regexp_replace(F.substring_index(F.coalesce(c, F.lit("")), "References", 1), r"\[\^\d+\]", " ")


def values_checked(answer: Column, source: Column) -> Column:
    """An array of one struct(n, mismatches): how many values an answer has, and those that the source lacks, sorted; white space of the source collapsed.

    Both texts are gone through once: what a lambda is handed is not worked out again for each value.
    """
    flat = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?U)\s+", " ")
    both = F.struct(value_tokens(answer_body(answer)).alias("found"), flat.alias("flat"))
    lacking = lambda x: F.array_sort(F.filter(x["found"], lambda t: ~F.contains(x["flat"], t)))
    return F.transform(F.array(both), lambda x: F.struct(F.size(x["found"]).alias("n"), lacking(x).alias("mismatches")))


def grounding(answer: Column, source: Column) -> Column:
    """Share of the answer's values that the source holds; null if it has none."""
    share = lambda x: F.when(x["n"] > 0, (x["n"] - F.size(x["mismatches"])) / x["n"])
    return F.get(F.transform(values_checked(answer, source), share), 0)


def value_mismatches(answer: Column, source: Column) -> Column:
    """Values of the answer that the source lacks, sorted."""
    return F.get(values_checked(answer, source), 0)["mismatches"]


def _normalized_once(c: Column, found: Callable[[Column], Column]) -> Column:
    """``found`` of the normalised text, which is made once: what stands inside a lambda is worked out again for each element."""
    return F.get(F.transform(F.array(normalize(c)), found), 0)


def abstained(answer: Column) -> Column:
    return _normalized_once(answer, lambda flat: functools.reduce(operator.or_, (F.contains(flat, F.lit(m)) for m in ABSTAINS)))


def fact_coverage(answer: Column, facts: Column) -> Column:
    """Share of the facts whose normalised text the normalised answer holds; null if there are none."""
    hits = _normalized_once(answer, lambda flat: F.size(F.filter(facts, lambda f: F.contains(flat, normalize(f)))))
    return F.when(F.size(facts) > 0, hits / F.size(facts))


def must_cite_recall(cited: Column, must: Column) -> Column:
    """Share of the names that must be cited which hold or are held by a cited name; null if there are none."""
    hits = F.size(F.filter(must, lambda x: F.exists(cited, lambda d: F.contains(d, x) | F.contains(x, d))))
    return F.when(F.size(must) > 0, hits / F.size(must))


def citation_validity(cited: Column, retrieved: Column) -> Column:
    """Share of the cited ids that were retrieved; null without citations."""
    return F.when(F.size(cited) > 0, F.size(F.filter(cited, lambda c: F.array_contains(retrieved, c))) / F.size(cited))


def chunk_id(doc: Column, page: Column, i: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("_p"), page.cast("string"), F.lit("_c"), i.cast("string"))


def chunk_index(chunk: Column) -> Column:
    """The trailing number of ``..._c12``, else 0."""
    return F.coalesce(F.regexp_extract(chunk, r"_c(\d+)$", 1).try_cast("int"), F.lit(0))


def page_key(page: Column) -> list[Column]:
    """Sort columns: numeric pages by number, then the others by text."""
    n = page.cast("string").try_cast("int")
    return [n.isNull(), n, page.cast("string")]


#: A reference to a section, and a fenced block in a model's reply.
XREF = r"(?i)\b(?:see\s+)?section\s+(\d+(?:\.\d+)*)\b"
FENCE = r"```(?:json)?\s*(.*?)```"


def xrefs(text: Column) -> Column:
    """Numbers of the sections that a text refers to."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(XREF), F.lit(1)))


def source_block(doc: Column, page: Column, section: Column, chunk: Column, text: Column, with_id: bool = True) -> Column:
    """``[Source: d, Page p, Section: s, id: i]`` and the text below it."""
    named = F.when(F.coalesce(section, F.lit("")) == "", "N/A").otherwise(section)
    head = [F.lit("[Source: "), doc.cast("string"), F.lit(", Page "), page.cast("string"), F.lit(", Section: "), named]
    return F.concat(*head, *([F.lit(", id: "), chunk] if with_id else []), F.lit("]\n"), text)


def embedding_text(doc: Column, section: Column, summary: Column, questions: Column, text: Column) -> Column:
    """Header, summary, questions and text, the empty ones left out, a line each."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    head = F.array_join(F.filter(F.array(empty(doc), empty(section)), lambda x: x != ""), " > ")
    asked = F.coalesce(F.array_join(questions, " "), F.lit(""))
    asked = F.when(asked == "", "").otherwise(F.concat(F.lit("Questions answered: "), asked))
    return F.array_join(F.filter(F.array(head, empty(summary), asked, empty(text)), lambda x: x != ""), "\n")


def embedding_source(embedding: Column, text: Column) -> Column:
    """``embedding`` unless it is null or empty."""
    return F.coalesce(F.nullif(embedding, F.lit("")), text)


def citation_label(doc: Column, page: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit(", Page "), page.cast("string"))


def snippet(text: Column, most: int = 240) -> Column:
    """The first characters of a text, as a preview."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def confidence(llm: Column, ratio: Column, mismatches: Column) -> Column:
    """low with any mismatch; high from 0.95 if the model says high; medium from 0.75; else low."""
    return F.when(F.size(mismatches) > 0, "low").when((ratio >= 0.95) & (llm == "high"), "high").when(ratio >= 0.75, "medium").otherwise("low")


def enrichment(raw: Column, most: int = 5) -> Column:
    """struct(summary, questions) from a model's reply: the greedy ``{...}`` in it; '' and [] if it does not parse."""
    body = F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    v = F.try_parse_json(body)
    questions = F.coalesce(F.try_variant_get(v, "$.questions", "array<string>"), F.array().cast("array<string>"))
    clean = F.slice(F.filter(F.transform(questions, lambda q: strip(F.coalesce(q, F.lit("")))), lambda q: q != ""), 1, most)
    return F.struct(strip(F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.lit(""))).alias("summary"), clean.alias("questions"))


def balanced_json(raw: str | None) -> str | None:
    """JSON in a model's reply: all of it, else a fenced block, else the first balanced object or array."""
    import json
    import re

    def good(s: str) -> bool:
        try:
            json.loads(s)
            return True
        except ValueError:
            return False

    if not raw:
        return None
    text = raw.strip()
    if good(text):
        return text
    if (m := re.search(FENCE, text, re.S)) and good(m[1].strip()):
        return m[1].strip()
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    at, depth = min(starts), 0
    opener, closer = ("{", "}") if text[at] == "{" else ("[", "]")
    for i in range(at, len(text)):
        depth += (text[i] == opener) - (text[i] == closer)
        if depth == 0:
            return text[at : i + 1] if good(text[at : i + 1]) else None
    return None


def llm_json(raw: Column) -> Column:
    """``balanced_json`` over Arrow batches; Spark's own parser would take text after the JSON for part of it."""
    @F.arrow_udf("string")
    def parse(x: pa.Array) -> pa.Array:
        return pa.array([balanced_json(v.as_py()) for v in x], pa.string())

    return parse(raw)


def planned(raw: Column, query: Column, most: int = 5) -> Column:
    """struct(sub_queries array of (text, intent), is_complex) from a planner's JSON; the query itself if it has none."""
    v = F.try_parse_json(raw)
    given = F.coalesce(F.try_variant_get(v, "$.sub_queries", "array<struct<text:string,intent:string>>"), F.array().cast("array<struct<text:string,intent:string>>"))
    clean = F.transform(F.slice(given, 1, most), lambda s: F.struct(strip(F.coalesce(s["text"], F.lit(""))).alias("text"), F.coalesce(F.nullif(strip(F.coalesce(s["intent"], F.lit(""))), F.lit("")), F.lit("general")).alias("intent")))
    clean = F.filter(clean, lambda s: s["text"] != "")
    subs = F.when(F.size(clean) > 0, clean).otherwise(F.array(F.struct(query.alias("text"), F.lit("general").alias("intent"))))
    return F.struct(subs.alias("sub_queries"), F.coalesce(F.try_variant_get(v, "$.is_complex", "boolean"), F.size(subs) > 1).alias("is_complex"))
