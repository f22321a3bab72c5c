"""Context assembly, cross references and citations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrove.functions.text import chunk_index, page_key, source_block, strip, xrefs

BUDGET = 12_000


def _within(chunks: DataFrame, by: str, budget: int) -> DataFrame:
    """(__by, __own, __ns): of each different chunk that stays its hash and its places in document, page and chunk order."""
    block = source_block(F.col("doc_name"), F.col("page"), F.col("section"), F.col("chunk_id"), F.col("text"))
    order = [F.col("doc_name"), *page_key(F.col("page")), chunk_index(F.col("chunk_id")), F.col("chunk_id"), F.col("__own")]
    w = Window.partitionBy("__by").orderBy(*order)
    lean = chunks.select(F.col(by).alias("__by"), "doc_name", "page", "chunk_id", _own().alias("__own"), F.length(block).alias("__len"))
    lean = lean.withColumn("__n", F.row_number().over(w)).withColumn("__sum", F.sum("__len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lean.where((F.col("__sum") <= budget) | (F.col("__n") == 1)).groupBy("__by", "__own").agg(F.collect_list("__n").alias("__ns"))


def _own() -> Column:
    return F.xxhash64("doc_name", "page", "section", "chunk_id", "text")


def assembled(chunks: DataFrame, by: str = "qid", budget: int = BUDGET) -> DataFrame:
    """(by, context, n_blocks): blocks in document, page and chunk order until the next would exceed the budget; the first always stays.

    Chunks are ordered by their keys and the lengths of their blocks; only the blocks that stay are joined to them.
    """
    block = source_block(F.col("doc_name"), F.col("page"), F.col("section"), F.col("chunk_id"), F.col("text"))
    texts = chunks.select(by, _own().alias("__key"), block.alias("__b"))
    found = texts.join(_within(chunks, by, budget), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__key") == F.col("__own"))).select(by, F.explode("__ns").alias("__n"), "__b")
    blocks = F.sort_array(F.collect_set(F.struct("__n", "__b")))  # a set, as equal chunks find each other's places
    return found.groupBy(by).agg(blocks.alias("__bs")).select(by, F.array_join(F.transform("__bs", lambda x: x["__b"]), "\n\n").alias("context"), F.size("__bs").cast("long").alias("n_blocks"))


def ordered(chunks: DataFrame, by: str = "qid", budget: int = BUDGET) -> DataFrame:
    """The chunks that ``assembled`` keeps, with all their columns and their ``place``."""
    kept = _within(chunks, by, budget)
    found = chunks.withColumn("__key", _own()).join(kept, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__key") == F.col("__own")))
    return found.select(*(F.col(c) for c in chunks.columns), F.explode("__ns").alias("place")).dropDuplicates([by, "place"])


def referenced(have: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, ref, chunks' columns): for each query's own chunks ``have`` (qid, chunk_id, doc_name, text[, rank]) those of the same documents whose section number
    starts with one that they refer to, and that the query has not got yet.

    A reference is digits and dots, so a section can only be found by a prefix of the digits and dots that it begins with: these prefixes, up to the longest reference, are
    keys of an equi-join on different sections, not on chunks. What a query gets does not depend on the other queries of its batch.
    """
    rank = F.col("rank") if "rank" in have.columns else F.lit(0)
    refs = have.select("qid", "doc_name", rank.alias("__rank"), F.posexplode(xrefs(F.col("text"))).alias("__pos", "ref"))
    refs = refs.groupBy("qid", "doc_name", "ref").agg(F.min(F.struct("__rank", "__pos")).alias("__at"))
    longest = refs.agg(F.coalesce(F.max(F.length("ref")), F.lit(0)).alias("__longest"))
    number = F.regexp_extract(strip(F.col("section")), r"^[\d.]*", 0)
    sections = chunks.select("doc_name", "section").distinct().withColumn("__number", number).where("__number <> ''").crossJoin(F.broadcast(longest)).where("__longest > 0")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length("__number"), F.col("__longest"))), lambda n: F.substring(F.col("__number"), F.lit(1), n))
    found = sections.select("doc_name", "section", F.explode(prefixes).alias("ref")).join(refs, ["doc_name", "ref"])
    found = found.groupBy("qid", "doc_name", "section").agg(F.min_by("ref", "__at").alias("ref"))
    rows = chunks.join(found, ["doc_name", "section"]).select("qid", "ref", *(F.col(c) for c in chunks.columns))
    return rows.join(have.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


def with_referenced(have: DataFrame, chunks: DataFrame) -> DataFrame:
    """``have`` (qid, chunk_id, doc_name, page, section, text, ...) and the chunks that it refers to; their further columns are null, but ``source_query`` names the reference."""
    cols = ["chunk_id", "doc_name", "page", "section", "text"]
    more = referenced(have, chunks.select(cols))
    more = more.withColumn("source_query", F.concat(F.lit("xref:"), "ref")) if "source_query" in have.columns else more
    more = more.select("qid", *(F.col(c).cast(have.schema[c].dataType) for c in cols), *(["source_query"] if "source_query" in have.columns else []))
    return have.unionByName(more, allowMissingColumns=True)


#: Patterns of reference lines, with and without a chunk's id, and of a page in a label.
REFERENCE = r"^.*?\[\^(\d+)\]:\s*(.+?)(?:\(id:\s*([^)]+)\))?\s*$"
PLAIN_REFERENCE = r"(?i)\[\^(\d+)\]:\s*([^,\n]+),\s*Page\s+(\w+)"
LABEL_PAGE = r"(?i)page\s+(\w+)"


def references(answers: DataFrame, by: str = "qid", answer: str = "answer") -> DataFrame:
    """(by, pos, marker, label, ref_id) of lines such as ``[^7]: manual, Page 3 (id: manual_p3_c0)``; ref_id is empty without an id."""
    lines = answers.select(by, F.posexplode(F.split(answer, "\n")).alias("pos", "line")).where(F.col("line").rlike(REFERENCE))
    part = lambda i: F.regexp_extract("line", REFERENCE, i)
    return lines.select(by, "pos", part(1).cast("int").alias("marker"), strip(F.rtrim(strip(part(2)), F.lit("("))).alias("label"), strip(part(3)).alias("ref_id"))


def plain_references(answers: DataFrame, by: str = "qid", answer: str = "answer") -> DataFrame:
    """(by, pos, marker, label, page) of references such as ``[^2]: manual, Page 9``."""
    get = lambda i: F.regexp_extract_all(answer, F.lit(PLAIN_REFERENCE), F.lit(i))
    rows = answers.select(by, F.posexplode(F.arrays_zip(get(1).alias("m"), get(2).alias("d"), get(3).alias("p"))).alias("pos", "r"))
    return rows.select(by, "pos", F.col("r.m").cast("int").alias("marker"), strip(F.col("r.d")).alias("label"), strip(F.col("r.p")).alias("page"))


def _first_resolved(refs: DataFrame, chunks: DataFrame, by: str, exact: Column, loose: Column) -> DataFrame:
    """Per reference the exact match, else the first loose one in chunk order; per marker the first resolved reference."""
    pairs = refs.join(chunks.withColumnRenamed(by, "__by"), (F.col(by) == F.col("__by")) & (exact | loose))
    w = Window.partitionBy(by, "pos").orderBy(exact.cast("int").desc(), "ord")
    one = pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    first = one.withColumn("__r", F.row_number().over(Window.partitionBy(by, "marker").orderBy("pos"))).where("__r = 1")
    return first.select(by, "marker", "chunk_id", "doc_name", F.col("chunk_page").alias("page"), "section")


def resolved(refs: DataFrame, chunks: DataFrame, by: str = "qid") -> DataFrame:
    """Citations of ``references``: by chunk id, else by a label that holds the document's name and no other page. Chunks: (by, ord, chunk_id, doc_name, page, section)."""
    c = chunks.withColumnRenamed("page", "chunk_page")
    page = F.nullif(F.regexp_extract("label", LABEL_PAGE, 1), F.lit(""))
    loose = (F.coalesce(F.col("doc_name"), F.lit("")) != "") & F.contains("label", "doc_name") & (page.isNull() | (page == F.col("chunk_page").cast("string")))
    return _first_resolved(refs, c, by, F.col("ref_id") == F.col("chunk_id"), loose)


def plain_resolved(refs: DataFrame, chunks: DataFrame, by: str = "qid") -> DataFrame:
    """Citations of ``plain_references``: by document and page, else by names one of which holds the other."""
    c = chunks.withColumnRenamed("page", "chunk_page")
    exact = (F.col("doc_name") == F.col("label")) & (F.col("chunk_page").cast("string") == F.col("page"))
    loose = (F.coalesce(F.col("doc_name"), F.lit("")) != "") & (F.contains("label", "doc_name") | F.contains("doc_name", "label"))
    return _first_resolved(refs, c, by, exact, loose)


CITATION = "struct<marker:int,chunk_id:string,doc_name:string,page:string,section:string>"


def _cited(refs: Column, chunks: Column, exact, loose) -> Column:
    """Array of ``CITATION``: of each marker the first reference that a chunk resolves, by the first exact chunk, else the first loose one."""
    pick = lambda r: F.coalesce(F.get(F.filter(chunks, lambda c: exact(r, c)), F.lit(0)), F.get(F.filter(chunks, lambda c: loose(r, c)), F.lit(0)))
    found = F.filter(F.transform(refs, lambda r: F.struct(r["marker"].alias("marker"), pick(r).alias("c"))), lambda x: x["c"].isNotNull())
    one = F.transform(found, lambda x: F.struct(x["marker"].alias("marker"), *(x["c"][f].cast("string").alias(f) for f in ("chunk_id", "doc_name", "page", "section"))).cast(CITATION))
    add = lambda a, x: F.when(F.exists(a, lambda y: y["marker"] == x["marker"]), a).otherwise(F.concat(a, F.array(x)))
    return F.coalesce(F.aggregate(one, F.array().cast(f"array<{CITATION}>"), add), F.array().cast(f"array<{CITATION}>"))


def cited(answer: Column, chunks: Column) -> Column:
    """``references`` and ``resolved`` inside the row: the citations of an answer among an array of chunks in order of rank."""
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: x.rlike(REFERENCE))
    part = lambda x, i: F.regexp_extract(x, REFERENCE, i)
    refs = F.transform(lines, lambda x: F.struct(part(x, 1).cast("int").alias("marker"), strip(F.rtrim(strip(part(x, 2)), F.lit("("))).alias("label"), strip(part(x, 3)).alias("ref_id")))

    def loose(r: Column, c: Column) -> Column:
        page = F.nullif(F.regexp_extract(r["label"], LABEL_PAGE, 1), F.lit(""))
        return (F.coalesce(c["doc_name"], F.lit("")) != "") & F.contains(r["label"], c["doc_name"]) & (page.isNull() | (page == c["page"].cast("string")))

    return _cited(refs, chunks, lambda r, c: r["ref_id"] == c["chunk_id"], loose)


def plain_cited(answer: Column, chunks: Column) -> Column:
    """``plain_references`` and ``plain_resolved`` inside the row."""
    get = lambda i: F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(PLAIN_REFERENCE), F.lit(i))
    zipped = F.arrays_zip(get(1).alias("m"), get(2).alias("d"), get(3).alias("p"))
    refs = F.transform(zipped, lambda r: F.struct(r["m"].cast("int").alias("marker"), strip(r["d"]).alias("doc"), strip(r["p"]).alias("page")))
    exact = lambda r, c: (c["doc_name"] == r["doc"]) & (c["page"].cast("string") == r["page"])
    loose = lambda r, c: (F.coalesce(c["doc_name"], F.lit("")) != "") & (F.contains(r["doc"], c["doc_name"]) | F.contains(c["doc_name"], r["doc"]))
    return _cited(refs, chunks, exact, loose)
