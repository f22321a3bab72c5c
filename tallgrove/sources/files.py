"""File sources and sinks: raw listings, text extraction, page, chunk, manifest and test-set tables."""
from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.functions.text import file_stem

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Suffixes that are extracted, and encodings that are tried in this order.
SUFFIXES = ("pdf", "docx", "txt")
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
PAGE = "doc_name string, page int, text string, doc_type string"
CHUNK = "chunk_id string, doc_name string, page int, section string, text string, char_start int, char_end int, summary string, questions array<string>, embedding_text string"


def raw_files(spark: SparkSession, folder: str, any_case: bool = False) -> DataFrame:
    """(path, name, mtime, size, ext, content) of a folder's documents; ``~$`` names and other suffixes are left out. Columns not used are not read."""
    df = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    df = df.select("path", name.alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), ext.alias("ext"), "content")
    return df.where((F.lower("ext") if any_case else F.col("ext")).isin(*SUFFIXES) & ~F.col("name").startswith("~$"))


def library(spark: SparkSession, folder: str) -> DataFrame:
    return raw_files(spark, folder, any_case=True).select("name", "size", F.lower("ext").alias("ext")).orderBy("name")


def decoded(raw: bytes) -> str:
    """The first encoding that fits; line ends as ``\\n``."""
    for e in ENCODINGS:
        try:
            return raw.decode(e).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def pages_of(name: str, ext: str, raw: bytes) -> Iterator[tuple[int, str]]:
    """(page, stripped text) of a file, page after page, so that pages before a broken one are kept. PDF and DOCX need their parser on the workers; without it the import error says so."""
    import io

    if ext == "txt":
        text = decoded(raw).strip()
        if text:
            yield 1, text
        return
    if ext == "pdf":
        from pypdf import PdfReader

        for i, p in enumerate(PdfReader(io.BytesIO(raw)).pages, 1):
            if t := (p.extract_text() or "").strip():
                yield i, t
        return
    from docx import Document

    page, held, n = 1, [], 0
    for p in filter(None, (x.text.strip() for x in Document(io.BytesIO(raw)).paragraphs)):
        held.append(p)
        n += len(p) + 1
        if n >= 3000:
            yield page, "\n".join(held)
            page, held, n = page + 1, [], 0
    if held:
        yield page, "\n".join(held)


def extracted(files: DataFrame) -> DataFrame:
    """Pages (doc_name, page, text, doc_type, error) of ``raw_files``; a file that fails has a row with its error after the pages that were read."""

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for stem, name, ext, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                try:
                    for page, text in pages_of(name, ext, raw):
                        rows.append((stem, page, text, ext, None))
                except Exception as e:  # noqa: BLE001  a broken file must not end the run; the row says what was wrong
                    rows.append((stem, None, None, ext, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["doc_name", "page", "text", "doc_type", "error"])

    return files.select(file_stem(F.col("name")).alias("stem"), "name", F.lower("ext").alias("ext"), "content").mapInArrow(extract, PAGE + ", error string")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages from JSON arrays, a file a document; other JSON files of the folder are left out."""
    df = spark.read.schema(PAGE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return df.where("doc_name is not null and page is not null")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries from a JSON list, or an object with ``queries``."""
    one = "query string, relevant array<string>, expected_facts array<string>, must_cite array<string>, out_of_scope boolean"
    df = spark.read.schema(f"queries array<struct<{one.replace(' ', ':').replace(',:', ',')}>>, {one}").option("multiLine", True).json(path)
    inner = df.where("queries is not null").select(F.inline("queries"))
    return inner.unionByName(df.where("query is not null").drop("queries"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    out = df.write.mode(mode)
    (out.partitionBy(*by) if by else out).parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """A partition a document; only the partitions of the documents at hand are replaced."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_name").parquet(path)


def manifest(pages: DataFrame) -> DataFrame:
    """One row: number and sorted names of documents, and those that failed."""
    ok = F.array_sort(F.collect_set(F.when(F.col("error").isNull(), F.col("doc_name"))))  # a document with pages counts, even if a later page failed
    bad = F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("doc_name"))))
    return pages.agg(F.size(ok).alias("total_docs"), ok.alias("documents"), bad.alias("failed"))
