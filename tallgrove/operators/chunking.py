"""Pages to overlapping, section-aware chunks, and paragraphs to virtual pages.

Packing is a fold with resets, which no window frame expresses. It is one pass in Python over
Arrow batches: a page is a row, so any number of pages is chunked in parallel without a shuffle.
"""
from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrove.functions.text import HEADERS, SENTENCE_END
from tallgrove.operators.batches import small_batches

CHUNK = "chunk_id string, doc_name string, page int, section string, text string, char_start int, char_end int, ord int, first int, last int"
UNKNOWN = "Unknown Section"


def header_spans(text: str) -> list[tuple[int, str]]:
    """(offset of the line, header) of every section header."""
    kinds, at, out = [re.compile(p) for p in HEADERS], 0, []
    for line in text.split("\n"):
        bare = line.strip()
        if any(k.match(bare) for k in kinds):
            out.append((at, bare))
        at += len(line) + 1
    return out


def sentence_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, stripped sentence); start is where the one before ended."""
    out, at = [], 0
    for m in [*re.finditer(SENTENCE_END, text), None]:
        end = m.start() if m else len(text)
        if bare := text[at:end].strip():
            out.append((at, end, bare))
        at = m.end() if m else end
    return out


def packed_ranges(sizes: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) sentence of each chunk, by prefix sums.

    A chunk takes sentences while they fit (one at least); the next one starts with the longest
    run of its last sentences within ``overlap``, unless that leaves no room for the next sentence.
    """
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n + 1)
    out, start, new, n = [], 0, 0, len(sizes)
    while new < n:
        last = max(new, bisect_right(sums, sums[start] + size) - 2)
        out.append((start, last))
        keep = last + 1
        while keep > start and sums[last + 1] - sums[keep - 1] <= overlap:
            keep -= 1
        if last + 1 < n and sums[last + 2] - sums[keep] > size:
            keep = last + 1
        start, new = keep, last + 1
    return out


def chunks(pages: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """Chunks of pages (doc_name, page, text). Blank and null pages have none."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for doc, page, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                spans, heads = sentence_spans(text or ""), header_spans(text or "")
                starts = [h[0] for h in heads]
                for i, (first, last) in enumerate(packed_ranges([len(s[2]) for s in spans], size, overlap)):
                    begin = spans[first][0]
                    at = bisect_right(starts, begin)
                    section = heads[at - 1][1] if at else UNKNOWN
                    rows.append((f"{doc}_p{page}_c{i}", doc, page, section, " ".join(s[2] for s in spans[first : last + 1]), begin, spans[last][1], i, first, last))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 5]
            cols = list(zip(*rows)) or [()] * 10
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in CHUNK.split(", ")])

    return small_batches(pages.select(F.col("doc_name").cast("string"), F.col("page").cast("int"), "text")).mapInArrow(cut, CHUNK)


def virtual_pages(docs: DataFrame, key: str, text: str = "text", size: int = 3000) -> DataFrame:
    """(key, page, text): stripped paragraphs gathered until their lengths plus one each reach ``size``."""

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, pages, texts = [], [], []
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                held, n, page = [], 0, 1
                for p in [*filter(None, map(str.strip, (t or "").split("\n"))), None]:
                    if p is not None:
                        held.append(p)
                        n += len(p) + 1
                    if held and (p is None or n >= size):
                        keys.append(k.as_py()), pages.append(page), texts.append("\n".join(held))
                        held, n, page = [], 0, page + 1
            yield pa.record_batch([pa.array(keys, b.column(0).type), pa.array(pages, pa.int32()), pa.array(texts, pa.string())], [key, "page", "text"])

    kind = dict(docs.dtypes)[key]
    return small_batches(docs.select(key, text)).mapInArrow(gather, f"{key} {kind}, page int, text string")
