"""SimHash near-duplicates: documents whose 64-bit fingerprints differ in few bits, joined to components.

1. A fingerprint is the majority, bit by bit, of the XXH64 hashes of a text's word shingles, repeats included.
2. Pigeonhole blocks: 64 bits are cut into ``bits + SPARE`` blocks. Two fingerprints that differ in at most ``bits`` bits
   agree on at least ``SPARE`` whole blocks, so each different fingerprint goes to one bucket for every choice of ``SPARE`` blocks,
   and close pairs meet in one at least (at 2 bits: 10 choices of 3 blocks out of 5, keys of 38 or 39 bits).
3. A bucket of more than ``LARGE`` fingerprints is split by the same rule once more: the bits that its key leaves free are cut into blocks, and
   its fingerprints go to a bucket for every choice of them. By then 10 or 11 bits are free, so a bucket has 2,048 fingerprints at most.
4. In a bucket the Hamming distances are computed; each fingerprint is linked to the least one of its component there, so pairs are never
   written out. Links are joined by contraction rounds.

Equal fingerprints are one before anything is shuffled, so copies cost nothing. Nothing is capped or sampled away.

Defined results: null and empty texts and texts without words have the fingerprint zero, which is linked like any other; a text of fewer
words than a shingle is one shingle; rows with equal ids are documents of their own; a component's id is its smallest doc_id (null if
it has no other); an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import batches, near, small_batches, table, written
from tallgrove.llm.ngram_join import FEW, components

WORDS, BITS, SPARE, SEED = 3, 2, 3, 42
#: Different fingerprints up to which a bucket is compared as it is.
LARGE = 2048
#: Hashes whose bits are counted at once (64 bytes each).
STEP = 1 << 16


def majority(raw: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit number."""
    import xxhash

    own = raw.lower().split()  # bytes: A-Z only, and the white space of WHITE
    if not own:
        return 0
    hashed, joined, k = xxhash.xxh64_intdigest, b" ".join(own), min(words, len(own))
    size = np.fromiter(map(len, own), np.int64, len(own))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: len(own) - k + 1], end[k - 1 :]
    count = np.zeros(64, np.int64)
    for i in range(0, len(start), STEP):
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(start[i : i + STEP].tolist(), end[i : i + STEP].tolist())], "<u8")
        count += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(start), bitorder="little").view("<i8")[0])


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp as a long) of rows (doc_id, text); texts leave the worker's memory a batch of about 1 MB after another."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1, 1 << 20):
            fps = [majority(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(task, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def choices(free: int, bits: int) -> list[int]:
    """Masks of the choices of ``SPARE`` blocks out of ``bits + SPARE``, into which the bits set in ``free`` are cut."""
    places = [i for i in range(64) if free >> i & 1]
    blocks = [sum(1 << int(i) for i in own) for own in np.array_split(places, bits + SPARE)]
    return [sum(c) for c in combinations(blocks, SPARE)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def least_neighbours(fp: np.ndarray, bits: int) -> np.ndarray:
    """For each of a bucket's fingerprints the least one of its component there."""
    close, own = np.empty((len(fp), len(fp)), bool), fp.view(np.uint64)  # of a signed number the absolute value's bits would be counted
    for i in range(0, len(fp), 256):
        close[i : i + 256] = np.bitwise_count(own[i : i + 256, None] ^ own) <= bits
    root = fp.copy()
    while True:
        least = np.where(close, root, np.iinfo(np.int64).max).min(axis=1)
        if (least == root).all():
            return root
        root = least


def linked(it: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(a, b) links from rows (choice, key, fp) sorted by choice and key: each fingerprint with the least one of its component in the bucket."""
    held = np.zeros((3, 0), np.int64)
    for b in stacked(it):
        own = np.concatenate([held, b], axis=1) if b is not None else held
        new = np.flatnonzero((own[:2, 1:] != own[:2, :-1]).any(axis=0)) + 1 if own.shape[1] else np.zeros(0, np.int64)
        edge = np.concatenate([[0], new, [own.shape[1]]])
        if b is not None:  # the last bucket may go on
            held, edge = own[:, edge[-2] :], edge[:-1]
        out = []
        for s in np.flatnonzero(np.diff(edge) > 1):
            fp = np.ascontiguousarray(own[2, edge[s] : edge[s + 1]])
            root = least_neighbours(fp, bits)
            some = root != fp
            if some.any():
                out.append((fp[some], root[some]))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])


def stacked(it: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray | None]:
    for b in it:
        if b.num_rows:
            yield np.stack([b.column(i).to_numpy() for i in range(3)])
    yield None


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) of different fingerprints (fp): enough links of at most ``bits`` bits that everything connected stays so."""
    masks = choices((1 << 64) - 1, bits)
    key = lambda i, mask: F.struct(F.lit(i).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long")).alias("key"))
    rows = fps.select("fp", F.explode(F.array(*(key(i, m) for i, m in enumerate(masks)))).alias("k")).select("k.choice", "k.key", "fp")
    sizes = rows.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes)
    hot = near(sizes.where(F.col("n") > LARGE).select("choice", "key"), FEW)
    met = rows.join(near(sizes.select("choice", "key", "n"), FEW), ["choice", "key"])
    small = met.where(F.col("n") <= LARGE).select("choice", "key", "fp")
    within = [choices(((1 << 64) - 1) ^ m, bits) for m in masks]  # of the bits that each choice leaves free
    table_of = F.array(*(F.array(*(F.lit(signed(m | sub)).cast("long") for sub in own)) for m, own in zip(masks, within)))
    again = rows.join(hot, ["choice", "key"], "left_semi").select("choice", "fp", F.posexplode(F.get(table_of, F.col("choice").cast("int"))).alias("sub", "mask"))
    again = again.select(((F.col("choice") + 1) * len(masks) + F.col("sub")).cast("long").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    buckets = small.unionByName(again).repartition("choice", "key").sortWithinPartitions("choice", "key")
    return buckets.mapInArrow(lambda it: linked(it, bits), "a long, b long")


def near_fingerprints(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component_id) of each different fingerprint of (doc_id, fp) rows."""
    own = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(own.select("fp"), bits))
    rooted = written(own.join(roots.withColumnRenamed("x", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint as a long, component_id) of every row."""
    rows = written(fingerprinted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words))
    return rows.join(near(written(near_fingerprints(rows, bits)), FEW), "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
