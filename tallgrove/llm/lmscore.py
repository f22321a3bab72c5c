"""Language-model scores from log-frequency Bloom filters of n-gram counts.

Counts of words and word pairs are summed over all training texts, quantised to levels
1 + floor(log2 count), and an n-gram of level q is put into a Bloom filter once for each of its levels 1..q.
A count is read back by probing levels until one is missing. The smoothed probability of a word
w after v is  a * min(1, c(v w) / c(v)) + (1 - a) * (c(w) + 1) / (N + V + 1)  with
a = c(v) / (c(v) + BACKOFF), all c by probes. A text begins after an end token and ends with one.

Steps, each written to the shared folder:

1. One pass over the training texts sums words and pairs within tasks and packs the sums of one
   bucket (a range of hashes) into one row, so that few rows are shuffled, and compress well (sorted hashes as differences, bytes by place); buckets are then summed up.
2. A filter has lines of 512 bits, ``BITS`` bits a level; lines follow the order of the hashes, so that a
   bucket is a run of lines and sorted probes read memory in order. The word filter is broadcast.
   The pair filter is cut into shards of at most ``MOST_BYTES``.
3. One pass over the texts makes the base score and, for each batch of texts and each shard, the sorted
   different pairs with the levels of their words and the texts they stand in. Every shard is broadcast in turn and
   read for its own pairs only: a pair is probed once however many shards there are.

A word filter of more than ``MOST_BYTES`` is not built: the counts
of the words that are not broadcast are joined to the texts by hash, and read as the same levels.

The base score needs exact counts: at most ``MOST_HOT`` of the most frequent words are
broadcast (16 bytes each); the others, each rarer than all of those, are joined by hash.

Defined results: null and empty texts are one end token; words are whole texts' words; repeated
rows have equal scores; an empty table gives an empty table; without training texts every
probability is 1 (N = V = 0). A null id is scored and not learned from. Other columns are not read, whatever their names.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import batches, small_batches, table, written
from tallgrove.llm.shingles import mix64, word_hashes

LINE = 512
#: Hashes of 9 bits each and bits an entry: an absent n-gram is read as seen about 9 times in 10,000.
HASHES, BITS = 7, 18
MOST_BYTES, MOST_HOT = 64 << 20, 1 << 20
BACKOFF = 10.0
#: Bytes of training text a bucket of hashes stands for, and the most buckets.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 16
#: Bytes of text that numpy handles at once.
ATONCE = 2 << 20
#: Pairs that a task sums up before it hands them on; entries of one row (rows stay below the size from which the JVM gives a value regions of its own), and of a batch of rows.
HELD, PIECE, CHUNK = 1 << 21, 1 << 14, 1 << 18
#: Bytes of a filter that the driver collects at once.
GATHERED = 16 << 20
#: Shards from which on probes are brought together by shard before they are written.
MANY_SHARDS = 8
#: The end token's hash, and the salts of levels and pairs.
END, LEVEL, PAIR = np.uint64(0x632BE59BD9B4E019), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
WORD_KIND, PAIR_KIND = 1, 2


def pairs_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * PAIR + right)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token in order, tokens of each text): words, A-Z lower-cased, and an end after each text."""
    h, sizes = word_hashes(texts, lower=True)
    out = np.full(len(h) + len(sizes), END)
    out[np.arange(len(h)) + np.repeat(np.arange(len(sizes)), sizes)] = h
    return out, sizes + 1


def before(h: np.ndarray) -> np.ndarray:
    return np.concatenate([np.array([END]), h[:-1]])


def range_of(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hashes each lies in; sorted hashes have sorted ranges."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def planes(x: np.ndarray) -> bytes:
    """An array's bytes, the lowest of all values first: small values leave runs of zeros, which compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: object, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(h: np.ndarray) -> bytes:
    """Sorted hashes as the planes of their differences."""
    return planes(np.diff(h, prepend=np.uint64(0)))


def from_steps(data: object) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


class Sums:
    """Sums counts by hash; ``add`` sums what is held whenever it has doubled."""

    def __init__(self) -> None:
        self.h: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held, self.limit = 0, HELD

    def add(self, h: np.ndarray, n: np.ndarray) -> None:
        self.h.append(h)
        self.n.append(n)
        self.held += len(h)
        if self.held > self.limit:
            h, n = self.take()
            self.h, self.n, self.held, self.limit = [h], [n], len(h), max(HELD, 2 * len(h))

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and their sums; nothing is held any more."""
        if not self.h:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, n = np.concatenate(self.h), np.concatenate(self.n)
        self.__init__()
        order = np.argsort(h)
        h, n = h[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[at], np.add.reduceat(n, at)


def distinct(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different hashes and how often each is there; ``held`` is empty afterwards."""
    h = np.concatenate(held)
    held.clear()
    h.sort()
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[at], np.diff(np.append(at, len(h)))


def levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def counts_of(level: np.ndarray) -> np.ndarray:
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 1.5 * np.exp2(level - 1.0)))


def found_in(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of ``h`` by sorted keys, 0 for those that are missing."""
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], 0)


def level_bits(h: np.ndarray, level: int) -> np.ndarray:
    """Hashes whose 9-bit fields are the places of a level's bits in the n-gram's line.

    All bits of all levels of an n-gram lie in one line of 64 bytes, so reading a count touches memory once.
    """
    with np.errstate(over="ignore"):
        return mix64(h + np.uint64(level) * LEVEL)


def probe(bits: np.ndarray, first: int, lines: int, h: np.ndarray) -> np.ndarray:
    """Levels read back (0 if missing); ``bits`` has the lines from ``first`` on, of ``lines`` in all."""
    level = np.zeros(len(h), np.int8)
    active = np.arange(len(h))
    line = (range_of(h, lines) - np.uint64(first)) * np.uint64(LINE)
    for q in range(1, 64):
        g = level_bits(h, q)
        for i in range(HASHES):
            place = line | ((g >> np.uint64(9 * i)) & np.uint64(LINE - 1))
            byte = bits[(place >> np.uint64(3)).view(np.int64)]
            hit = np.flatnonzero((byte >> (place & np.uint64(7)).astype(np.uint8)) & 1)
            if len(hit) < len(active):
                active, h, line, g = (x[hit] for x in (active, h, line, g))
        if not len(active):
            break
        level[active] = q
    return level


def fill(bits: np.ndarray, h: np.ndarray, q: np.ndarray, first: int, lines: int) -> None:
    """Sets the levels 1..q of each hash in ``bits`` (a byte a bit), the lines from ``first`` on of a filter of ``lines`` lines."""
    line = (range_of(h, lines) - np.uint64(first)) * np.uint64(LINE)
    for level in range(1, int(q.max(initial=0)) + 1):
        h, line, q = (x[q >= level] for x in (h, line, q))
        g = level_bits(h, level)
        for i in range(HASHES):
            bits[line | ((g >> np.uint64(9 * i)) & np.uint64(LINE - 1))] = 1


def sized_cuts(at: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, ends) of pieces of at most ``PIECE`` of n entries, none across the places ``at`` (the first is 0), for about ``CHUNK`` entries at a time."""
    if not len(at):
        return
    ends = np.append(at[1:], n)
    pieces = -(-(ends - at) // PIECE)
    start = np.repeat(at, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(start + PIECE, np.repeat(ends, pieces))
    cut = np.flatnonzero(np.diff(start // CHUNK)) + 1
    yield from ((s, e) for s, e in zip(np.split(start, cut), np.split(end, cut)) if len(s))


def counted(train: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, h, n, total, hist): sums of words (kind 1) and pairs (kind 2) as packed hashes and counts.

    hist has the number of entries of each level. Rows of a bucket are cut at ``PIECE`` entries.
    """

    def pack(kind: int, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = range_of(h, buckets)
        at = np.flatnonzero(np.diff(own, prepend=own[:1] + np.uint64(1)))
        for s, e in sized_cuts(at, len(h)):
            some = [(x, y) for x, y in zip(s, e)]
            yield pa.record_batch(
                [pa.array(own[s].astype(np.int32)), pa.array([kind] * len(s), pa.int32()), pa.array([steps(h[x:y]) for x, y in some], pa.binary()), pa.array([planes(n[x:y]) for x, y in some], pa.binary())],
                ["bucket", "kind", "h", "n"],
            )

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Sums(), [], 0
        for b in batches(it, most=ATONCE):
            h, _ = tokens(b.column(0).to_pylist())
            words.add(*np.unique(h, return_counts=True))
            if words.held > HELD:
                yield from pack(WORD_KIND, *words.take())
            held.append(pairs_of(before(h), h))
            size += len(h)
            if size > HELD:
                yield from pack(PAIR_KIND, *distinct(held))
                size = 0
        yield from pack(WORD_KIND, *words.take())
        if held:
            yield from pack(PAIR_KIND, *distinct(held))

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, key = Sums(), None

        def rows() -> Iterator[pa.RecordBatch]:
            h, n = sums.take()
            for s, e in sized_cuts(np.zeros(min(1, len(h)), np.int64), len(h)):
                some = [(x, y) for x, y in zip(s, e)]
                hist = [np.bincount(levels(n[x:y]), minlength=64) for x, y in some]
                cols = [pa.array([k] * len(s), pa.int32()) for k in key] + [pa.array([steps(h[x:y]) for x, y in some], pa.binary()), pa.array([planes(n[x:y]) for x, y in some], pa.binary())]
                yield pa.record_batch([*cols, pa.array([int(n[x:y].sum()) for x, y in some], pa.int64()), pa.array(hist, pa.list_(pa.int64()))], ["bucket", "kind", "h", "n", "total", "hist"])

        for b in it:
            for k, h, n in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2), b.column(3)):
                if k != key:
                    yield from rows()
                    key = k
                sums.add(from_steps(h.as_buffer()), from_planes(n.as_buffer(), np.int64))
        yield from rows()

    spark = train.sparkSession
    parts = min(buckets, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    packed = train.select("text").mapInArrow(count, "bucket int, kind int, h binary, n binary")
    met = packed.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "kind")
    return met.mapInArrow(merge, "bucket int, kind int, h binary, n binary, total long, hist array<long>")


def unpacked(rows: DataFrame, least: int, most: int) -> DataFrame:
    """(h, n) of the packed counts from ``least`` up to below ``most``."""

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for h, n in zip(b.column(0), b.column(1)):
                n = from_planes(n.as_buffer(), np.int64)
                some = (n >= least) & (n < most)
                yield pa.record_batch([pa.array(from_steps(h.as_buffer()).view(np.int64)[some]), pa.array(n[some])], ["h", "n"])

    return rows.select("h", "n").mapInArrow(unpack, "h long, n long")


def gathered(rows: DataFrame, first: int, end: int, each: int, lines: int) -> bytearray:
    """The lines of buckets ``first`` to ``end``, ``each`` lines a bucket, of a filter of ``lines`` lines; at most ``MOST_BYTES``."""

    size = each * LINE // 8

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, own = np.zeros(each * LINE, np.uint8), None

        def done() -> pa.RecordBatch:
            packed = np.packbits(bits, bitorder="little").tobytes()
            at = range(0, len(packed), 8 * PIECE)
            return pa.record_batch([pa.array([own * size + x for x in at], pa.int64()), pa.array([packed[x : x + 8 * PIECE] for x in at], pa.binary())], ["at", "bits"])

        for b in it:
            for bucket, h, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if own is not None and bucket != own:
                    yield done()
                    bits[:] = 0
                own = bucket
                fill(bits, from_steps(h.as_buffer()), levels(from_planes(n.as_buffer(), np.int64)), bucket * each, lines)
        if own is not None:
            yield done()

    out, step = bytearray((end - first) * size), max(1, GATHERED // size)
    whole = np.frombuffer(out, np.uint8)
    for s in range(first, end, step):
        got = rows.where((F.col("bucket") >= s) & (F.col("bucket") < min(s + step, end))).select("bucket", "h", "n").mapInArrow(put, "at long, bits binary").toArrow()
        for at, bits in zip(got.column(0).to_pylist(), got.column(1)):
            own = np.frombuffer(bits.as_buffer(), np.uint8)
            whole[at - first * size : at - first * size + len(own)] |= own
        del got
    return out  # workers read bytes without a second copy


class Model:
    """What scoring needs: totals, filters and the frequent words."""

    def __init__(self, train: DataFrame) -> None:
        spark = small_batches(train).sparkSession
        size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
        counts = written(counted(train, self.buckets))
        self.word_rows, self.pair_rows = counts.where(F.col("kind") == WORD_KIND), counts.where(F.col("kind") == PAIR_KIND)
        hist = counts.select("kind", F.posexplode("hist").alias("q", "k")).groupBy("kind", "q").agg(F.sum("k").alias("k")).collect()
        of = lambda kind, weight: sum(r.k * weight(r.q) for r in hist if r.kind == kind)
        self.n = self.word_rows.agg(F.sum("total")).first()[0] or 0
        self.v = of(WORD_KIND, lambda q: 1)
        each = lambda entries: max(1, math.ceil(entries * BITS / LINE / self.buckets))
        #: Lines a bucket of the two filters.
        self.word_each, self.pair_each = each(of(WORD_KIND, int)), each(of(PAIR_KIND, int))
        #: Whether word counts are joined, as their filter is too large for a broadcast.
        self.joined = self.buckets * self.word_each * LINE // 8 > MOST_BYTES
        bits = None if self.joined else gathered(self.word_rows, 0, self.buckets, self.word_each, self.buckets * self.word_each)
        self.words = spark.sparkContext.broadcast(bits)
        least, seen = 64, 0
        for q, k in sorted(((r.q, r.k) for r in hist if r.kind == WORD_KIND and r.k), reverse=True):
            if seen + k > MOST_HOT:
                break
            least, seen = q, seen + k
        #: Whether every word is broadcast; else those below a count are joined.
        self.all_hot = seen == self.v
        bound = 1 << (least - 1) if least < 64 else (1 << 63) - 1
        hot = unpacked(self.word_rows, bound, (1 << 63) - 1).toArrow()
        h, n = hot.column("h").to_numpy().view(np.uint64), hot.column("n").to_numpy()
        order = np.argsort(h)
        self.hot = spark.sparkContext.broadcast((h[order].tobytes(), n[order].tobytes()))
        self.rare = unpacked(self.word_rows, 1, bound).select(F.col("h").alias("rare_h"), F.col("n").alias("rare_n"))

    def shards(self) -> list[tuple[int, int]]:
        """(first bucket, end) of the parts of the pair filter."""
        most = max(1, MOST_BYTES * 8 // (LINE * self.pair_each))
        return [(s, min(s + most, self.buckets)) for s in range(0, self.buckets, most)]


def frequent(hot: object) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words that are broadcast."""
    h, n = hot.value
    return np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)


def with_counts(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, row, rare_h, rare_n): the rows with the trained counts of those of their words that are not broadcast."""
    hot = model.hot

    def numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in it:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(row + np.arange(b.num_rows))], ["doc_id", "text", "row"])
            row += b.num_rows

    def rare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1, ATONCE):
            h, sizes = tokens(b.column(1).to_pylist())
            hashes, stream = np.unique(h, return_inverse=True)
            rest = np.flatnonzero(found_in(*frequent(hot), hashes)[stream] == 0)
            key = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rest] * len(hashes) + stream[rest])
            yield pa.record_batch([pa.array(b.column(2).to_numpy()[key // len(hashes)]), pa.array(hashes[key % len(hashes)].view(np.int64))], ["row", "h"])

    rows = written(df.mapInArrow(numbered, "doc_id long, text string, row long"))
    found = rows.mapInArrow(rare, "row long, h long").join(model.rare, F.col("h") == F.col("rare_h"))
    found = found.groupBy("row").agg(F.collect_list(F.struct("rare_h", "rare_n")).alias("c"))
    return written(rows.join(found, "row", "left").select("doc_id", "text", "row", F.col("c.rare_h").alias("rare_h"), F.col("c.rare_n").alias("rare_n")))


#: What the pass over the texts writes: base results (shard -1), words to be joined (shard -1, h not null) and the probes of each shard.
PASSED = "shard int, row long, doc_id long, n_tokens long, n_known long, base_score double, h long, times long, probes binary"
FIELDS = [x.split() for x in PASSED.split(", ")]
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def passed(n_rows: int, **cols: object) -> pa.RecordBatch:
    """A batch of ``PASSED``; columns that are not given are null."""
    arrays = [cols[x] if isinstance(cols.get(x), pa.Array) else pa.array(cols[x], ARROW[t]) if x in cols else pa.nulls(n_rows, ARROW[t]) for x, t in FIELDS]
    return pa.record_batch(arrays, [x for x, _ in FIELDS])


def packed_probes(ids: np.ndarray, two: np.ndarray, left: np.ndarray, right: np.ndarray, times: np.ndarray, owner: np.ndarray) -> bytes:
    """Numbers of the texts, different pairs in order, levels of their two words, how often each stands here, and in which of the texts."""
    return b"".join((np.array([len(ids), len(two)], np.int64).tobytes(), ids.tobytes(), steps(two), left.tobytes(), right.tobytes(), planes(times.astype(np.uint32)), planes(owner.astype(np.uint32))))


def unpacked_probes(data: pa.Buffer) -> list[np.ndarray]:
    data = np.frombuffer(data, np.uint8)
    texts, k = data[:16].view(np.int64).tolist()
    ids, two, left, right, times, owner = np.split(data[16:], np.cumsum([8 * texts, 8 * k, k, k, 4 * k]))
    return [np.frombuffer(ids, np.int64), from_steps(two), left.view(np.int8), right.view(np.int8), from_planes(times, np.uint32), from_planes(owner, np.uint32)]


def score(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row of ``df`` with columns doc_id, text."""
    n, v, words, hot, joined, all_hot, buckets = model.n, model.v, model.words, model.hot, model.joined, model.all_hot, model.buckets
    word_lines, pair_each = buckets * model.word_each, model.pair_each
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = with_counts(df, model) if joined else df
    total, shards = math.log10(n + v + 1), model.shards()
    starts = np.array([s for s, _ in shards], np.uint64)

    def scored(b: pa.RecordBatch, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        hot_h, hot_n = frequent(hot)
        h, sizes = tokens(b.column(1).to_pylist())
        hashes, stream = np.unique(h, return_inverse=True)
        k = len(sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        exact = found_in(hot_h, hot_n, hashes)
        flags, known = (exact > 0)[stream], np.where(exact > 0, np.log10(exact + 1.0), 0.0)
        if joined:
            rare_h, first_at = np.unique(b.column(3).flatten().to_numpy().view(np.uint64), return_index=True)
            every = np.maximum(exact, found_in(rare_h, b.column(4).flatten().to_numpy()[first_at], hashes))
            uni = np.where(every > 0, levels(every), 0).astype(np.int8)
        else:
            uni = probe(np.frombuffer(words.value, np.uint8), 0, word_lines, hashes)
        yield passed(k, shard=np.full(k, -1), row=ids, doc_id=b.column(0), n_tokens=sizes, n_known=np.add.reduceat(flags.astype(np.int64), begin), base_score=np.add.reduceat(known[stream], begin) - total * sizes)
        owner = np.repeat(np.arange(k, dtype=np.int32), sizes)
        if not all_hot and len(rest := np.flatnonzero(~flags)):
            key, times = np.unique(owner[rest].astype(np.int64) * len(hashes) + stream[rest], return_counts=True)
            yield passed(len(key), shard=np.full(len(key), -1), row=ids[key // len(hashes)], h=hashes[key % len(hashes)].view(np.int64), times=times)
        two = pairs_of(before(h), h)
        order = np.argsort(two)
        two = two[order]
        at = np.flatnonzero(np.concatenate([[True], two[1:] != two[:-1]]))
        two, times, last = two[at], np.diff(np.append(at, len(order))), order[at]
        c = uni[stream]
        left, right = np.concatenate([uni[hashes == END], c[:-1]])[last], c[last]  # every text has an end token
        edge = np.append(np.searchsorted(range_of(two, buckets), starts), len(two))
        token = np.append(at, len(order))
        for s in np.flatnonzero(edge[1:] > edge[:-1]):
            for x in range(edge[s], edge[s + 1], PIECE):
                y = min(x + PIECE, edge[s + 1])
                data = packed_probes(ids, two[x:y], left[x:y], right[x:y], times[x:y], owner[order[token[x] : token[y]]])
                yield passed(1, shard=[s], row=ids[:1], probes=[data])

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for b in batches(it, 1, ATONCE):
            yield from scored(b, b.column(2).to_numpy() if joined else row + np.arange(b.num_rows))
            row += b.num_rows

    def probed(first: int, bits: object):
        def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, total = np.zeros(0, np.int64), np.zeros(0)

            def done() -> pa.RecordBatch:
                return pa.record_batch([pa.array(ids), pa.array(total)], ["row", "score"])

            for b in it:
                for data in b.column(0):
                    own, two, left, right, times, owner = unpacked_probes(data.as_buffer())
                    if not np.array_equal(own, ids):  # the pieces of a batch of texts stand together
                        yield done()
                        ids, total = own, np.zeros(len(own))
                    pair, ahead, c = counts_of(probe(np.frombuffer(bits.value, np.uint8), first * pair_each, buckets * pair_each, two)), counts_of(left), counts_of(right)
                    a = ahead / (ahead + BACKOFF)
                    p = a * np.minimum(1.0, pair / np.maximum(np.maximum(ahead, pair), 1.0)) + (1 - a) * np.minimum(1.0, (c + 1) / (n + v + 1))
                    total += np.bincount(owner, np.repeat(np.log10(np.minimum(p, 1.0)), times), len(ids))
            yield done()

        return read

    spark = df.sparkSession
    rows = df.mapInArrow(one, PASSED)
    if len(shards) >= MANY_SHARDS:
        rows = rows.repartition("shard", F.col("row") % (4 * spark.sparkContext.defaultParallelism))
    rows = written(rows, ["shard"])
    base = rows.where("shard = -1")
    scores = None
    for s, (first, end) in enumerate(shards):
        bits = spark.sparkContext.broadcast(gathered(model.pair_rows, first, end, pair_each, buckets * pair_each))
        part = written(rows.where(F.col("shard") == s).select("probes").mapInArrow(probed(first, bits), "row long, score double"))
        bits.destroy()  # what was probed is written
        scores = part if scores is None else scores.unionByName(part)
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    if all_hot:
        base = base.select("row", "doc_id", "n_tokens", "n_known", "base_score")
    else:
        base = base.join(model.rare, F.col("h") == F.col("rare_h"), "left").withColumn("c", F.coalesce("rare_n", F.lit(0)))
        more, log = F.when((F.col("h").isNotNull()) & (F.col("c") > 0), F.col("times")), F.col("times") * F.log10(F.col("c") + 1.0)
        base = base.select("row", "doc_id", "n_tokens", F.coalesce("n_known", more).alias("n_known"), F.coalesce("base_score", log).alias("base_score"))
    both = base.withColumn("score", F.lit(0.0)).unionByName(scores.selectExpr("row", "null as doc_id", "0 as n_tokens", "0 as n_known", "0.0D as base_score", "score"), allowMissingColumns=True)
    return both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), zero("n_tokens").cast("long").alias("n_tokens"), zero("n_known").cast("long").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score")
    ).drop("row")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text under a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    model = Model(docs.where(fold != 2))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
