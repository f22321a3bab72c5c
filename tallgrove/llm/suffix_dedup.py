"""Suffix-array dedup: removes every byte that a string of ``LENGTH`` bytes covers which also starts in a document with a smaller id.

Suffixes are not sorted all at once. Every string of 50 bytes holds an anchor: the least of
its hashed 18-byte grams (a minimiser), at the same place wherever the string occurs. So
equal strings meet at their anchor, and about one position in 16 is an anchor.

1. Each document gives the different (anchor, context) pairs it has; the context is the 32 bytes
   before and after the anchor, all that its strings of 50 bytes can touch. What a smaller document of the
   same batch has as well, or one that the task remembers, is settled there and then; the rest is dealt out by anchor and streamed in sorted order: a
   context that a smaller document has is covered altogether.
2. Where one anchor has several contexts in several documents, matches begin or end nearby. One
   fragment (82 bytes) for each context goes to its anchor. Over the fragments, in document order,
   a suffix array is built; the longest previous factor of a suffix is the longer of the common prefixes with its
   previous and next smaller position (of a smaller document) in suffix order, and a suffix whose longest previous factor
   reaches 50 is removed. The result is a 33-bit mask of the strings around an anchor.
3. Masks are packed by document and joined with the texts, whose kept bytes come out.

A document that equals one with a smaller id is settled by its hash (MD5). Packed masks and requests are
broadcast if they are at most ``PACKED_BYTES`` (measured), else joined by a shuffle. Memory: a text is taken in slices of
``SLICE`` bytes, groups are streamed, fragments are taken ``FRAGMENTS`` at a time, and the fragments of an
anchor with more than ``MANY`` contexts are dealt out string by string, by the strings' hashes; of equal
strings the one of the smallest document is all that a later piece of the group needs.

Defined results: null texts are empty; texts under 50 bytes lose nothing; strings are judged on
the input; rows with equal ids do not cut each other; a null id neither cuts nor is cut; an
empty table gives an empty table; other columns are not read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import batches, small_batches, table, written
from tallgrove.llm.shingles import mix64

LENGTH, GRAM = 50, 18
SIDE = LENGTH - GRAM
FRAGMENT = LENGTH + SIDE
WHOLE = (1 << (SIDE + 1)) - 1
SLICE, FRAGMENTS, STREAMED = 1 << 20, 1 << 14, 1 << 18
#: Contexts of several documents that a task remembers from batch to batch (16 bytes each), so that it hands a frequent one on once.
KNOWN = 1 << 18
PACKED_BYTES = 32 << 20
#: Contexts of one anchor from which on its strings are dealt out one by one; the bit of a wanted number that says so.
MANY, HOT = 1 << 15, 1 << 30
#: Fixed value: base of the polynomial hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)


def windows_hashed(x: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every window of ``length`` values, by doubling."""
    with np.errstate(over="ignore"):
        powers = {1: (x, BASE)}
        step = 1
        while 2 * step <= length:
            h, b = powers[step]
            powers[2 * step] = (h[:-step] * b + h[step:], b * b)
            step *= 2
        m, done, out = len(x) - length + 1, 0, None
        while done < length:
            h, b = powers[step]
            out = h[:m] if out is None else out * b + h[done : done + m]
            done += step
            while step > 1 and step > length - done:
                step //= 2
        return out


def sliding(f, x: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over every window of ``width`` values."""
    step = 1
    m = len(x) - width + 1
    while 2 * step <= width:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[:m], x[width - step : width - step + m])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, context hash) of every anchor of a text of ``LENGTH`` bytes or more."""
    raw, n, found = np.frombuffer(text, np.uint8), len(text), []
    for start in range(0, n, SLICE):
        end = min(n, start + SLICE)
        low, high = max(0, start - SIDE), min(n, end + LENGTH)
        if high - low < LENGTH:
            low = max(0, high - LENGTH - SIDE)
        x = np.zeros(high - low + 2 * SIDE, np.uint64)
        x[SIDE : SIDE + high - low] = raw[low:high]
        x[SIDE : SIDE + high - low] += np.uint64(1)
        gram = mix64(windows_hashed(x[SIDE : SIDE + high - low], GRAM))
        least = sliding(np.minimum, gram, SIDE + 1)
        edge = np.zeros(SIDE, np.uint64)
        is_least = sliding(np.maximum, np.concatenate([edge, least, edge]), SIDE + 1) == gram
        p = np.flatnonzero(is_least)
        p = p[(p + low >= start) & (p + low < end)]
        a = gram[p]
        with np.errstate(over="ignore"):
            context = mix64(windows_hashed(x, FRAGMENT)[p] + a)
        found.append((p + low, a, context))
    return tuple(np.concatenate(c) for c in zip(*found))


def numbered(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first anchor of each different context, number of each anchor's context); numbers follow the sorted contexts."""
    _, first, number = np.unique(contexts, return_index=True, return_inverse=True)
    return first, number


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def contexts_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, c, doc, nr, done) from (doc, text): done if a smaller document of the batch, or one that the task remembers, has the context; then ``a`` is a salt."""
    known, first_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for b in batches(it, 1):
        parts = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if len(raw) >= LENGTH:
                _, a, c = anchors(raw)
                first, _ = numbered(c)
                parts.append((a[first], c[first], np.full(len(first), doc, np.int64), np.arange(len(first), dtype=np.int32)))
        if not parts:
            continue
        a, c, doc, nr = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, c))
        a, c, doc, nr = a[order], c[order], doc[order], nr[order]
        new = np.concatenate([[True], c[1:] != c[:-1]])
        at = np.flatnonzero(new)
        kind, least, several = c[at], doc[at], np.diff(np.append(at, len(c))) > 1
        if len(known):
            place = np.minimum(np.searchsorted(known, kind), len(known) - 1)
            met = known[place] == kind
            least = np.where(met, np.minimum(least, first_of[place]), least)
            several |= met
            rest = np.ones(len(known), bool)
            rest[place[met]] = False
            known, first_of = known[rest], first_of[rest]
        room = max(0, KNOWN - int(several.sum()))
        known, first_of = np.concatenate([kind[several][:KNOWN], known[:room]]), np.concatenate([least[several][:KNOWN], first_of[:room]])
        by_kind = np.argsort(known)
        known, first_of = known[by_kind], first_of[by_kind]
        done = doc > least[np.cumsum(new) - 1]
        with np.errstate(over="ignore"):
            a = np.where(done, mix64(doc.view(np.uint64) * BASE + nr.astype(np.uint64)), a)
        # equal ids may hold a context twice; one row is enough for a source
        once = done | new
        yield pa.record_batch([signed(a[once]), signed(c[once]), pa.array(doc[once]), pa.array(nr[once]), pa.array(done[once])], ["a", "c", "doc", "nr", "done"])
        twins = ~once
        if twins.any():
            yield pa.record_batch([signed(a[twins]), signed(c[twins]), pa.array(doc[twins]), pa.array(nr[twins]), pa.array(done[twins])], ["a", "c", "doc", "nr", "done"])


def settled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, nr, whole) from rows sorted by a, c, doc: whole = covered; else its fragment is wanted."""
    held: list[pa.RecordBatch] = []
    size = 0
    carried: tuple[int, int, int] | None = None  # anchor, context and least document of a group that goes on

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, carried
        t = pa.Table.from_batches(held)
        a, c, doc, nr, done = (t.column(i).to_numpy() for i in range(5))
        if done.any():
            yield pa.record_batch([pa.array(doc[done]), pa.array(nr[done]), pa.array(np.ones(int(done.sum()), bool))], ["doc", "nr", "whole"])
            a, c, doc, nr = a[~done], c[~done], doc[~done], nr[~done]
        end = len(a)
        if not last and end:
            end = int(np.searchsorted(a, a[-1])) if a[0] != a[-1] else 0
        going = not last and end == 0 and len(a) > STREAMED // 2
        keep = pa.record_batch([pa.array(x) for x in (a[end:], c[end:], doc[end:], nr[end:], np.zeros(len(a) - end, bool))], ["a", "c", "doc", "nr", "done"])
        if going:
            end, keep = len(a), keep.slice(0, 0)
        held, size = ([keep], keep.num_rows) if keep.num_rows else ([], 0)
        a, c, doc, nr = a[:end], c[:end], doc[:end], nr[:end]
        if not end:
            return
        group = np.concatenate([[True], a[1:] != a[:-1]])
        kind = group | np.concatenate([[True], c[1:] != c[:-1]])
        g, k = np.cumsum(group) - 1, np.cumsum(kind) - 1
        least = doc[kind].copy()
        goes_on = carried is not None and carried[0] == a[0]
        if goes_on and carried[1] == c[0]:
            least[0] = min(least[0], carried[2])
        starts = np.flatnonzero(group)
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        kinds = np.bincount(g, kind)
        hot = np.zeros(len(kinds), bool)
        if goes_on:
            several[0], kinds[0], hot[0] = True, 2, True
        if going:
            several[-1], kinds[-1], hot[-1] = True, 2, True
            carried = (int(a[-1]), int(c[-1]), int(least[-1]))
        whole = doc > least[k]
        wanted = ~whole & several[g] & (kinds[g] > 1)
        out = whole | wanted
        nr = np.where(wanted & ((kinds > MANY) | hot)[g], nr | HOT, nr).astype(np.int32)
        yield pa.record_batch([pa.array(doc[out]), pa.array(nr[out]), pa.array(whole[out])], ["doc", "nr", "whole"])

    for b in it:
        held.append(b)
        size += b.num_rows
        if size >= STREAMED:
            yield from work(last=False)
    if size:
        yield from work(last=True)


def fragments_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, doc, nr, low, high, bytes) from (doc, text, wanted numbers): the wanted contexts; strings low..high lie in the text."""
    for b in batches(it, 1):
        parts = []
        for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            raw = text.as_buffer().to_pybytes()
            p, a, c = anchors(raw)
            first, _ = numbered(c)
            nr = np.frombuffer(wanted.as_buffer(), np.int32)
            hot, nr = nr >= HOT, nr & (HOT - 1)
            at = p[first[nr]]
            x = np.zeros(len(raw) + 2 * SIDE + LENGTH, np.uint8)
            x[SIDE : SIDE + len(raw)] = np.frombuffer(raw, np.uint8)
            rows = x[at[:, None] + np.arange(FRAGMENT)]
            low = np.maximum(SIDE - at, 0)
            high = np.minimum(len(raw) - at - GRAM, SIDE)
            route = a[first[nr]]
            if hot.any():
                i, o = np.nonzero((np.arange(SIDE + 1) >= low[:, None]) & (np.arange(SIDE + 1) <= high[:, None]) & hot[:, None])
                with np.errstate(over="ignore"):
                    h = windows_hashed(rows[i].astype(np.uint64).ravel() + np.uint64(1), LENGTH)[np.arange(len(i)) * FRAGMENT + o]
                    h = mix64(h + np.uint64(1) + o.astype(np.uint64))
                keep = np.flatnonzero(~hot)
                route, nr, low, high = np.concatenate([route[keep], h]), np.concatenate([nr[keep], nr[i]]), np.concatenate([low[keep], o]), np.concatenate([high[keep], o])
                rows = np.concatenate([rows[keep], rows[i]])
            parts.append((route.view(np.int64), np.full(len(nr), doc, np.int64), nr.astype(np.int32), low.astype(np.int32), high.astype(np.int32), rows))
        if parts:
            a, doc, nr, low, high, rows = (np.concatenate(x) for x in zip(*parts))
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(FRAGMENT), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())
            yield pa.record_batch([pa.array(a), pa.array(doc), pa.array(nr), pa.array(low), pa.array(high), data], ["a", "doc", "nr", "low", "high", "bytes"])


def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes, given as rows of their first ``LENGTH`` bytes; common prefix of each with the one before, ``LENGTH`` at most)."""
    flat = np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()
    order = np.argsort(flat, kind="stable")
    s = rows[order]
    lcp = np.zeros(len(order), np.int64)
    same = s[1:] == s[:-1]
    lcp[1:] = np.where(same.all(axis=1), LENGTH, same.argmin(axis=1))
    return order, lcp


def smaller_before(rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest earlier place of a smaller rank (-1: none), and the common prefix with it.

    Places point to the one before; a pointer to a rank that is not smaller is replaced by that place's own pointer.
    """
    at, common = np.arange(-1, len(rank) - 1), lcp.copy()
    todo = np.arange(1, len(rank))
    todo = todo[rank[at[todo]] >= rank[todo]]
    while len(todo):
        via = at[todo]
        common[todo] = np.minimum(common[todo], common[via])
        at[todo] = at[via]
        todo = todo[at[todo] >= 0]
        todo = todo[rank[at[todo]] >= rank[todo]]
    common[at < 0] = 0
    return at, common


def previous_factors(order: np.ndarray, lcp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Length, ``LENGTH`` at most, of the longest previous factor of each suffix: its longest prefix that also starts in a document with a smaller id.

    It is the longer of the common prefixes with the previous and the next place of a smaller document in suffix order.
    """
    rank = doc[order]
    _, before = smaller_before(rank, lcp)
    _, after = smaller_before(rank[::-1], np.concatenate([[0], lcp[:0:-1]]))
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(before, after[::-1])
    return out


def masks_of(doc: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each fragment the mask of its strings that start in a smaller document too. Fragments of one anchor come together."""
    n = len(doc)
    with np.errstate(over="ignore"):
        flat = rows.astype(np.uint64).ravel() + np.uint64(1)
        h = windows_hashed(flat, LENGTH)
    place = (np.arange(n)[:, None] * FRAGMENT + np.arange(SIDE + 1)[None, :]).ravel()
    owner, offset = np.divmod(np.arange(n * (SIDE + 1)), SIDE + 1)
    inside = (offset >= low[owner]) & (offset <= high[owner])
    place, owner, offset = place[inside], owner[inside], offset[inside]
    _, at, count = np.unique(h[place], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    place, owner, offset = place[twice], owner[twice], offset[twice]
    mask = np.zeros(n, np.int64)
    if len(place):
        by_doc = np.argsort(doc[owner], kind="stable")
        place, owner, offset = place[by_doc], owner[by_doc], offset[by_doc]
        suffixes = rows.ravel()[place[:, None] + np.arange(LENGTH)]
        order, lcp = suffix_array(suffixes)
        gone = previous_factors(order, lcp, doc[owner]) == LENGTH
        np.bitwise_or.at(mask, owner[gone], np.int64(1) << offset[gone])
    return mask


def matched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, nr, mask) from fragments sorted by anchor."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(t: pa.Table) -> pa.RecordBatch:
        doc, low, high = (t.column(x).to_numpy() for x in ("doc", "low", "high"))
        rows = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(-1, FRAGMENT)
        mask = masks_of(doc, low, high, rows)
        some = mask != 0
        return pa.record_batch([pa.array(doc[some]), pa.array(t.column("nr").to_numpy()[some]), pa.array(mask[some])], ["doc", "nr", "mask"])

    for b in it:
        held.append(b)
        size += b.num_rows
        if size >= FRAGMENTS:
            t = pa.Table.from_batches(held)
            a = t.column("a").to_numpy()
            end = int(np.searchsorted(a, a[-1]))
            if end:
                yield work(t.slice(0, end))
                held = t.slice(end).combine_chunks().to_batches()
                size = t.num_rows - end
            elif size >= 4 * MANY:  # one string of many documents; the first has the smallest id
                yield work(t)
                held, size = t.slice(0, 1).to_batches(), 1
    if size:
        yield work(pa.Table.from_batches(held))


def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, data) from (doc, nr, mask) sorted by doc: numbers as int32 and masks as int64, zlib-compressed."""
    import zlib

    held: list[pa.RecordBatch] = []
    size = 0

    def work(t: pa.Table) -> pa.RecordBatch:
        doc, nr, mask = (t.column(i).to_numpy() for i in range(3))
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        ends = [*at[1:], len(doc)]
        data = [zlib.compress(nr[s:e].astype(np.int32).tobytes() + mask[s:e].tobytes(), 1) for s, e in zip(at, ends)]
        return pa.record_batch([pa.array(doc[at]), pa.array(data, pa.binary())], ["doc", "data"])

    for b in it:
        held.append(b)
        size += b.num_rows
        if size >= STREAMED:
            t = pa.Table.from_batches(held)
            doc = t.column(0).to_numpy()
            end = int(np.searchsorted(doc, doc[-1]))
            if end:
                yield work(t.slice(0, end))
            held = t.slice(end).combine_chunks().to_batches()
            size = t.num_rows - end
    if size:
        yield work(pa.Table.from_batches(held))


def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_bytes, n_removed, n_spans, kept) from (key, text, copy, data)."""
    import zlib

    for b in batches(it, 1):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, copy, data in zip(b.column(1), b.column(2).to_pylist(), b.column(3)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            n = len(raw)
            n_bytes.append(n)
            if copy and n >= LENGTH:
                n_removed.append(n), n_spans.append(1), kept.append(b"")
            elif not data.is_valid or n < LENGTH:
                n_removed.append(0), n_spans.append(0), kept.append(raw)
            else:
                flat = zlib.decompress(data.as_buffer())
                m = len(flat) // 12
                nr, mask = np.frombuffer(flat, np.int32, m), np.frombuffer(flat, np.int64, m, 4 * m)
                p, _, c = anchors(raw)
                first, number = numbered(c)
                of = np.zeros(len(first), np.int64)
                np.bitwise_or.at(of, nr, mask)
                own = of[number]
                edge = np.zeros(n + 1, np.int64)
                whole = own == WHOLE
                np.add.at(edge, np.maximum(p[whole] - SIDE, 0), 1)
                np.add.at(edge, np.minimum(p[whole] + LENGTH, n), -1)
                part = np.flatnonzero((own != 0) & ~whole)
                row, offset = np.nonzero((own[part][:, None] >> np.arange(SIDE + 1)) & 1)
                start = p[part[row]] - SIDE + offset
                np.add.at(edge, start, 1)
                np.add.at(edge, start + LENGTH, -1)
                gone = np.cumsum(edge[:n]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        yield pa.record_batch([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _small(df: DataFrame, size: str) -> DataFrame:
    """``df`` (written), to be broadcast if column ``size`` and 16 bytes a row come to at most ``PACKED_BYTES``."""
    total = df.agg(F.sum(F.octet_length(size) + 16)).first()[0] or 0
    return F.broadcast(df) if total <= PACKED_BYTES else df


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row."""
    docs = small_batches(df).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = docs.withColumn("t", F.unhex(F.md5("text")))
    twins = written(keyed.where(F.octet_length("text") >= LENGTH).groupBy("t").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("t").alias("t2"), "least"))
    twins = _small(twins, "t2")
    keyed = keyed.join(twins, F.col("t") == F.col("t2"), "left").withColumn("copy", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)))
    own = keyed.where(~F.col("copy") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc"), "text")

    rows = own.mapInArrow(contexts_of, "a long, c long, doc long, nr int, done boolean").repartition("a").sortWithinPartitions("a", "c", "doc")
    state = written(rows.mapInArrow(settled, "doc long, nr int, whole boolean"))

    ask = state.where(~F.col("whole")).repartition("doc").sortWithinPartitions("doc", "nr")
    asked = written(ask.mapInArrow(_numbers, "doc long, wanted binary"))
    wanted = own.join(_small(asked.withColumnRenamed("doc", "doc2"), "wanted"), F.col("doc") == F.col("doc2")).select("doc", "text", "wanted")
    parts = wanted.mapInArrow(fragments_of, "a long, doc long, nr int, low int, high int, bytes binary").repartition("a").sortWithinPartitions("a", "doc")
    masks = parts.mapInArrow(matched, "doc long, nr int, mask long")

    covered = state.where("whole").select("doc", "nr", F.lit(WHOLE).alias("mask")).unionByName(masks)
    data = written(covered.repartition("doc").sortWithinPartitions("doc", "nr").mapInArrow(packed, "doc long, data binary"))
    last = keyed.join(_small(data, "data"), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "copy", "data")
    return last.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _numbers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, wanted) from (doc, nr) sorted by doc: different numbers as packed int32."""
    held: list[pa.RecordBatch] = []
    size = 0

    def work(t: pa.Table) -> pa.RecordBatch:
        doc, nr = t.column(0).to_numpy(), t.column(1).to_numpy()
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        data = [np.unique(nr[s:e]).astype(np.int32).tobytes() for s, e in zip(at, [*at[1:], len(doc)])]
        return pa.record_batch([pa.array(doc[at]), pa.array(data, pa.binary())], ["doc", "wanted"])

    for b in it:
        held.append(b)
        size += b.num_rows
        if size >= STREAMED:
            t = pa.Table.from_batches(held)
            doc = t.column(0).to_numpy()
            end = int(np.searchsorted(doc, doc[-1]))
            if end:
                yield work(t.slice(0, end))
            held = t.slice(end).combine_chunks().to_batches()
            size = t.num_rows - end
    if size:
        yield work(pa.Table.from_batches(held))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text."""
    done = dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
