"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same text as which of another, and how often in a corpus.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a piece BPE with byte fallback (B). Byte-owner arrays
(``np.repeat`` of token numbers over their bytes) of A and B stand side by side: consecutive different pairs of owners are the overlaps,
and bytes where both owners change are cuts. Between cuts lies a group of A tokens and B tokens that cover the same bytes; all its A-B pairs are links.

Corpus-wide counts take two shuffles of pairs that were counted before, by batches of whole documents: a batch has each different id pair
once, with the number of its documents that hold it. Batches are joined to the sums and get their own pairs' counts back, so a pair that is in
every document is one row a batch, and nothing that grows with the corpus is broadcast (the highest count of each A id is: one row for
each id of the vocabulary).

Texts are cut before a single space between other characters than white space. No token of either tokenizer reaches over such a place (A's pattern takes a space
only at the start of a token or in a run of white space, B has no piece with a space after other characters, which is checked), so the parts
are encoded once and remembered. The owner arrays are made of whole texts, a window of bytes after another.

Defined results: texts that are null or empty, or whose tokens do not give back the bytes of space and text, have no tokens; texts of any length are
taken whole (one part without such a place is encoded at once); repeated rows are documents of their own, and equal documents count as several; an
empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.bpe import byte_characters
from tallgrove.llm.common import batches, small_batches, table, written

#: Fixed value: the character that stands for a space in B's pieces.
SPACE = "▁"
#: Bytes whose owners are held at once.
WINDOW = 1 << 20
#: Links that are made at once.
STEP = 1 << 21
#: Parts that a task remembers, of at most ``SHORT`` characters; beyond it the memory starts afresh (speed only).
REMEMBERED, SHORT = 300_000, 64
#: Bytes of text, and different pairs, after which a batch of documents ends.
BATCH, PAIRS = 64 << 20, 1 << 20

#: Where a text may be cut, and what a text must hold for single spaces to stand elsewhere.
CUT, TWICE = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"\s\s")
#: Parts that are encoded at once.
JOINED = 200


class Tokenizers:
    """Ids of A and B for texts, and the lengths in bytes of their tokens."""

    def __init__(self, a: str, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        to_byte = {c: i for i, c in enumerate(byte_characters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.local = not any(SPACE in p.lstrip(SPACE) or " " in p for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def learn(self, parts: list[str]) -> None:
        """Encodes parts, each of which begins with a space. Those that may stand side by side are encoded ``JOINED`` at once and told apart by their bytes' ends."""
        plain = [p for p in parts if len(p) > 1 and not p[1].isspace() and not p[-1].isspace()] if self.local else []
        for i in range(0, len(plain), JOINED):
            self.learn_joined(plain[i : i + JOINED])
        for p in parts:
            if p not in self.known:
                self.known[p] = self.learn_one(p)

    def ids_of(self, text: str) -> tuple[list[int], list[int]]:
        """(A ids, B ids) of a text that begins with a space; B adds its own."""
        (a,) = self.a.encode_batch_fast([text], add_special_tokens=False)
        return a.ids, self.b.encode(text[1:], num_threads=1)

    def learn_one(self, part: str) -> tuple[bytes, bytes] | None:
        """The packed ids of a part; None where the tokens' bytes are not those of the part."""
        x, y = self.ids_of(part)
        if not b"".join([self.bytes_a[i] for i in x]) == part.encode() == b"".join([self.bytes_b[i] for i in y]):
            return None
        return np.array(x, "<i4").tobytes(), np.array(y, "<i4").tobytes()

    def learn_joined(self, parts: list[str]) -> None:
        text = "".join(parts)
        x, y = self.ids_of(text)
        if not b"".join([self.bytes_a[i] for i in x]) == text.encode() == b"".join([self.bytes_b[i] for i in y]):
            return  # they are learnt one by one
        x, y = np.array(x, "<i4"), np.array(y, "<i4")
        ends = np.cumsum([len(p.encode()) for p in parts])
        at_x, at_y = (4 * (np.searchsorted(np.cumsum(size[ids]), ends) + 1) for size, ids in ((self.size_a, x), (self.size_b, y)))
        raw_x, raw_y = x.tobytes(), y.tobytes()
        i = j = 0
        for p, k, m in zip(parts, at_x.tolist(), at_y.tolist()):
            self.known[p] = (raw_x[i:k], raw_y[j:m])
            i, j = k, m

    def cut(self, text: str | None) -> list[str]:
        """Parts of space and text that encode as they do in the whole."""
        if not text:
            return []
        text = " " + text
        if not self.local:
            return [text]
        if TWICE.search(text) is None and text[-1] != " ":
            return [" " + p for p in text[1:].split(" ")]
        return CUT.split(text)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(A ids, B ids) of each text."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        missing = list({p: None for own in cut for p in own if p not in self.known})
        if missing:
            self.learn(missing)
        out = []
        for own in cut:
            found = [self.known[p] for p in own]
            x, y = zip(*found) if found and all(found) else ((), ())
            out.append((np.frombuffer(b"".join(x), "<i4"), np.frombuffer(b"".join(y), "<i4")))
        for p in missing:
            if len(p) > SHORT:
                del self.known[p]
        return out


def owners(ends: np.ndarray, start: int, end: int) -> np.ndarray:
    """The number of the token that owns each byte of [start, end), from the tokens' ends."""
    i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, end, side="left")
    edges = np.minimum(ends[i : j + 1], end)
    return np.repeat(np.arange(i, j + 1), np.diff(edges, prepend=start))


def aligned(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(A tokens up to each cut, B tokens up to each cut, number of overlaps) from the sizes in bytes of tokens that cover the same bytes."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    cut_a, cut_b, overlaps = [], [], 0
    last = (-1, -1)
    for s in range(0, total, WINDOW):
        a, b = (owners(e, s, min(s + WINDOW, total)) for e in (ends_a, ends_b))
        new_a, new_b = (np.diff(x, prepend=p) != 0 for x, p in ((a, last[0]), (b, last[1])))
        overlaps += int(np.count_nonzero(new_a | new_b))
        at = np.flatnonzero(new_a & new_b)
        cut_a.append(a[at])
        cut_b.append(b[at])
        last = int(a[-1]), int(b[-1])
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    # a cut begins a group: the next one's tokens end it
    return np.append(np.concatenate(cut_a)[1:], len(size_a)), np.append(np.concatenate(cut_b)[1:], len(size_b)), overlaps


class Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, a: int, b: int) -> None:
        self.a, self.b = a, b
        ids = [str(i) for i in range(max(a, b))]
        self.strings = np.array([s + mark for mark in ",|;" for s in ids] + ids, object)
        self.n = len(ids)

    def __call__(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
        if not len(to_a):
            return ""
        out = np.empty(len(a) + len(b), np.int64)
        in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[to_a - 1], mark_b[to_b - 1] = 1, 2
        mark_b[-1] = 3
        out[np.arange(len(a)) + np.repeat(to_b - in_b, in_a)] = a + mark_a * self.n
        out[np.arange(len(b)) + np.repeat(to_a, in_b)] = b + mark_b * self.n
        return "".join(self.strings[out].tolist())


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(codes, return_inverse=True)
    return own, np.bincount(at, times, len(own)).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(id pairs as a * width + b, sorted; how many links of each) of all A-B pairs within groups."""
    in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    n = in_a * in_b
    codes, times = [], []
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        if n[i] > STEP:  # a group of very many pairs: its different ids with their numbers, some A ids at a time
            x, cx = np.unique(a[to_a[i] - in_a[i] : to_a[i]], return_counts=True)
            y, cy = np.unique(b[to_b[i] - in_b[i] : to_b[i]], return_counts=True)
            step = max(1, STEP // len(y))
            for s in range(0, len(x), step):
                codes.append((x[s : s + step, None].astype(np.int64) * width + y).ravel())
                times.append((cx[s : s + step, None] * cy).ravel())
            i += 1
            continue
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + STEP, side="right")))
        own = np.arange(i, j)
        group = np.repeat(own, n[i:j])
        k = np.arange(len(group)) - np.repeat(ends[i:j] - n[i:j] - before, n[i:j])
        x = a[(to_a - in_a)[group] + k // in_b[group]].astype(np.int64)
        y = b[(to_b - in_b)[group] + k % in_b[group]]
        c, t = np.unique(x * width + y, return_counts=True)
        codes.append(c)
        times.append(t)
        i = j
    if len(codes) == 1:
        return codes[0], times[0].astype(np.int64)
    return summed(np.concatenate(codes), np.concatenate(times)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def packed(codes: np.ndarray) -> bytes:
    """Sorted codes as differences, in 4 bytes each where the last code fits."""
    small = not len(codes) or codes[-1] < 1 << 32
    return (b"\x04" if small else b"\x08") + np.diff(codes, prepend=0).astype("<u4" if small else "<u8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u8", offset=1).astype(np.int64))


OWN = ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups", "codes", "times"]


def alignments(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document (doc_id, n_a, n_b, n_groups, n_overlaps, n_links, groups, codes, times, batch), and one for each batch of documents (batch, codes, times).

    ``a`` and ``b`` are the paths of A's JSON and B's model on the driver; the closure carries their bytes (2 MB, fixed by the vocabularies). A document's
    codes are its different linked id pairs, packed, with their links; those of a batch come with the number of its documents that hold them.
    """
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        files = f.read(), g.read()
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def align(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizers, ids = Tokenizers(*files), None
        write, width = Writer(len(tokenizers.size_a), len(tokenizers.size_b)), len(tokenizers.size_b)
        task, number, size = TaskContext.get().partitionId() << 33, 0, 0
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        waiting = 0

        def merged() -> None:
            held[:] = [summed(np.concatenate([c for c, _ in held]), np.concatenate([t for _, t in held]))]

        def batch_row() -> pa.RecordBatch:
            codes, docs = held[0]
            none = [pa.nulls(1, t) for t in (ids, *[pa.int64()] * 5, pa.string())]
            held[:] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            return pa.record_batch([*none, pa.array([packed(codes)]), pa.array([docs.astype("<i4").tobytes()]), pa.array([task + number], pa.int64())], [*OWN, "batch"])

        for b in batches(it, 1, 1 << 20):
            ids = b.column(0).type
            texts = b.column(1).to_pylist()
            rows = []
            for x, y in tokenizers.encode(texts):
                to_a, to_b, overlaps = aligned(tokenizers.size_a[x], tokenizers.size_b[y])
                codes, times = linked(x, y, to_a, to_b, width)
                rows.append((len(x), len(y), len(to_a), overlaps, int(times.sum()), write(x, y, to_a, to_b), packed(codes), times.astype("<i4").tobytes() if times.max(initial=0) < 1 << 31 else times.astype("<i8").tobytes()))
                held.append((codes, np.ones(len(codes), np.int64)))
                waiting += len(codes)
                if waiting > PAIRS:
                    merged()
                    waiting = 0
            if rows:
                kinds = (*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary())
                yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)), pa.array([task + number] * len(rows), pa.int64())], [*OWN, "batch"])
            size += b.column(1).nbytes
            if size > BATCH or len(held[0][0]) > PAIRS:
                merged()
                waiting = 0
                yield batch_row()
                number, size = number + 1, 0
        merged()
        if ids is not None:
            yield batch_row()

    return small_batches(docs).mapInArrow(align, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups string, codes binary, times binary, batch long")


def pair_counts(batches_of: DataFrame) -> DataFrame:
    """(code, batch) of the batches' rows."""

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for codes, docs, batch in zip(*(b.column(i).to_pylist() for i in range(3))):
                own, n = unpacked(codes), np.frombuffer(docs, "<i4").astype(np.int64)
                for s in range(0, len(own), 1 << 16):
                    c = own[s : s + (1 << 16)]
                    yield pa.record_batch([pa.array(c), pa.array(n[s : s + (1 << 16)]), pa.array(np.full(len(c), batch))], ["code", "docs", "batch"])

    return batches_of.select("codes", "times", "batch").mapInArrow(unpack, "code long, docs long, batch long")


def counted(rows: DataFrame, width: int) -> DataFrame:
    """The documents' rows of ``alignments``, written, with n_best (links whose pair has the highest count of its A id) and count_sum (the links' counts)."""
    asked = pair_counts(rows.where("n_a is null"))
    counts = written(asked.groupBy("code").agg(F.sum("docs").alias("count")))
    a = F.expr(f"code div {width}")
    highest = counts.groupBy(a.alias("a")).agg(F.max("count").alias("highest"))  # at most a row for each id of A
    known = counts.withColumn("a", a).join(F.broadcast(highest), "a").select("code", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = asked.select("batch", "code").join(known, "code").select("batch", F.lit(0).alias("kind"), "code", "count", "best")
    passed = [c for c in rows.columns if c not in ("codes", "times", "batch")]
    docs = rows.where("n_a is not null").select("batch", F.lit(1).alias("kind"), "codes", "times", *passed)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in passed) + ", n_best long, count_sum long"

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, now = [], None, None
        for b in it:
            batch, what = b.column("batch").to_numpy(), b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((batch[1:] != batch[:-1]) | (what[1:] != what[:-1])) + 1), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                own = b.slice(s, e - s)
                if batch[s] != now:
                    held, known, now = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))], None, batch[s]
                if what[s] == 0:
                    held.append((own.column("code").to_numpy(), own.column("count").to_numpy(), own.column("best").to_numpy(zero_copy_only=False)))
                    continue
                known = known or [np.concatenate(x) for x in zip(*held)]
                code, count, best = known
                held, sums = [], []
                for codes, times in zip(own.column("codes").to_pylist(), own.column("times").to_pylist()):
                    c = unpacked(codes)
                    t = np.frombuffer(times, "<i4" if len(times) == 4 * len(c) else "<i8").astype(np.int64)
                    at = np.searchsorted(code, c)
                    sums.append((int(t[best[at]].sum()), int((t * count[at]).sum())))
                yield pa.record_batch([*(own.column(c) for c in passed), *(pa.array(x, pa.int64()) for x in zip(*sums))], [*passed, "n_best", "count_sum"])

    met = told.unionByName(docs, allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "kind", "code")
    return met.mapInArrow(score, schema)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document between the byte-level BPE and the piece BPE, with the links' corpus-wide counts."""
    import public_tokenizers as vocab

    a, b = vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")
    rows = alignments(table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = written(rows.withColumn("groups_sha256", digest).withColumn("part", F.when(F.col("n_a").isNull(), "batch").otherwise("doc")).drop("groups"), ["part"]).drop("part")
    return counted(rows, vocabulary_size(b)).select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "n_best", "count_sum", "groups_sha256")


def vocabulary_size(b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
