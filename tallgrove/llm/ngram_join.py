"""N-gram Jaccard self-join by chosen paths: all pairs of texts whose word shingles have a Jaccard similarity of ``SIMILARITY`` or more.

1. Equal texts become one (told apart by a 64-bit hash); everything below is about different texts. Each text
   keeps a sketch, the ``SKETCH`` smallest hashes of its shingles.
2. There are ``RUNS`` runs. Each run owns a class of tokens; a text chooses its ``PICKS`` smallest ones of the class, and
   the texts that share a chosen token form a node. A node of more than ``SMALL`` texts is split again: each text
   chooses ``PICKS`` further tokens of its sketch, by a hash seeded with the node's path, and so on, down to ``DEPTH``
   levels. Small nodes are leaves. So is a node whose children would hold more than ``PAYS`` of its own pairs (texts that are
   alike: splitting brings nothing) and one at the last level; those are compared in blocks.
3. Recall: a pair of similarity J shares a chosen token with probability J, so it comes down d levels of a run with
   probability f(d) = 1 - (1 - J f(d - 1)) ** PICKS, f(0) = 1. Runs are repeated until a pair at ``SIMILARITY`` is missed
   by all of them, at the last level, with probability 1 - ``RECALL`` at most.
4. Leaves are brute-forced: common values of sketches are counted by matrix
   products; texts with a partner go on, with whole shingle sets, to an exact check in blocks of at most ``SMALL`` texts
   and about ``VALUES`` hashes. A pair is handled only in the smallest of its common leaves (each text carries the list
   of its leaves), so it counts once and pairs are never
   written out: a bucket returns a number of links and a root for each text.
5. Roots are joined to classes by contraction rounds, each written to the shared folder.

Nothing is capped or sampled away. Defined results: texts of one to four words are one shingle;
texts without words (null, empty, white) have none and are linked to equal texts only (null equals
empty); rows with equal ids are documents of their own; the class id is the smallest doc_id of the class; an
empty table gives an empty table; other columns are not read by the join and pass through the stage, whatever their names.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import batches, free_name, near, small_batches, table, written
from tallgrove.llm.shingles import CHAIN, mix64, shingle_sets

WORDS, SIMILARITY, RECALL = 5, 0.8, 1 - 1e-6
PICKS, DEPTH, PAYS = 2, 3, 0.5
SKETCH, SMALL, VALUES = 48, 2048, 1 << 20


def survival(similarity: float, depth: int) -> float:
    """Probability that a pair is still together ``depth`` levels down one run."""
    return 1 - (1 - similarity * survival(similarity, depth - 1)) ** PICKS if depth else 1.0


#: Runs until the target recall is reached.
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - survival(SIMILARITY, DEPTH)))
#: A pair goes on to the exact check if its sketches share this part of the shorter one. At J = 0.8 fewer has a probability of about 1e-6.
PROMISING = 0.5
#: Rows up to which ids are broadcast (8 to 16 bytes each).
FEW = 2_000_000


def listed(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int64()))


def first_of_each(group: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` rows of each group; equal groups stand together."""
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    at = np.arange(len(group))
    return np.flatnonzero(at - at[new][np.cumsum(new) - 1] < most)


def picked(sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens, tokens) that each text chooses at the roots: the ``PICKS`` smallest of each run's class."""
    flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    key = owner * RUNS + flat % RUNS
    order = np.argsort(key, kind="stable")
    order = order[first_of_each(key[order], PICKS)]
    return np.bincount(owner[order], minlength=len(sketches)), flat[order]


def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, path, n, child, used) from (x, path, n, used, sketch): the children that each text of a node chooses, by tokens not used on the path."""
    for b in it:
        if not b.num_rows:
            continue
        x, path, n = (b.column(i).to_numpy() for i in range(3))
        used = b.column(3).flatten().to_numpy().reshape(len(x), -1)
        sizes = np.diff(b.column(4).offsets.to_numpy())
        flat, owner = b.column(4).flatten().to_numpy(), np.repeat(np.arange(len(x)), sizes)
        free = np.flatnonzero((used[owner] != flat[:, None]).all(axis=1))
        flat, owner = flat[free], owner[free]
        none = np.setdiff1d(np.arange(len(x)), owner)  # a text whose tokens are all used stays with those of the same tokens
        flat, owner = np.concatenate([flat, np.zeros(len(none), np.int64)]), np.concatenate([owner, none])
        seed = mix64(path.view(np.uint64))
        order = np.lexsort((mix64(flat.view(np.uint64) ^ seed[owner]), owner))
        order = order[first_of_each(owner[order], PICKS)]
        flat, owner = flat[order], owner[order]
        with np.errstate(over="ignore"):
            child = (mix64(seed[owner] * CHAIN + flat.view(np.uint64)) >> np.uint64(1)).view(np.int64)
        deeper = np.concatenate([used[owner], flat[:, None]], axis=1)
        yield pa.record_batch([pa.array(x[owner]), pa.array(path[owner]), pa.array(n[owner]), pa.array(child), listed(np.full(len(owner), deeper.shape[1]), deeper.ravel())], ["x", "path", "n", "child", "used"])


def sketched(docs: DataFrame) -> DataFrame:
    """(x, doc_id, copies, size, sketch, picks) of each different text."""

    def sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 2, 2 << 20):
            x = b.column(0).to_numpy()
            _, first = np.unique(x, return_index=True)
            sets = shingle_sets(b.column(2).take(pa.array(first)).to_pylist(), WORDS)
            small = [s[:SKETCH] for s in sets]
            yield pa.record_batch([pa.array(x[first]), pa.array([len(s) for s in sets], pa.int32()), pa.array(small, pa.list_(pa.int64())), listed(*picked(small))], ["x", "size", "sketch", "picks"])

    sketches = docs.select("x", "doc_id", "text").mapInArrow(sketch, "x long, size int, sketch array<long>, picks array<long>")
    one = sketches.groupBy("x").agg(*(F.first(c).alias(c) for c in ("size", "sketch", "picks")))
    ids = docs.groupBy("x").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return ids.join(one, "x")


def grouped(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = bool(held) and any(held[-1].column(i)[-1].as_py() != b.column(i)[0].as_py() for i in range(keys))
        at = [0, *np.flatnonzero(change), b.num_rows]
        for start, end in zip(at, at[1:]):
            if change[start] and held:
                yield pa.Table.from_batches(held)
                held = []
            if end > start:
                held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers of common values of each left and each right set: products of incidence matrices, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    shared = count > 1
    place = np.cumsum(shared) - 1
    kept = shared[at]
    col, row = place[at[kept]], owner[kept]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    step = max(64, min(4096, (4 << 20) // max(1, len(sets))))
    for start in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(col, [start, start + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[a:b], col[a:b] - start] = 1
        out += m[left] @ m[right].T
    return out


def candidates_in(group: pa.Table, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, matrix: which pairs of the group are near and belong here)."""
    tok, bi, bj = (group.column(i)[0].as_py() for i in range(3))
    block = group.column("block").to_numpy()
    size = group.column("size").to_numpy().astype(np.int64)
    sets = [np.asarray(v.values) for v in group.column("sketch").combine_chunks()]
    left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    if len(left) == 0 or len(right) == 0:
        return left, right, np.zeros((len(left), len(right)), bool)
    common = common_counts(sets, left, right)
    if exact:
        ok = common >= SIMILARITY * (size[left][:, None] + size[right][None, :] - common) - 1e-9
    else:
        n = np.minimum(size, SKETCH)
        ok = common >= PROMISING * np.minimum(n[left][:, None], n[right][None, :])
    if bi == bj:
        ok &= left[:, None] != right[None, :]
    # a pair belongs to the smallest of its common leaves: no smaller one may be common
    smaller = [p[p < tok] for p in (np.asarray(v.values) for v in group.column("leaves").combine_chunks())]
    if any(map(len, smaller)):
        ok &= common_counts(smaller, left, right) == 0
    return left, right, ok


def promising(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the buckets that have a promising partner there."""
    names = ["tok", "bi", "bj", "block", "x"]
    out: dict[str, list] = {n: [] for n in names}
    held = 0

    def batch() -> pa.RecordBatch:
        b = pa.record_batch([pa.array(np.concatenate(out[n]) if out[n] else np.zeros(0, np.int64)) for n in names], names)
        for n in names:
            out[n] = []
        return b

    for g in grouped(it, 3):
        if g.num_rows < 2:
            continue
        left, right, ok = candidates_in(g, exact=False)
        rows = np.union1d(left[ok.any(axis=1)], right[ok.any(axis=0)])
        if len(rows):
            for n in names:
                out[n].append(g.column(n).to_numpy()[rows])
            held += len(rows)
            if held > 1 << 16:
                yield batch()
                held = 0
    yield batch()


def linked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, links, root): exact links of each text in its bucket and the smallest x of its component there."""
    for g in grouped(it, 3):
        if g.num_rows < 2:
            continue
        left, right, ok = candidates_in(g, exact=True)
        if not ok.any():
            continue
        x, copies = g.column("x").to_numpy(), g.column("copies").to_numpy()
        links = np.zeros(len(x), np.int64)
        links[left] += ok @ copies[right]
        if g.column(1)[0].as_py() != g.column(2)[0].as_py():
            links[right] += ok.T @ copies[left]
        root = x.copy()
        while True:  # least label among neighbours, then among the labels' own: a few rounds
            before = root.copy()
            big = np.iinfo(np.int64).max
            root[left] = np.minimum(root[left], np.where(ok, root[right][None, :], big).min(axis=1))
            root[right] = np.minimum(root[right], np.where(ok, root[left][:, None], big).min(axis=0))
            if (root == before).all():
                break
        some = links > 0
        yield pa.record_batch([pa.array(x[some]), pa.array(links[some]), pa.array(root[some])], ["x", "links", "root"])


def in_buckets(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    return rows.repartition("tok", "bi", "bj").sortWithinPartitions("tok", "bi", "bj").mapInArrow(f, schema)


def leaves(reps: DataFrame) -> DataFrame:
    """(tok, x, n): the leaves of each text, and how many texts a leaf has (two or more)."""
    rows = reps.select("x", F.explode("picks").alias("path")).withColumn("used", F.array("path"))
    out = None
    for depth in range(1, DEPTH + 1):
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = written(rows.join(counts, "path").select("x", "path", "n", "used"))
        done = rows if depth == DEPTH else rows.where(F.col("n") <= SMALL)
        large = rows.where(F.col("n") > SMALL)
        last = depth == DEPTH or large.isEmpty()
        if not last:
            below = written(large.join(reps.select("x", "sketch"), "x").select("x", "path", "n", "used", "sketch").mapInArrow(split, "x long, path long, n long, child long, used array<long>"))
            pairs = below.groupBy("path", "child").agg(F.count(F.lit(1)).cast("double").alias("c"), F.first("n").alias("n"))
            pairs = pairs.groupBy("path").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("below"), F.first("n").cast("double").alias("n"))
            alike = written(pairs.where(F.col("below") > PAYS * F.col("n") * (F.col("n") - 1)).select(F.col("path").alias("alike")))
            alike = near(alike, FEW)
            done = done.unionByName(large.join(alike, F.col("path") == F.col("alike"), "left_semi"))
            rows = below.join(alike, F.col("path") == F.col("alike"), "left_anti").select("x", F.col("child").alias("path"), "used")
        done = done.select(F.col("path").alias("tok"), "x", "n")
        out = done if out is None else out.unionByName(done)
        if last:
            return out


def dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """(tok, bi, bj, block, x) of (tok, x) rows: a bucket of several blocks is compared in pairs of blocks."""
    rows = rows.withColumn("nb", F.greatest(F.ceil(blocks), F.lit(1)).cast("int"))
    small = rows.where("nb = 1").select("tok", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("block"), "x")
    large = rows.where("nb > 1").withColumn("block", F.pmod(F.xxhash64("x", F.lit(7)), F.col("nb")).cast("int"))
    large = large.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    large = large.select("tok", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"), "block", "x")
    return small.unionByName(large)


def components(edges: DataFrame) -> DataFrame:
    """(x, root) for every vertex of the (a, b) edges: contraction to least neighbours, a written table a round."""
    edges = written(edges.where("a <> b").distinct())
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        to = least.select(F.col("a").alias("b"), F.col("m").alias("n"))
        edges = written(edges.join(least, "a").join(to, "b").select(F.col("m").alias("a"), F.col("n").alias("b")).where("a <> b").distinct())
        step = least.select(F.col("a").alias("root"), F.col("m").alias("next"))
        if label is None:
            label = least.select(F.col("a").alias("x"), F.col("m").alias("root"))
        else:
            label = written(label.join(step, "root", "left").select("x", F.coalesce("next", "root").alias("root")))
    return label if label is not None else edges.select(F.col("a").alias("x"), F.col("b").alias("root"))


def with_hash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, x): x stands for the text, null as empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))


def classes_of(docs: DataFrame) -> DataFrame:
    """(x2, class_id, keep_x, n_links) of each different text of ``with_hash``; keep_x is the text of the class's row to be kept."""
    reps = written(sketched(small_batches(docs)))
    tree = written(leaves(reps))
    own = tree.groupBy("x").agg(F.collect_list("tok").alias("leaves"))
    about = written(own.join(reps.select("x", "size", "sketch"), "x"))
    rows = dealt(tree, F.col("n") / SMALL).join(about, "x").select("tok", "bi", "bj", "block", "x", "size", "sketch", "leaves")
    found = written(in_buckets(rows, promising, "tok long, bi int, bj int, block int, x long").select("tok", "x").distinct())
    wanted = written(found.select("x").distinct().join(reps.select("x", "doc_id", "copies", "size"), "x"))

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 3, 2 << 20):
            sets = shingle_sets(b.column(3).to_pylist(), WORDS)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.list_(pa.int64()))], ["x", "copies", "size", "sketch"])

    few = near(wanted.withColumnRenamed("x", "x2").withColumnRenamed("doc_id", "id2"), FEW)
    texts = docs.join(few, (F.col("x") == F.col("x2")) & F.col("doc_id").eqNullSafe(F.col("id2"))).select("x", "copies", "size", "text")
    sets = texts.mapInArrow(whole, "x long, copies long, size int, sketch array<long>").dropDuplicates(["x"])
    held = found.join(wanted.select("x", "size"), "x")
    load = held.groupBy("tok").agg(F.greatest(F.sum("size") / VALUES, F.count(F.lit(1)) / SMALL).alias("blocks"))
    again = dealt(held.join(load, "tok"), F.col("blocks"))
    rows = again.join(sets, "x").join(about.select("x", "leaves"), "x").select("tok", "bi", "bj", "block", "x", "copies", "size", "sketch", "leaves")
    exact = in_buckets(rows, linked, "x long, links long, root long")
    exact = written(exact)
    links = exact.groupBy("x").agg(F.sum("links").alias("links"))
    roots = components(exact.select(F.col("x").alias("a"), F.col("root").alias("b")))
    classes = reps.select("x", "doc_id", "copies").join(links, "x", "left").join(roots, "x", "left")
    classes = classes.select("x", "doc_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "x").alias("root"))
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("k"))
    least = least.select("root", F.col("k.doc_id").alias("class_id"), F.col("k.x").alias("keep_x"))
    return classes.join(least, "root").select(F.col("x").alias("x2"), "class_id", "keep_x", "n_links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) for every row; n_links counts the other documents that are near it, equal ones too."""
    docs = with_hash(docs, doc_id, text)
    return docs.select("doc_id", "x").join(classes_of(docs), F.col("x") == F.col("x2")).select("doc_id", "class_id", "n_links")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class id and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of the smallest id (a null one last), then of the smallest text hash. Rows go by id and text, never by id alone."""
    hashed = with_hash(docs)
    rows = hashed.select("doc_id", "x").join(classes_of(hashed), F.col("x") == F.col("x2"))
    gone = written(rows.where((F.col("x") != F.col("keep_x")) | ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "x").distinct())
    x, own, own_x = free_name(docs, "hash"), free_name(docs, "gone"), free_name(docs, "gone_hash")
    gone = gone.select(F.col("doc_id").alias(own), F.col("x").alias(own_x))
    kept = docs.withColumn(x, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = kept.join(near(gone, FEW), (F.col(x) == F.col(own_x)) & F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", x])).drop(x)
