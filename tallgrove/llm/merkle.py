"""Merkle dataset manifest: a hash tree over all rows with a proof for each, its upper part built by the driver and broadcast.

Leaves are ordered by group and key and every ``FAN`` consecutive nodes become their hash, until one node of the group is left, its
subroot; the subroots, in order of their groups, become the root likewise.

1. Leaves are digests of the rows, made in the JVM and written once; only digests are shuffled. A range partitioning gives each leaf its
   place: the index in its run of one group in one partition, plus what earlier partitions hold of that group (one number a partition).
2. Up: blocks of ``FAN ** LEVELS`` consecutive nodes of a tree are reduced to one node each, a group of rows a block, so a group that holds
   a third of all rows is as many blocks as any other. Steps are repeated until at most ``TOP`` nodes are left. If the groups are
   more than that, steps go on until each is one node, and the subroots are reduced in the same way.
3. The driver builds the top tree of those nodes, and broadcasts for each the rest of its path (at most 24 MB at ``TOP``).
4. Down: a block's nodes take their siblings within the block and the path of the block's own node. The last step, over the leaves,
   makes each row's proof and folds it with the row's candidate leaf.

Defined results: nulls and empty texts are leaves like any other (null is ``-``); null groups and keys come first; rows with equal keys are ordered by
their leaves, so which of two equal rows comes first does not matter; a text that tampering leaves as it is stays verified; a null key is not
tampered; an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import near, small_batches, table, written
from tallgrove.llm.ngram_join import grouped

FAN, LEVELS, TOP = 16, 3, 4096
#: Rows up to which what a partition begins with is broadcast (16 bytes each).
FEW = 1_000_000
#: Rows with a proof that are handed to the JVM at once (about 5 KB each).
ROWS = 512
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PATH = "places array<int>, sizes array<int>, siblings string, subroot string"


def field(value: Column) -> Column:
    """A value's part of a leaf: ``-`` if null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """SHA-256 of a row's values, as lowercase hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


class Tree:
    """The levels over consecutive nodes (hex digests): ``levels`` of them, or up to one node if None."""

    def __init__(self, nodes: list[bytes], fan: int, levels: int | None) -> None:
        self.fan, self.runs, self.sizes = fan, [], []
        while (len(nodes) > 1) if levels is None else (len(self.runs) < levels):
            self.runs.append([b"".join(nodes[i : i + fan]) for i in range(0, len(nodes), fan)])
            nodes = [digest(r) for r in self.runs[-1]]
        self.top = nodes[0]

    def path(self, at: int) -> tuple[list[int], list[int], bytes]:
        """(place in the run, siblings in the run) a level, and all siblings of the node at ``at``, from its level upwards."""
        places, sizes, siblings = [], [], []
        for level in self.runs:
            at, k = divmod(at, self.fan)
            run = level[at]
            places.append(k)
            sizes.append(len(run) // 64 - 1)
            siblings += [run[: 64 * k], run[64 * k + 64 :]]
        return places, sizes, b"".join(siblings)


def folded(node: bytes, places: list[int], sizes: list[int], siblings: bytes) -> bytes:
    """The root that a node's proof leads to."""
    at = 0
    for k, n in zip(places, sizes):
        node = digest(b"".join((siblings[at : at + 64 * k], node, siblings[at + 64 * k : at + 64 * n])))
        at += 64 * n
    return node


def block_tree(nodes: list[bytes], block: int, fan: int, levels: int) -> Tree:
    """The tree of a block; a first block that is not full is its whole tree, which ends with one node."""
    return Tree(nodes, fan, None if block == 0 and len(nodes) < fan**levels else levels)


def hexed(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def placed(leaves: DataFrame, group: str, key: str) -> tuple[DataFrame, int]:
    """((tree, pos, leaf, key, candidate), number of groups): the number of each leaf's group among all groups, and its place there."""
    spark = leaves.sparkSession
    leaves = written(leaves.withColumn("row", F.monotonically_increasing_id()))  # the range partitioning samples it
    order = (F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), "leaf", "row")
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, i, last = -1, 0, None  # the run's number in the partition, rows of it so far, its group
        for b in it:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            new = np.concatenate([[True], code[1:] != code[:-1]])
            first = codes.dictionary[int(code[0])].as_py()
            new[0] = j < 0 or first != last
            run = j + np.cumsum(new)
            start = np.flatnonzero(new)
            begun = np.concatenate([[-i], start])[np.cumsum(new)]  # where the run of each row began
            at = np.arange(b.num_rows) - begun
            j, i, last = int(run[-1]), int(at[-1]) + 1, codes.dictionary[int(code[-1])].as_py()
            yield pa.record_batch([*b.columns, pa.array(run, pa.int64()), pa.array(at, pa.int64())], [*b.schema.names, "run", "at"])

    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    schema = f"grp {kinds[group]}, key {kinds[key]}, leaf binary, candidate binary, pid int, run long, at long"
    cut = written(dealt.select(F.col(group).alias("grp"), F.col(key).alias("key"), "leaf", "candidate", F.col("__pid").alias("pid")).mapInArrow(runs, schema))
    # one row a partition: how many groups it has, and the first and the last with their rows
    own = cut.groupBy("pid", "run").agg(F.first("grp").alias("grp"), F.count(F.lit(1)).alias("n"))
    one = F.struct("grp", "n")
    ends = own.groupBy("pid").agg(F.min_by(one, "run").alias("a"), F.max_by(one, "run").alias("z"), F.count(F.lit(1)).alias("runs")).orderBy("pid").collect()
    base, groups, last, rows = [], 0, object(), 0
    for e in ends:
        goes_on = groups > 0 and e.a.grp == last
        base.append((e.pid, groups - goes_on, rows if goes_on else 0))
        rows = e.z.n + (rows if goes_on and e.runs == 1 else 0)
        groups, last = groups + e.runs - goes_on, e.z.grp
    begins = near(spark.createDataFrame(base, "pid int, tree0 long, pos0 long"), FEW)
    pos = F.col("at") + F.when(F.col("run") == 0, F.col("pos0")).otherwise(0)
    return cut.join(begins, "pid").select((F.col("tree0") + F.col("run")).alias("tree"), pos.alias("pos"), "leaf", "key", "candidate"), groups


def by_block(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / block).cast("long")).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def reduced(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """(tree, pos, leaf): one node a block of (tree, pos, leaf)."""

    def up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for g in grouped(it, 2):
            tree, block = (g.column(i)[0].as_py() for i in range(2))
            out.append((tree, block, bytes.fromhex(block_tree(hexed(g.column(2)), block, fan, levels).top.decode())))
            if len(out) == 4096:
                yield pa.record_batch([pa.array(x) for x in zip(*out)], ["tree", "pos", "leaf"])
                out = []
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out)], ["tree", "pos", "leaf"])

    return written(by_block(nodes.select("tree", "pos", "leaf"), fan**levels).select("tree", "block", "leaf").mapInArrow(up, "tree long, pos long, leaf binary"))


def top_paths(rows: list, fan: int) -> tuple[dict, str]:
    """({(tree, pos): path}, root) of the top nodes, whose trees are in order."""
    trees: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.tree, r.pos)):
        trees.setdefault(r.tree, []).append(bytes(r.leaf).hex().encode())
    own = {t: Tree(nodes, fan, None) for t, nodes in trees.items()}
    upper = Tree([own[t].top for t in own], fan, None) if own else None
    paths = {}
    for n, (t, tree) in enumerate(own.items()):
        above = upper.path(n)
        for pos in range(len(trees[t])):
            paths[t, pos] = (*(x + y for x, y in zip(tree.path(pos), above)), tree.top)
    return paths, upper.top.decode() if upper else ""


def descended(nodes: DataFrame, paths, fan: int, levels: int, subroots: bool, root: str | None = None) -> DataFrame:
    """The path of each node from that of its block, which ``paths`` has: a broadcast {(tree, block): path} or a table (tree, pos, path).

    ``subroots``: whether the nodes are subroots. With ``root`` the nodes are leaves with candidates: (key, leaf, subroot, root, proof, folded_root).
    """
    leaves = root is not None
    given = nodes.select("tree", "pos", "leaf", *(["key", "candidate"] if leaves else []))
    shared = None if isinstance(paths, DataFrame) else paths
    if shared is None:
        below = paths.select("tree", (F.col("pos") * fan**levels).alias("pos"), F.struct("places", "sizes", "siblings", "subroot").alias("path"))
        given = given.withColumn("path", F.lit(None).cast(f"struct<{PATH.replace(' ', ':').replace(',:', ',')}>"))
        given = given.unionByName(below, allowMissingColumns=True)
    key = given.schema["key"].dataType.simpleString() if leaves else None

    def down(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(it, 2):
            tree, block = (g.column(i)[0].as_py() for i in range(2))
            if "path" in g.column_names:
                own = next(p for p in g.column("path").to_pylist() if p)
                above = own["places"], own["sizes"], own["siblings"].encode(), own["subroot"].encode()
                g = g.filter(g.column("leaf").is_valid())
            else:
                above = shared.value[tree, block]
            digests = hexed(g.column("leaf"))
            t = block_tree(digests, block, fan, levels)
            first = block * fan**levels
            for s in range(0, len(digests), ROWS):
                rows = range(s, min(s + ROWS, len(digests)))
                path = [[x + y for x, y in zip(t.path(i), above)] for i in rows]
                proof = [pa.array([p[0] for p in path], pa.list_(pa.int32())), pa.array([p[1] for p in path], pa.list_(pa.int32())), pa.array([p[2].decode() for p in path])]
                if not leaves:
                    sub = pa.array([(digests[i] if subroots else above[3]).decode() for i in rows])
                    yield pa.record_batch([pa.array([tree] * len(rows), pa.int64()), pa.array([first + i for i in rows], pa.int64()), *proof, sub], ["tree", "pos", "places", "sizes", "siblings", "subroot"])
                    continue
                one = g.slice(s, len(rows))
                ends = [folded(c.hex().encode() if c is not None else digests[i], *p).decode() for i, c, p in zip(rows, one.column("candidate").to_pylist(), path)]
                cols = [one.column("key").combine_chunks(), pa.array([digests[i].decode() for i in rows]), pa.array([above[3].decode()] * len(rows)), pa.array([root] * len(rows)), *proof, pa.array(ends)]
                yield pa.record_batch(cols, ["key", "leaf", "subroot", "root", "places", "sizes", "siblings", "folded_root"])

    schema = f"key {key}, leaf string, subroot string, root string, places array<int>, sizes array<int>, siblings string, folded_root string" if leaves else f"tree long, pos long, {PATH}"
    blocks = by_block(given, fan**levels)
    return blocks.select("tree", "block", *(c for c in blocks.columns if c not in ("tree", "block"))).mapInArrow(down, schema)


def manifest(leaves: DataFrame, group: str, key: str, fan: int = FAN, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """(key, leaf, subroot, root, places, sizes, siblings, folded_root) of leaves (group, key, leaf, candidate; digests as binary).

    The proof of a row is its ``siblings`` (hex digests, level by level, left to right), of each level their number and the row's own
    ``place`` among them. ``folded_root`` is where the candidate (null: the leaf itself) leads by that proof.
    """
    spark = leaves.sparkSession
    bottom, groups = placed(small_batches(leaves), group, key)
    nodes, climbed, upper = reduced(bottom, fan, levels), [], False
    while (n := nodes.count()) > top:
        subroots = not upper and n == groups
        if subroots:
            nodes, upper = nodes.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "leaf"), True
        climbed.append((nodes, subroots))
        nodes = reduced(nodes, fan, levels)
    found, root = top_paths(nodes.collect(), fan)
    paths = spark.sparkContext.broadcast(found)
    for nodes, subroots in reversed(climbed):
        paths = written(descended(nodes, paths, fan, levels, subroots))
        if subroots:
            paths = paths.withColumn("tree", F.col("pos")).withColumn("pos", F.lit(0).cast("long"))
    return descended(bottom, paths, fan, levels, False, root)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document, a fifth of which are tampered with."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    own = leaf(*map(F.col, FIELDS))
    other = leaf(*(lowered if c == "text" else F.col(c) for c in FIELDS))
    leaves = docs.select("source", "doc_id", F.unhex(own).alias("leaf"), F.when(struck, F.unhex(other)).alias("candidate"))
    rows = manifest(leaves, "source", "doc_id")
    return rows.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: The unsigned CRC-32 of a decimal number, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""


def _leaf_sql(text: str) -> str:
    one = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    return f"sha256({' || '.join(one(text if c == 'text' else c) for c in FIELDS)})"


SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other,
        dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_leaf_sql("text")}) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n
    FROM documents),
own(tree, lv, pos, node, n) AS (
    SELECT tree, 0::BIGINT, pos, leaf, n FROM leaves
    UNION ALL
    SELECT tree, lv + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM own WHERE n > 1 GROUP BY tree, lv, pos // 16, n),
subroots AS (SELECT tree, node AS subroot, lv AS depth FROM own WHERE n = 1),
upper(lv, pos, node, n) AS (
    SELECT 0::BIGINT, tree, subroot, (SELECT count(*) FROM subroots) FROM subroots
    UNION ALL
    SELECT lv + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM upper WHERE n > 1 GROUP BY lv, pos // 16, n),
root AS (SELECT node AS root FROM upper WHERE n = 1),
steps AS (
    SELECT a.tree, a.lv, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM own a JOIN own b ON a.tree = b.tree AND a.lv = b.lv AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY a.tree, a.lv, a.pos
    UNION ALL
    SELECT s.tree, s.depth + a.lv, NULL, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''),
        coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
    FROM subroots s JOIN upper a ON a.n > 1 AND a.pos = s.tree // (16 ** a.lv)::BIGINT JOIN upper b ON a.lv = b.lv AND a.pos // 16 = b.pos // 16
    GROUP BY s.tree, s.depth, a.lv, a.pos),
fold(p0, tree, lv, pos, node, proof) AS (
    SELECT pos, tree, 0::BIGINT, pos, coalesce(other, leaf), '' FROM leaves
    UNION ALL
    SELECT f.p0, f.tree, f.lv + 1, f.pos // 16, sha256(s.l || f.node || s.r), f.proof || s.l || s.r
    FROM fold f JOIN steps s ON s.tree = f.tree AND s.lv = f.lv AND coalesce(s.pos, f.pos) = f.pos),
ends AS (SELECT tree, p0 AS pos, arg_max(node, lv) AS folded_root, sha256(arg_max(proof, lv)) AS proof_sha256 FROM fold GROUP BY tree, p0)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (tree) CROSS JOIN root JOIN ends USING (tree, pos)
"""
