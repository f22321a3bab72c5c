"""SimHash near-duplicates, token alignment and the hash tree, against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallgrove.llm import alignment, merkle, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None if n % 3 == 0 else f"s{n % 3}", None) for n, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


# ---- simhash ----


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(fps, bits=2):
    """{fingerprint: least index of its component} by all pairs."""
    own = sorted(set(fps))
    a = np.array(own, np.uint64)
    root = {f: f for f in own}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a) <= bits)):
        if i < j:
            x, y = find(own[i]), find(own[j])
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in own}


def test_simhash_whole_table(spark, sf):
    from tallgrove.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    root = plain_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op12_simhash"](spark, sf).collect()}
    assert got == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}


def near_family(r, n, bits, free=64):
    """Fingerprints on walks of at most ``bits`` flips within the lowest ``free`` bits."""
    out, f = set(), r.getrandbits(64)
    while len(out) < n:
        out.add(f)
        g = r.choice(sorted(out)) if len(out) < 50 else f
        for _ in range(r.randint(1, bits)):
            g ^= 1 << r.randrange(free)
        f = g
    return out


@pytest.mark.parametrize("large", [simhash.LARGE, 8])
def test_simhash_links_every_close_pair(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)  # few fingerprints make a bucket hot: it is split again
    r = random.Random(3)
    fps = {0, 1, 3, (1 << 64) - 1, (1 << 64) - 4, 1 << 63}
    for free in (64, 26, 13):
        fps |= near_family(r, 150, 2, free) | near_family(r, 150, 3, free)
    fps |= {r.getrandbits(64) for _ in range(300)}
    rows = [(n, simhash.signed(f)) for n, f in enumerate(sorted(fps))]
    got = {r.fp & (1 << 64) - 1: r.component_id for r in simhash.near_fingerprints(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    root = plain_components(fps)
    number = {f: n for n, f in enumerate(sorted(fps))}
    assert got == {f: number[root[f]] for f in fps}  # roots are least fingerprints, and so have the least numbers


def test_simhash_every_pair_of_flips_meets():
    masks = simhash.choices((1 << 64) - 1, 2)
    assert len(masks) == 10 and {bin(m).count("1") for m in masks} <= {38, 39}
    for i in range(64):
        for j in range(i, 64):
            diff = 1 << i | 1 << j
            assert any(diff & m == 0 for m in masks)
            hit = next(m for m in masks if diff & m == 0)
            assert any(diff & (hit | sub) == 0 for sub in simhash.choices(((1 << 64) - 1) ^ hit, 2))
    assert min(bin(m | s).count("1") for m in masks for s in simhash.choices(((1 << 64) - 1) ^ m, 2)) >= 64 - 11


def test_simhash_cases(spark):
    texts = [None, "", " \t\n", "One", "one", "a b", "a b c", "A B C", "a b c d", "x " * 200_000, "ÄB ÄB äb", "äb ÄB"]
    ids = [7, 3, 9, 5, 5, None, 11, 10, 12, 13, 14, 15]
    df = frame(spark, texts, ids).withColumn("FP", F.lit(1)).withColumn("component_id", F.lit(1))
    got = [(r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert Counter((i, f) for i, f, _ in got) == Counter((i, plain_fingerprint(t)) for i, t in zip(ids, texts))
    of = {(i, f): c for i, f, c in got}
    assert of[7, 0] == of[3, 0] == of[9, 0] == 3 and of[11, plain_fingerprint("a b c")] == 10 and of[None, plain_fingerprint("a b")] is None
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.majority(("word%d " * 70_000 % tuple(range(70_000))).encode()) & (1 << 64) - 1 == plain_fingerprint("word%d " * 70_000 % tuple(range(70_000)))


# ---- alignment ----


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as vocab

    with open(vocab.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(vocab.path("piece_bpe_32k.model"), "rb") as g:
        return alignment.Tokenizers(f.read(), g.read())


def plain_encoded(t, text):
    """(A ids, B ids) of a whole text, encoded at once."""
    if not text:
        return [], []
    a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
    raw = (" " + text).encode()
    return (a, b) if b"".join(t.bytes_a[i] for i in a) == raw == b"".join(t.bytes_b[i] for i in b) else ([], [])


def plain_groups(t, a, b):
    groups, i, j, x, y = [], 0, 0, 0, 0
    own = ([], [])
    while i < len(a) or j < len(b):
        if x <= y:
            own[0].append(a[i])
            x += len(t.bytes_a[a[i]])
            i += 1
        else:
            own[1].append(b[j])
            y += len(t.bytes_b[b[j]])
            j += 1
        if x == y:
            groups.append(own)
            own = ([], [])
    return groups


def plain_rows(t, docs):
    """{doc_id: row} by the contract, links written out."""
    groups = {i: plain_groups(t, *plain_encoded(t, x)) for i, x in docs}
    links = {i: [(a, b) for xs, ys in g for a in xs for b in ys] for i, g in groups.items()}
    count = Counter(p for own in links.values() for p in set(own))
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    out = {}
    for i, g in groups.items():
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        own = links[i]
        out[i] = (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(own), sum(count[p] == highest[p[0]] for p in own),
            sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if g else "",
        )
    return out


def rows_of(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_alignment_whole_table(spark, sf, tokenizers, monkeypatch):
    from tallgrove.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_rows(tokenizers, docs)
    assert rows_of(QUERIES["op11_token_alignment"](spark, sf)) == want
    monkeypatch.setattr(alignment, "BATCH", 100_000)  # many batches, windows and steps
    monkeypatch.setattr(alignment, "WINDOW", 61)
    monkeypatch.setattr(alignment, "STEP", 100)
    assert rows_of(QUERIES["op11_token_alignment"](spark, sf)) == want


def test_alignment_parts_encode_as_whole_texts(tokenizers):
    r = random.Random(11)
    alphabet = [" ", " ", "  ", "a", "B", "ß", "é", "中", "日本", "😀", "'s", "'", "\n", "\t", "\x00", "\x1c", "\x85", "\xa0", " ", "　", "▁", "1", "23", ".", "...", "<|endoftext|>", "<s>", "<0x41>", "the", " the", "ing", "́", "﻿"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    got = tokenizers.encode(texts)
    wrong = [t for t, (a, b) in zip(texts, got) if (a.tolist(), b.tolist()) != tuple(map(list, plain_encoded(tokenizers, t)))]
    assert not wrong


def test_alignment_cases(spark, tokenizers):
    texts = [None, "", " ", "a", "▁ is a piece", "word\x00 end ", "中文字" * 3000, "x" * 5000 + " " * 777 + "\n" * 99, "same text here", "same text here", "<|endoftext|> <unk> </s>", "né" * 400]
    df = frame(spark, texts).withColumn("N_A", F.lit(1)).withColumn("batch", F.lit("x"))
    rows = alignment.written(alignment.alignments(df, *_paths()))
    got = {r.doc_id: r for r in alignment.counted(rows, len(tokenizers.size_b)).collect()}
    want = plain_rows(tokenizers, list(enumerate(texts)))
    assert {i: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for i, r in got.items()} == {i: w[:6] for i, w in want.items()}
    assert {i: hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for i, r in got.items()} == {i: w[6] for i, w in want.items()}
    assert got[4].n_a == 0 and got[8].n_best > 0
    empty = alignment.written(alignment.alignments(frame(spark, []), *_paths()))
    assert alignment.counted(empty, 10).count() == 0
    twice = alignment.written(alignment.alignments(frame(spark, ["one two", "one two", "three"], [4, 4, None]), *_paths()))
    assert sorted((r.doc_id or -1, r.n_links, r.count_sum) for r in alignment.counted(twice, 32_000).collect())[1:] == [(4, 2, 4), (4, 2, 4)]


def _paths():
    import public_tokenizers as vocab

    return vocab.path("byte_bpe_50k.json"), vocab.path("piece_bpe_32k.model")


def test_groups_of_very_many_pairs(monkeypatch):
    monkeypatch.setattr(alignment, "STEP", 64)
    r = np.random.default_rng(5)
    a, b = r.integers(0, 30, 300), r.integers(0, 20, 260)
    to_a, to_b = np.array([1, 41, 42, 200, 300]), np.array([2, 3, 103, 104, 260])
    want = Counter()
    for s, e, u, v in zip([0, *to_a], to_a, [0, *to_b], to_b):
        want.update(int(x) * 20 + int(y) for x in a[s:e] for y in b[u:v])
    codes, times = alignment.linked(a, b, to_a, to_b, 20)
    assert dict(zip(codes.tolist(), times.tolist())) == want
    big = np.array([3, 5 << 33, 6 << 33])
    assert (alignment.unpacked(alignment.packed(big)) == big).all() and len(alignment.unpacked(alignment.packed(big[:0]))) == 0


# ---- hash tree ----


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(d, text):
    values = (d.doc_id, d.source, d.lang, d.n_chars, text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(docs, fan=16):
    """[(doc_id, leaf, subroot, root, proof, folded)] by plain recursion."""

    def climb(nodes):
        levels = []
        while len(nodes) > 1:
            levels.append(nodes)
            nodes = [H(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
        return levels, nodes[0]

    def siblings(levels, at):
        out = []
        for nodes in levels:
            start = at // fan * fan
            out.append((nodes[start:at], nodes[at + 1 : start + fan]))
            at //= fan
        return out

    groups = {}
    for d in docs:
        groups.setdefault(d.source, []).append((d.doc_id is not None, d.doc_id or 0, plain_leaf(d, d.text), d))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in groups[s]])
    upper, root = climb([trees[s][1] for s in order])
    out = []
    for n, s in enumerate(order):
        for at, (_, _, leaf, d) in enumerate(groups[s]):
            path = siblings(trees[s][0], at) + siblings(upper, n)
            hit = d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 5 == 0
            node = plain_leaf(d, re.sub("[A-Z]", lambda m: m[0].lower(), d.text) if hit and d.text is not None else d.text)
            for left, right in path:
                node = H(*left, node, *right)
            out.append((d.doc_id, leaf, trees[s][1], root, H(*(x for l, r in path for x in l + r)), node))
    return sorted(out, key=str)


def rows_of_tree(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect()), key=str)


def query_on(spark, tmp_path, docs, name="a"):
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return merkle.op13_merkle_manifest(spark, f"{tmp_path}/{name}")


def test_manifest_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = merkle.op13_merkle_manifest(spark, sf)
    assert rows_of_tree(got) == plain_manifest(docs)
    assert all(r.verified == (r.folded_root == r.root) for r in got.collect())
    assert {r.verified for r in got.collect()} == {True, False}


@pytest.mark.parametrize("fan,levels,top", [(2, 1, 2), (2, 2, 5), (3, 1, 1), (16, 3, 4096)])
def test_manifest_over_many_steps(spark, fan, levels, top):
    """Distributed steps over leaves and over subroots: many groups, one with a third of the rows."""
    r = random.Random(fan)
    docs = [(i, f"g{r.randrange(12)}" if i % 3 else None, f"Text {i}") for i in range(120)] + [(1000, "lone", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("n_chars")).repartition(5)
    leaves = df.select("source", "doc_id", F.unhex(merkle.leaf(*map(F.col, merkle.FIELDS))).alias("leaf"), F.lit(None).cast("binary").alias("candidate"))
    got = merkle.manifest(leaves, "source", "doc_id", fan, levels, top).collect()
    want = plain_manifest(df.collect(), fan)
    assert sorted(((x.key, x.leaf, x.subroot, x.root, H(x.siblings)) for x in got), key=str) == sorted((w[:5] for w in want), key=str)
    assert all(x.folded_root == x.root and len(x.places) == len(x.sizes) and 64 * sum(x.sizes) == len(x.siblings) for x in got)


def test_manifest_of_lone_leaves_only(spark):
    """More groups than the driver takes, each a lone leaf."""
    df = spark.createDataFrame([(i, f"{i:03d}", "x", None, None) for i in range(70)], "doc_id long, source string, text string, lang string, n_chars long")
    leaves = df.select("source", "doc_id", F.unhex(merkle.leaf(*map(F.col, merkle.FIELDS))).alias("leaf"), F.lit(None).cast("binary").alias("candidate"))
    got = merkle.manifest(leaves, "source", "doc_id", 2, 2, 3).collect()
    assert sorted(((x.key, x.leaf, x.subroot, x.root, H(x.siblings)) for x in got), key=str) == sorted((w[:5] for w in plain_manifest(df.collect(), 2)), key=str)


def test_manifest_cases(spark, tmp_path):
    rows = [(i, t, la, s, n) for i, t, la, s, n in [
        (None, None, None, None, None), (None, "A", None, None, 1), (3, "", "", "", 0), (3, "", "", "", 0), (3, "B", "en", "", 5), (4, "Ünicode ABC", "de", "ü", 11),
        (-7, "neg", None, "z", None), (5, "LONG " * 400_000, None, "z", 2), (20, None, "x", "Z", None), (25, "X", "x", "Z", None)]]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.withColumn("leaf", F.lit(1)).withColumn("row", F.lit(2)).withColumn("__PID", F.lit(3))
    assert rows_of_tree(query_on(spark, tmp_path, wide)) == plain_manifest(df.collect())
    assert query_on(spark, tmp_path, df.limit(0), "none").count() == 0
    lone = query_on(spark, tmp_path, df.where("doc_id = 4"), "lone").collect()
    assert len(lone) == 1 and lone[0].leaf == lone[0].root == lone[0].subroot and lone[0].proof_sha256 == H()
