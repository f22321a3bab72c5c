"""Document fingerprints [native]: consistent weighted sampling over weighted words.

A term is a word, its weight the number of times it occurs. For each of ``SAMPLES`` samples k
and each term, one 64-bit hash of (term, k) gives r and c from Gamma(2, 1) and b from the unit
interval; with t = floor(ln w / r + b) the term's value is  ln c - r (t - b + 1)  and the least
value over the terms is the sample. Two texts have the same sample with a probability that equals
the generalised Jaccard similarity of their weighted terms, so the share of equal
samples estimates it. A Gamma(2, 1) variate is -ln(u v) of two unit variates, which are bits of the hash.

A sample is kept as 32 bits; a fingerprint is their hex digits. Equal texts have equal
fingerprints. Texts without words have an empty fingerprint; two of those are alike (1), one
and another text are not (0).

The next document of a document (descending doc_id) is found without a global sort: ids are
cut at approximate quantiles into ranges of about ``RANGE_DOCS`` documents, however the ids are spread, and the rows of an id that has very many by the hashes of their texts;
past ``RANGES`` quantiles each range is cut evenly once more, into as many pieces as bring it down to that size;
every range also gets a copy of the first document of the next one
that has any, and a window inside the range does the rest. The texts move once.

Defined results: null texts are empty; rows with equal doc_id follow each other in the order of
their texts' hashes; a null id sorts after all others; an empty table gives an empty table; a
single document is its own next one; texts are used whole; other columns are not read, whatever their names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrove.llm.common import WHITE, table

SAMPLES, RANGE_DOCS, RANGES = 32, 2000, 10_000
#: Most pieces of the range of one id.
SUBS = 1 << 20


def samples(df: DataFrame, term: str, log_weight: str, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """Groups by ``keys``; column ``cws`` is the array of the least values. ``term`` is a hash, ``log_weight`` ln of its weight."""
    def value(k: int) -> Column:
        h = F.xxhash64(F.col(term), F.lit(k))

        def unit(shift: int, width: int = 13) -> Column:
            return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1)) + 0.5) * F.lit(1.0 / (1 << width))

        r = -F.log(unit(0) * unit(13))
        b = unit(52, 12)
        return F.log(-F.log(unit(26) * unit(39))) - r * (F.floor(F.col(log_weight) / r + b) - b + 1.0)

    return df.groupBy(*keys).agg(*(F.min(value(k)).alias(f"__m{k}") for k in range(n)))


def hexed(least: list[Column]) -> Column:
    """32 bits of each least value as eight hex digits; empty if there is none."""
    digits = F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0") for x in least))
    return F.when(least[0].isNull(), "").otherwise(digits)


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    equal = F.lit(0)
    for k in range(n):
        equal = equal + (F.substring(a, 8 * k + 1, 8) == F.substring(b, 8 * k + 1, 8)).cast("int")
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / F.lit(float(n)))


def terms(text: Column) -> Column:
    """Sorted hashes of all words of a text."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    hashes = F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, f"[{WHITE}]+"), lambda w: F.xxhash64(w)))
    return F.sort_array(hashes)


def runs(hashes: str) -> Column:
    """Where each run of equal values of a sorted array column starts."""
    a = F.col(hashes)
    return F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) != x), i)), lambda i: i.isNotNull())


def fingerprinted(df: DataFrame, texts: dict[str, str], keys: list[str]) -> DataFrame:
    """Adds a fingerprint column for each of ``texts`` (new column: text column, not null).

    ``keys`` tell rows apart; if ``df`` is dealt out by some of them, nothing is shuffled.
    """
    kept = [c for c in df.columns if c not in texts.values()]
    df = df.select(*kept, F.explode(F.array(*(F.struct(F.lit(i).alias("which"), terms(F.col(c)).alias("a")) for i, c in enumerate(texts.values())))).alias("__e"))
    df = df.select(*kept, F.col("__e.which").alias("__which"), F.col("__e.a").alias("__a"))
    df = df.withColumn("__s", runs("__a")).withColumn("__n", F.size("__a"))
    pair = F.transform("__s", lambda s, j: F.struct(F.get(F.col("__a"), s).alias("h"), F.log((F.coalesce(F.get(F.col("__s"), j + 1), F.col("__n")) - s).cast("double")).alias("w")))
    one = df.select(*kept, "__which", F.explode_outer(pair).alias("__t")).select(*kept, "__which", F.col("__t.h").alias("__h"), F.col("__t.w").alias("__w"))
    least = samples(one, "__h", "__w", [*kept, "__which"])
    # a text without words has one row with a null weight, whose values are null
    prints = least.select(*kept, "__which", hexed([F.col(f"__m{k}") for k in range(SAMPLES)]).alias("__f"))
    rest = [c for c in kept if c not in keys]
    out = prints.groupBy(*keys).agg(*(F.first(c).alias(c) for c in rest), *(F.max(F.when(F.col("__which") == i, F.col("__f"))).alias(c) for i, c in enumerate(texts)))
    return out


def _range(x: Column, bounds: list[int]) -> Column:
    """Number of bounds up to x, by two steps: about the square root of all bounds is looked at, twice."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda v: "array(" + ",".join(f"{i}L" for i in v) + ")"
    if not groups:
        return F.lit(0)
    group = F.size(F.filter(F.expr(array(g[0] for g in groups)), lambda b: b <= x)) - 1
    inner = F.get(F.expr("array(" + ",".join(map(array, groups)) + ")"), group)
    return F.coalesce(group * step + F.size(F.filter(inner, lambda b: b <= x)), F.lit(0))


def _piece(x: Column, bounds: list[int], top: int, pieces: int) -> Column:
    """Which of ``pieces`` even pieces of its range x lies in; ``bounds`` begin with the least id, ``top`` is the greatest."""
    ends = F.expr("array(" + ",".join(f"{i}L" for i in [*bounds, top]) + ")")
    at = _range(x, bounds)
    low, high = F.get(ends, at - 1).cast("double"), F.get(ends, at).cast("double")
    share = F.try_divide(x.cast("double") - low, high - low)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * pieces), F.lit(pieces - 1)).cast("long")


def with_next(df: DataFrame) -> DataFrame:
    """Rows of (doc_id, __t text, __x hash of it) plus __range and __ghost: 1 for a copy of the first row of the following range and, at the end, of all.

    Rows follow each other by descending __range, inside it by descending doc_id (null last), then __x.
    """
    spark = df.sparkSession
    low, top, n = df.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    ranges = min(RANGES, n // RANGE_DOCS)
    at = [i / ranges for i in range(1, ranges)]
    bounds = (df.agg(F.percentile_approx("doc_id", at, 10 * RANGES)).first()[0] if at else None) or []
    # an id of very many rows gets a range of its own, which is cut by the hashes of its texts; at most RANGES such ids
    most = max(2 * RANGE_DOCS, n // RANGES)
    hot = {r.doc_id: r.k for r in df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most).collect()}
    own = {i + k for i in hot if i is not None for k in (0, 1) if i + k < 1 << 63}
    bounds = sorted({*bounds, *own, *([low] if low is not None else [])})
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_range(F.col("doc_id"), bounds) + 1).cast("long") * SUBS
    even = min(SUBS, -(-n // (RANGE_DOCS * RANGES)))
    if even > 1 and bounds:  # more documents than the quantiles bring down to RANGE_DOCS a range
        part = part + F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_piece(F.col("doc_id"), bounds, top, even))
    if hot:
        pieces = spark.createDataFrame([(i, min(SUBS, -(-k // RANGE_DOCS))) for i, k in hot.items()], "hot long, pieces long")
        df = df.join(F.broadcast(pieces), F.col("doc_id").eqNullSafe(F.col("hot")) & F.col("pieces").isNotNull(), "left")
        piece = F.least(F.floor((F.col("__x") / 2.0**64 + 0.5) * F.col("pieces")), F.col("pieces") - 1)
        part = part + F.coalesce(F.col("pieces") - 1 - piece, F.lit(0))
    docs = df.withColumn("__range", part).select("doc_id", "__t", "__x", "__range")
    # of each range the place of its first row (no texts), and the range that needs it
    heads = docs.groupBy("__range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("id"), F.col("__x").alias("x"))).alias("head"))
    order = Window.orderBy(F.col("__range").desc())
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    needed = heads.select(F.col("__range").alias("for"), F.coalesce(F.lead("head").over(order), first).alias("head"))
    needed = needed.select("for", F.bitwise_not("head.id").alias("id"), F.col("head.x").alias("x"))
    needed = F.broadcast(needed) if n // RANGE_DOCS < 200_000 else needed
    first_of = docs.join(needed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("__x") == F.col("x")))
    ghosts = first_of.groupBy(F.col("for").alias("__range")).agg(F.first("doc_id").alias("doc_id"), F.first("__t").alias("__t"), F.first("__x").alias("__x"))
    return docs.withColumn("__ghost", F.lit(0)).unionByName(ghosts.withColumn("__ghost", F.lit(1)))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("__t")).withColumn("__x", F.xxhash64("__t"))
    rows = with_next(docs)
    order = Window.partitionBy("__range").orderBy("__ghost", F.col("doc_id").desc_nulls_last(), "__x")
    rows = rows.withColumns({"__rank": F.row_number().over(order), "__next": F.lead("__t").over(order)})
    half = F.expr("length(__t) div 2")
    edited = F.concat(F.expr("substring(__t, 1, length(__t) - length(__t) div 2)"), F.expr("substring(coalesce(__next, ''), 1, length(__t) div 2)"))
    rows = rows.select("__range", "__rank", "__ghost", "doc_id", "__t", F.length("__t").cast("long").alias("n_chars"), F.when(half == 0, F.col("__t")).otherwise(edited).alias("__e"))
    rows = rows.withColumn("edited_sha256", F.sha2("__e", 256))
    done = fingerprinted(rows, {"fingerprint": "__t", "edited_fingerprint": "__e"}, ["__range", "__rank"])
    done = done.withColumn("__next", F.lead("fingerprint").over(Window.partitionBy("__range").orderBy("__rank"))).where("__ghost = 0")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__next")).alias("near_next"))
