"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Sources in code point order (null last) weigh 1, 2, 3, 1, ...; they share the words of all
   documents by weight, but none gets more than ``MOST_EPOCHS`` times its own size; what is over
   is shared again by weight until none is above (one pass over sources sorted by
   size / weight, so no iteration).
2. A source's documents are shuffled by a hash and laid end to end; every ``BLOCK`` words are a block.
3. The schedule has a point for each block that a source needs. Slot t takes the point
   t * g mod N, N the least Fibonacci number that is large enough and g the one before (the golden-ratio lattice), and
   the point is mapped through the cumulative block counts to a source; slots of points past the last are left out. The lattice visits each
   point once, so every source gets exactly its slots, evenly spread.
4. Slots are ranked within their source (ranks of ranges of slots plus ranks inside a range, so
   no window holds a whole source); rank r is block r mod blocks in epoch r div blocks; slots and blocks are
   joined. A source's last slot is cut so that its words are its rounded target.
5. A document is taken in the slots that its blocks have; the stage hands the documents on in the order of these slots.

Defined results: null and empty texts have size 0, are taken 0 words and stay in the result;
equal hashes are ordered by doc_id and size; repeated rows are documents of their own; an empty
table gives an empty table. No document is taken more than ``MOST_EPOCHS`` times its size. Other columns are not read by
the mix and pass through the stage, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrove.llm.common import WHITE, free_name, near, row_hash, table, written

BLOCK, MOST_EPOCHS, SEED = 512, 3, ":mix"
#: Sources up to which their table (about 60 bytes each) is broadcast; beyond it Spark joins as it likes.
SMALL = 100_000
#: Documents up to which the stage broadcasts how often each is taken (12 bytes each).
FEW = 2_000_000
#: Ranges into which the slots of the schedule are cut for ranking.
RANGES = 4096


def sized(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    n = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{WHITE}]+")))
    return df.select("doc_id", F.col(source).alias("source"), n.cast("long").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """A row a source: idx, source_size, target, words (rounded target), blocks, slots, first (slots of the sources before it)."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("w", (F.col("idx") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MOST_EPOCHS)
    by = Window.orderBy(F.col("cap").cast("double") / F.col("w"), "idx")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(everything),
        "caps": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)),
    })
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  words times weights go beyond a long
    s = s.withColumn("full", wide("caps") * wide("w") + wide("cap") * wide("weights") <= wide("total") * wide("w"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))
    share = rest.cast("double") / F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share * F.col("w")))
    s = s.withColumn("words", F.least(F.round("target").cast("long"), F.col("cap")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    some = F.col("source_size") > 0
    s = s.withColumn("slots", F.when(some, F.expr("words div source_size") * F.col("blocks") + F.ceil(F.expr("words % source_size") / BLOCK)).otherwise(0).cast("long"))
    first = F.coalesce(F.sum("slots").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.withColumn("first", first).select("source", "idx", "source_size", "target", "words", "blocks", "slots", "first")


def lattice(n: int) -> tuple[int, int]:
    """(g, N): the golden-ratio lattice of n points or a few more."""
    g, size = 1, 1
    while size < n:
        g, size = size, g + size
    return g, size


def schedule(sources: DataFrame, n: int) -> DataFrame:
    """(slot, idx, epoch, block, take): the blocks in the order in which they are to be read, n of them."""
    g, size = lattice(n)
    back = pow(g, -1, size) if size > 1 else 0
    pieces = sources.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(4096).cast("long"))).alias("start"))
    pieces = pieces.repartition(max(1, min(n // 4096 + 1, 4 * sources.sparkSession.sparkContext.defaultParallelism)))
    points = pieces.select("*", F.explode(F.sequence("start", F.least(F.col("start") + 4095, F.col("slots") - 1))).alias("own"))
    point = F.col("first") + F.col("own")
    wide = size >= 1 << 31
    slot = ((point.cast("decimal(19,0)") * F.lit(back).cast("decimal(19,0)")) % F.lit(size).cast("decimal(38,0)")).cast("long") if wide else (point * F.lit(back).cast("long")) % F.lit(size).cast("long")
    length = max(RANGES, -(-size // RANGES))
    slots = points.withColumn("slot", slot).withColumn("range", F.expr(f"slot div {length}L"))
    counts = slots.groupBy("idx", "range").agg(F.count(F.lit(1)).alias("k"))
    ahead = counts.select("idx", "range", F.coalesce(F.sum("k").over(Window.partitionBy("idx").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = slots.withColumn("at", F.row_number().over(Window.partitionBy("idx", "range").orderBy("slot")))
    ranked = inside.join(ahead.hint("merge"), ["idx", "range"]).withColumn("rank", F.col("ahead") + F.col("at") - 1)
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks"))
    begun = F.expr("rank div blocks") * F.col("source_size") + F.col("block") * BLOCK
    take = F.least(F.lit(BLOCK).cast("long"), F.col("source_size") - F.col("block") * BLOCK, F.col("words") - begun)
    return ranked.select("slot", "idx", F.expr("rank div blocks").alias("epoch"), "block", take.alias("take"))


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of a size above 0 with ``at``, their place in their source's shuffled stream."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED)))
    docs = sizes.where("size > 0").join(sources.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2")))
    docs = docs.select("doc_id", "size", "idx", "source_size", "target", key.alias("key"), F.substring(key, 1, 3).alias("part"))
    parts = docs.groupBy("idx", "part").agg(F.sum("size").alias("k"))
    ahead = parts.select("idx", "part", F.coalesce(F.sum("k").over(Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.sum("size").over(Window.partitionBy("idx", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    return docs.withColumn("inside", inside).join(ahead.hint("merge"), ["idx", "part"]).withColumn("at", F.col("ahead") + F.col("inside") - F.col("size")).drop("key", "part", "inside", "ahead")


def mix(df: DataFrame, text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """(documents without words; segments of documents that each slot takes, in words; number of slots)."""
    spark = df.sparkSession
    sizes = written(sized(df, text, source))
    sources = written(targets(sizes))
    n_sources, n = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("slots"), F.lit(0))).first()
    near = F.broadcast(sources) if n_sources <= SMALL else sources
    docs = laid_out(sizes, near)
    segments = docs.withColumn("block", F.explode(F.sequence(F.expr(f"at div {BLOCK}L"), F.expr(f"(at + size - 1) div {BLOCK}L"))))
    begin = F.greatest(F.col("at") - F.col("block") * BLOCK, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK).cast("long"))
    segments = segments.select("doc_id", "size", "idx", "source_size", "target", "at", "block", begin.alias("begin"), end.alias("end"))
    slots = schedule(sources, n) if n else spark.createDataFrame([], "slot long, idx long, epoch long, block long, take long")
    # slots come from few rows by explode, so Spark takes them for small; they grow with the corpus and must not be broadcast
    joined = segments.join(slots.hint("merge"), ["idx", "block"], "left")
    taken = F.greatest(F.least(F.coalesce("take", F.lit(0)), F.col("end")) - F.col("begin"), F.lit(0))
    none = sizes.where("size = 0").join(near.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).select("doc_id", "size", "source_size", "target")
    return none, joined.withColumn("taken", taken), n


def taken_words(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_slots, first_slot, last_slot) for every row: the words taken, in how many slots, and the first and last of them."""
    none, segments, _ = mix(df, text, source)
    slot = F.when(F.col("taken") > 0, F.col("slot"))
    got = segments.groupBy("doc_id", "size", "idx", "source_size", "target", "at").agg(F.sum("taken").alias("taken"), F.count(slot).alias("n_slots"), F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"))
    nothing = none.withColumns({"taken": F.lit(0).cast("long"), "n_slots": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long"), "last_slot": F.lit(None).cast("long")})
    return got.drop("idx", "at").unionByName(nothing)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the slots of the schedule that take them."""
    return taken_words(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus in the order of the schedule: a document once for each epoch that takes any of its words, at the slot of the first of them; none not taken.

    The documents of a source are taken in stream order, so at most one a source is taken in part; it stays whole. Documents without
    words stay, once, anywhere. Equal rows are told apart by nothing and share their slots.
    """
    row, slot, own, slots = (free_name(docs, x) for x in ("row", "slot", "own", "slots"))
    docs_columns = docs.columns
    docs = docs.withColumn(row, row_hash(docs))
    none, segments, n = mix(docs.select(F.col(row).alias("doc_id"), "text", "source"))
    copies = segments.where("taken > 0").groupBy("doc_id", "idx", "at", "epoch").agg(F.min("slot").alias("slot")).select("doc_id", "slot")
    copies = copies.unionByName(none.select("doc_id", F.lit(None).cast("long").alias("slot")))
    taken = written(copies.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct(F.col("slot").alias(slot))).alias(slots)))
    if not docs.groupBy(row).count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates([row])
    placed = docs.join(near(taken, FEW), F.col(row) == F.col(own)).withColumn(slot, F.explode(slots)).withColumn(slot, F.col(slot)[slot])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.coalesce(F.floor(F.col(slot) * F.lit(parts / lattice(n)[1])), F.pmod(F.col(row), F.lit(parts))).cast("int")
    return placed.repartitionById(parts, F.least(part, F.lit(parts - 1))).sortWithinPartitions(slot, row).select(docs_columns)


SIZES_SQL = r"sizes as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents)"
MIX_SQL = r"""
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as idx from sizes group by source),
s1 as (select *, (idx - 1) % 3 + 1 as w, 3 * source_size as cap from s0),
s2 as (select *, (sum(source_size) over ())::bigint as total,
  coalesce(sum(cap) over (order by cap::double / w, idx rows between unbounded preceding and 1 preceding), 0)::bigint as caps,
  (sum(w) over (order by cap::double / w, idx rows between current row and unbounded following))::bigint as weights from s1),
s3 as (select *, caps * w + cap * weights <= total * w as filled from s2),
s4 as (select *, case when filled then cap::double else
  (total - coalesce(sum(cap) filter (filled) over (), 0))::double / (sum(w) filter (not filled) over ())::double * w end as target from s3),
s5 as (select *, least(round(target)::bigint, cap) as words from s4),
s6 as (select *, ceil(source_size / 512)::bigint as blocks, case when source_size > 0
  then (words // source_size) * ceil(source_size / 512)::bigint + ceil((words % source_size) / 512)::bigint else 0 end as slots from s5),
s7 as (select *, (coalesce(sum(slots) over (order by idx rows between unbounded preceding and 1 preceding), 0))::bigint as first from s6),
fibonacci as (select 1::bigint as g, 1::bigint as n union all select n, g + n from fibonacci where n < (select coalesce(sum(slots), 0) from s7)),
lattice as (select g, n from fibonacci order by n desc limit 1),
slot as (select slot, (slot * g) % n as point from (select n, g, unnest(range(n)) as slot from lattice)),
ranked as (select idx, slot, source_size, words, blocks, row_number() over (partition by idx order by slot) - 1 as rank
  from slot join s7 on point >= first and point < first + slots),
schedule as (select idx, slot, rank % blocks as block,
  least(512, source_size - rank % blocks * 512, words - (rank // blocks) * source_size - rank % blocks * 512) as take from ranked),
d as (select row_number() over () as row, doc_id, size, idx, source_size, target,
  (sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, 'null') || ':mix'), doc_id, size rows unbounded preceding) - size)::bigint as pos
  from sizes d join s7 on d.source is not distinct from s7.source),
part as (select row, slot, greatest(least(take, pos + size - block * 512) - greatest(pos - block * 512, 0), 0) as words
  from d join schedule using (idx) where size > 0 and block between pos // 512 and (pos + size - 1) // 512),
got as (select row, sum(words)::bigint as taken, count(*) as n_slots, min(slot) as first_slot, max(slot) as last_slot from part where words > 0 group by row),
mixed as (select doc_id, size, source_size, target, coalesce(taken, 0) as taken, coalesce(n_slots, 0) as n_slots, first_slot, last_slot from d left join got using (row))
"""
SQL = f"with recursive {SIZES_SQL}, {MIX_SQL} select doc_id, size, source_size, target, taken, n_slots, first_slot, last_slot from mixed"
