"""Quality rules [native]: document measures plus cross-document line frequency by host.

Lines are normalised (trimmed, white space collapsed, lower case) and hashed; for every host
(``source``) the number of different documents (different texts) that hold a line is counted.
A line in more than ``max(LEAST_DOCS, SHARE * documents of the host)`` of them is removed
from every document of the host, except from the text of the smallest doc_id that holds it
(and that text's exact copies), so no content vanishes altogether. A document is rejected if
the base rules fail, or if what is left has fewer than ``LEAST_WORDS`` words or less than
``LEAST_LEFT`` of its words.

Everything is built-in expressions. Only line hashes are shuffled; the texts stay where they
are while the removable lines are few enough to be broadcast (``MOST_BROADCAST``). The removable
lines of one host are at most its lines a document over ``SHARE``, however large it is.

Defined results: null or empty texts have no words and fail the base rules; a null source
is a host of its own; rows with equal doc_id are documents of their own, and equal texts count
once for a line; an empty table gives an empty table; texts are read whole; other columns pass through ``assess`` and the stage.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.llm.common import WHITE, free_name, table, written

SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
LEAST_DOCS, SHARE, LEAST_LEFT = 20, 0.05, 0.3
#: Removable lines of all hosts (16 bytes each) up to which they are broadcast; beyond it they are joined by host.
MOST_BROADCAST = 1_000_000
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_left", "n_lines_removed", "kept", "clean_text"]


def _split(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WHITE}]+"))


def _normal(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(SPACES)), f"[{WHITE}]+", " "))


def measured(df: DataFrame, text: str = "__t") -> DataFrame:
    """Adds the base measures of the non-null column ``text``; each step is a column so that nothing is computed twice."""
    t = F.col(text)
    df = df.withColumn("__w", F.transform(_split(t), lambda w: F.xxhash64(w)))
    at = lambda i: F.get(F.col("__w"), i)
    df = df.withColumn("n_words", F.size("__w").cast("long")).withColumn(
        "__h",
        F.when(F.size("__w") < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.slice("__w", F.lit(1), F.size("__w") - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *(at(i + k) for k in range(1, WINDOW))))
        ),
    )
    pair = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(pair)))
    other = lambda j: F.get(F.col("__s"), j)["h"]
    twice = F.filter("__s", lambda x, j: (F.when(j > 0, other(j - 1)) == x["h"]) | (other(j + 1) == x["h"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(starts, zero, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    without = lambda chars: F.length(F.translate(t, chars, ""))
    return (
        df.withColumn("word_chars", without(SPACES).cast("long"))
        .withColumn("n_symbols", (F.length(t) - without(SYMBOLS)).cast("long"))
        .withColumn("__l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
        .withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    )


def removable_lines(df: DataFrame) -> DataFrame:
    """For each host with any: ``__hot``, an array of (h = hash of a removed line, keep = hash of the text that keeps it)."""
    lines = F.array_distinct(F.transform(F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.xxhash64(_normal(x))))
    docs = df.select("__host", "__id", F.xxhash64("__t").alias("__x"), "__t")
    held = docs.select("__host", "__id", "__x", F.explode(lines).alias("h"))
    counts = held.groupBy("__host", "h").agg(F.count_distinct("__x").alias("n"), F.min(F.struct("__id", "__x")).alias("first"))
    hosts = df.groupBy("__host").agg(F.count(F.lit(1)).alias("docs"))
    common = counts.where(F.col("n") > LEAST_DOCS)
    hot = common.join(hosts.withColumnRenamed("__host", "__host2"), F.col("__host").eqNullSafe(F.col("__host2"))).where(F.col("n") > F.ceil(F.col("docs") * SHARE))
    return hot.groupBy(F.col("__host").alias("__hot_host")).agg(F.collect_list(F.struct("h", F.col("first")["__x"].alias("keep"))).alias("__hot"))


def assess(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_words_left, n_lines_removed, kept, clean_text.

    Columns of ``df`` with these names are replaced.
    """
    made = set(MADE)
    kept = [c for c in df.columns if c.lower() not in made]
    base = df.select(F.struct(*(df[c] for c in df.columns)).alias("__row"), F.coalesce(df[text], F.lit("")).alias("__t"), df[doc_id].alias("__id"), df[host].alias("__host"))
    m = measured(base).withColumn("__x", F.xxhash64("__t"))
    m = m.withColumn("__n", F.transform("__l", lambda x: F.struct(F.xxhash64(_normal(x)).alias("h"), F.size(_split(x)).alias("w"))))
    hot_lines = written(removable_lines(base))
    if (hot_lines.agg(F.sum(F.size("__hot"))).first()[0] or 0) <= MOST_BROADCAST:
        hot_lines = F.broadcast(hot_lines)
    m = m.join(hot_lines, F.col("__host").eqNullSafe(F.col("__hot_host")), "left")
    hot = lambda h: F.exists("__hot", lambda y: (y["h"] == h) & (y["keep"] != F.col("__x")))
    gone = F.when(F.col("__hot").isNull(), F.filter("__n", lambda x: F.lit(False))).otherwise(F.filter("__n", lambda x: hot(x["h"])))
    m = m.withColumn("__gone", gone)
    left = F.col("n_words") - F.aggregate("__gone", F.lit(0).cast("long"), lambda a, x: a + x["w"])
    m = m.withColumn("n_words_left", left).withColumn("n_lines_removed", F.size("__gone").cast("long"))
    m = m.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_left") >= LEAST_WORDS) & (F.col("n_words_left") >= LEAST_LEFT * F.col("n_words")))
    clean = F.array_join(F.filter(F.split(F.coalesce(F.col("__row")[text], F.lit("")), "\n"), lambda x: ~hot(F.xxhash64(_normal(x)))), "\n")
    m = m.withColumn("clean_text", F.when(F.col("n_lines_removed") == 0, F.col("__row")[text]).otherwise(clean))
    return m.select(*(F.col("__row")[c].alias(c) for c in kept), *MADE)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left", "n_lines_removed"]


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every whole text."""
    return assess(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(COLUMNS)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents without their removed lines; n_chars follows the text."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), "doc_id", "source", "text")
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    kept = free_name(docs, "kept")
    # written before it is filtered: a filter on the verdict would be pushed below the steps that it is built from, which then run twice
    done = written(assess(rows).select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns), F.col("kept").alias(kept)))
    return done.where(kept).drop(kept)


#: Everything up to the verdict, over a relation ``docs_in`` with doc_id, source and text.
ASSESS_SQL = r"""
docs as (select doc_id, source, coalesce(text, '') as t from docs_in),
w as (select doc_id, t, source, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from docs),
win as (select doc_id, i, w[i:i+4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
twice as (select doc_id, i, count(*) over (partition by doc_id, g) as c from win),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from twice where c > 1) group by doc_id),
line as (select doc_id, source, t, x, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as norm,
    len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as lw from (select doc_id, source, t, unnest(l) as x from w)),
freq as (select source, norm, count(distinct t) as n, arg_min(t, doc_id) as keep from line group by all),
host as (select source, count(*) as docs from docs group by source),
hot as (select f.source, norm, keep from freq f join host h on f.source is not distinct from h.source where n > 20 and n > ceil(docs * 0.05)),
gone as (select l.doc_id, count(*) as k, sum(lw) as words from line l join hot h on l.source is not distinct from h.source and l.norm = h.norm and l.t <> h.keep group by l.doc_id),
measures as (select w.doc_id, len(w.w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
    (len(w.w) - coalesce(g.words, 0))::bigint as n_words_left, coalesce(g.k, 0)::bigint as n_lines_removed
    from w left join covered c using (doc_id) left join gone g using (doc_id)),
verdict as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words_left >= 10 and n_words_left >= 0.3 * n_words as kept from measures)
"""
SQL = f"with docs_in as (select * from documents), {ASSESS_SQL} select {', '.join(COLUMNS)} from verdict"
