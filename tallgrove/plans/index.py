"""The API: build an index as versioned Parquet tables, search it, assemble, answer and verify, with injected models.

Models are Columns made by the caller, e.g. Arrow UDFs: ``embed(text)``, ``rerank(query, text)``,
``llm(prompt)``. ``hashed_embed`` is a built-in stand-in without a model.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrove.functions import models
from tallgrove.functions import text as T
from tallgrove.functions import vectors as V
from tallgrove.operators import chunking, context, enrichment, incremental, postings, records, search, verification
from tallgrove.sources.store import Store, kept

Embed = Callable[[Column], Column]

MANIFEST = "name string, mtime timestamp, size long"


def hashed_embed(dim: int = 64) -> Embed:
    """Normalised counts of hashed words, as one expression over a text."""

    def embed(text: Column) -> Column:
        slot = F.transform(T.tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
        return V.normalized(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double")))

    return embed


class Index:
    """Versions of an index below ``path``; each names segments of chunks, vectors and postings, what of them was deleted, and a manifest.

    A change writes a segment of its own rows and commits it with one rename (``sources.store``): readers see the version before or the one after.
    Chunks that are there already are not added again, so an append that is repeated, or retried after it died, adds nothing twice.
    Deleting a document writes its name with a segment number; rows of earlier segments are left out when they are read, until ``compact``.
    """

    def __init__(self, spark: SparkSession, path: str, embed: Embed, model: str = "hashed", buckets: int = postings.BUCKETS) -> None:
        self.spark, self.path, self.embed, self.model, self.buckets = spark, path.rstrip("/"), embed, model, buckets
        self.store = Store(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, embedders: dict[str, Embed]) -> Index:
        """An index that is there, with the embedder that its configuration names; ValueError if that is not among ``embedders``."""
        config = Store(spark, path).entry().get("config")
        if config is None:
            raise ValueError(f"there is no index at {path}")
        if config["model"] not in embedders:
            raise ValueError(f"the index was built with {config['model']!r}; there are {', '.join(sorted(embedders))}")
        return cls(spark, path, embedders[config["model"]], config["model"])

    # -- reading --

    def _live(self, entry: dict) -> Callable[[DataFrame], DataFrame]:
        """Drops rows (doc_name, seg) of documents that were deleted after their segment."""
        gone = self.store.read([f"{s['path']}/deleted" for s in entry.get("segments", []) if s["deleted"]])
        if gone is None:
            return lambda d: d
        gone = search.near(gone.groupBy(F.col("doc_name").alias("__doc")).agg(F.max("seg").alias("__seg")))
        return lambda d: d.join(gone, (F.col("doc_name") == F.col("__doc")) & (F.col("seg") < F.col("__seg")), "left_anti")

    def _rows(self, entry: dict, name: str) -> DataFrame | None:
        """Rows of a table of all segments, deleted ones left out; with their segment."""
        found = postings.united(self.spark, [f"{self.path}/{s['path']}/{name}" for s in entry.get("segments", []) if s["added"]])
        return found if found is None else self._live(entry)(found)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """``chunks``, ``vectors`` (chunk_id, embedding), ``config`` or ``manifest`` of a version, the last one by default."""
        entry = self.store.entry(version)
        if name == "manifest":
            return self.store.read([entry["manifest"]]) if entry.get("manifest") else self.spark.createDataFrame([], MANIFEST)
        if not entry.get("config"):
            raise ValueError(f"there is no index at {self.path}")
        if name == "config":
            return self.spark.createDataFrame([(self.size(entry), entry["config"]["model"], "cosine")], "num_chunks long, model string, similarity string")
        rows = self._rows(entry, name)
        if rows is None:
            return self.spark.createDataFrame([], f"{chunking.CHUNK}" if name == "chunks" else "chunk_id string, embedding array<double>")
        return rows.drop("seg") if name == "chunks" else rows.select("chunk_id", "embedding")

    @staticmethod
    def size(entry: dict) -> int:
        """Number of chunks of a version."""
        return sum(s["chunks"] for s in entry.get("segments", []))

    def lexical(self, queries: DataFrame, k: int | str | None) -> DataFrame:
        """(qid, rank, chunk_id, score): BM25 by the index's postings; no text is read. With k None all scores, without ranks; k may be a column as in ``postings.bm25``."""
        entry = self.store.entry()
        segments = entry.get("segments", [])
        at = lambda name, which: postings.united(self.spark, [f"{self.path}/{s['path']}/{name}" for s in segments if s[which]])
        n, length = self.size(entry), sum(s["tokens"] for s in segments)
        if not n:
            kind = queries.schema["qid"].dataType.simpleString()
            return self.spark.createDataFrame([], f"qid {kind}, {'rank int, ' if isinstance(k, int) else ''}chunk_id string, score double")
        buckets = entry["config"]["buckets"]
        return postings.bm25(at("postings", "added"), at("terms", "changed"), at("dfs", "changed"), n, length, queries, "chunk_id", k, buckets, self._live(entry))

    def check_model(self) -> None:
        config = self.store.entry().get("config")
        if config is None:
            raise ValueError(f"there is no index at {self.path}")
        if config["model"] != self.model:
            raise ValueError("the index was built with another embedding model")

    def manifest(self) -> DataFrame:
        """(name, mtime, size) of the documents that are in the index; empty where nothing was remembered yet."""
        return self.table("manifest")

    def stats(self) -> DataFrame:
        return records.index_stats(self.table("chunks"))

    # -- writing --

    def _commit(self, base: dict, segments: list[dict], config: dict, manifest: str | None) -> int:
        return self.store.commit({"config": config, "segments": segments, "manifest": manifest}, base["version"])

    def _segment(self, entry: dict, rows: DataFrame | None, gone: DataFrame | None, buckets: int, vectors: DataFrame | None = None) -> dict | None:
        """Writes a segment with chunk rows to be added and names (doc_name) of documents to be deleted; None if it would change nothing.

        ``vectors`` (chunk_id, doc_name, embedding) are taken as they are; without them the rows just written are embedded.
        """
        spark, segments = self.spark, entry.get("segments", [])
        folder, seg = self.store.folder(), max((s["seg"] for s in segments), default=0) + 1
        at = f"{self.path}/{folder}"
        done = {"path": folder, "seg": seg, "chunks": 0, "tokens": 0, "added": False, "deleted": False, "changed": False}
        changes = []
        old = self._rows(entry, "chunks") if gone is not None else None
        if old is not None:
            gone = kept(gone.select("doc_name").distinct())
            dead = kept(old.join(search.near(gone), "doc_name", "left_semi").select("chunk_id", "doc_name", "seg", "text"))  # what is deleted, no more
            n = dead.count()
            if n:
                gone.withColumn("seg", F.lit(seg)).write.parquet(f"{at}/deleted")
                lost = kept(postings.postings(dead, "chunk_id", "doc_name"))
                changes.append(postings.term_counts(lost, buckets, -1))
                done |= {"deleted": True, "chunks": -n, "tokens": -(lost.agg(F.sum("tf")).first()[0] or 0)}
        if rows is not None:
            rows.drop("seg").withColumn("seg", F.lit(seg)).write.parquet(f"{at}/chunks")
            rows = spark.read.parquet(f"{at}/chunks")  # what follows is made from the chunks just written, so that pages are cut only once
            n = rows.count()
            if n:
                if vectors is None:
                    source = T.embedding_source(F.col("embedding_text"), F.col("text")) if "embedding_text" in rows.columns else F.col("text")
                    vectors = rows.select("chunk_id", "doc_name", self.embed(source).alias("embedding"))
                vectors.withColumn("seg", F.lit(seg)).write.parquet(f"{at}/vectors")
                postings.write_postings(postings.postings(rows, "chunk_id", "doc_name"), f"{at}/postings", "chunk_id", n, buckets)
                made = spark.read.parquet(f"{at}/postings")
                changes.append(postings.term_counts(made, buckets))
                tokens = made.agg(F.sum("tf")).first()[0] or 0
                done |= {"added": True, "chunks": done["chunks"] + n, "tokens": done["tokens"] + tokens}
        if not done["added"] and not done["deleted"]:
            return None
        change = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
        before = postings.united(spark, [f"{self.path}/{s['path']}/terms" for s in segments if s["changed"]])
        postings.write_statistics(change, before, at)
        return done | {"changed": True}

    def _chunks(self, pages: DataFrame, size: int, overlap: int, enrich: Callable[[Column], Column] | None) -> DataFrame:
        c = chunking.chunks(pages, size, overlap)
        return enrichment.enriched(c, enrich) if enrich else c

    def _fresh(self, entry: dict, chunks: DataFrame) -> DataFrame:
        """Chunks whose ids are not in the index yet, each once."""
        have = self._rows(entry, "chunks")
        chunks = chunks.dropDuplicates(["chunk_id"])
        return chunks if have is None else chunks.join(have.select("chunk_id"), "chunk_id", "left_anti")

    def build(self, pages: DataFrame, size: int = 800, overlap: int = 200, mode: str = "overwrite", enrich: Callable[[Column], Column] | None = None) -> None:
        """Chunks pages (doc_name, page, text) and commits chunks, vectors and postings; ``mode`` append adds chunks that are not there yet.

        With ``enrich``, a model's reply to an enrichment prompt, chunks get a summary, questions and the text that is embedded in place of theirs.
        """
        entry = self.store.entry()
        config = {"model": self.model, "similarity": "cosine", "size": size, "overlap": overlap, "buckets": self.buckets}
        chunks = self._chunks(pages, size, overlap, enrich)
        if mode == "append":
            self.check_model()
            new = self._segment(entry, self._fresh(entry, chunks), None, entry["config"]["buckets"])
            if new:
                self._commit(entry, [*entry["segments"], new], entry["config"], entry.get("manifest"))
            return
        new = self._segment({}, chunks.dropDuplicates(["chunk_id"]), None, self.buckets)
        self._commit(entry, [new] if new else [], config, None)

    def update(self, pages: DataFrame, current: DataFrame, size: int = 800, overlap: int = 200, enrich: Callable[[Column], Column] | None = None) -> str:
        """Brings the index to the documents (name, mtime, size) in ``current`` with one commit: ``built``, ``appended``, ``updated`` or ``unchanged``.

        New and modified documents are cut and embedded; of modified and deleted ones the old rows are marked as deleted. Nothing else is written.
        """
        entry = self.store.entry()
        changes = kept(incremental.changes(current, self.manifest()).where("change <> 'unchanged'"))
        kinds = {r["change"] for r in changes.groupBy("change").count().collect()}
        if not kinds and entry.get("config"):
            return "unchanged"
        if entry.get("config"):
            self.check_model()
        config = entry.get("config") or {"model": self.model, "similarity": "cosine", "size": size, "overlap": overlap, "buckets": self.buckets}
        named = lambda *k: changes.where(F.col("change").isin(*k)).select(F.col("name").alias("doc_name"))
        gone = named("modified", "deleted") if kinds & {"modified", "deleted"} else None
        chunks = None
        if kinds & {"new", "modified"}:
            chunks = self._chunks(pages.join(search.near(named("new", "modified")), "doc_name", "left_semi"), config["size"], config["overlap"], enrich)
            # rows of modified documents are replaced; those of a new one that are there already (the manifest was lost) stay as they are
            have = self._rows(entry, "chunks")
            have = have if have is None or gone is None else have.join(search.near(gone), "doc_name", "left_anti")
            chunks = chunks.dropDuplicates(["chunk_id"]) if have is None else chunks.dropDuplicates(["chunk_id"]).join(have.select("chunk_id"), "chunk_id", "left_anti")
        new = self._segment(entry, chunks, gone, config["buckets"])
        segments = [*entry.get("segments", []), *([new] if new else [])]
        self._commit(entry, segments, config, self._remembered(current))
        return "built" if not entry.get("segments") else "updated" if gone is not None else "appended"

    def _remembered(self, current: DataFrame) -> str:
        folder = f"{self.store.folder()}/manifest"
        current.select("name", "mtime", "size").write.parquet(f"{self.path}/{folder}")
        return folder

    def remember(self, current: DataFrame) -> None:
        """Commits a manifest alone."""
        entry = self.store.entry()
        self._commit(entry, entry.get("segments", []), entry.get("config"), self._remembered(current))

    def compact(self) -> None:
        """Commits one segment with the rows that are not deleted, in place of all; texts are neither cut nor embedded again."""
        entry = self.store.entry()
        rows, vectors = self._rows(entry, "chunks"), self._rows(entry, "vectors")
        new = self._segment({}, rows, None, entry["config"]["buckets"], vectors.drop("seg")) if rows is not None else None
        self._commit(entry, [new] if new else [], entry["config"], entry.get("manifest"))

    # -- searching --

    def query_vectors(self, queries: DataFrame, hyde: Callable[[Column], Column] | None = None) -> DataFrame:
        """(qid, q) of queries (qid, text)."""
        vectors = queries.select("qid", self.embed(F.col("text")).alias("q"), *([hyde(F.col("text")).alias("__h")] if hyde else []))
        if hyde:
            both = V.normalized(V.mean_of(F.col("q"), self.embed(F.coalesce("__h", F.lit("")))))
            vectors = vectors.select("qid", F.when((F.coalesce("__h", F.lit("")) == "") | models.failed(F.col("__h")), F.col("q")).otherwise(both).alias("q"))
        return vectors

    def search(self, queries: DataFrame, top_k: int = 5, rerank: Callable[[Column, Column], Column] | None = None, hyde: Callable[[Column], Column] | None = None) -> DataFrame:
        """(qid, rank, score, similarity, chunk_id, doc_name, page, section, text[, rerank_score]) of all queries (qid, text) at once.

        With ``hyde``, a model that writes a passage which would answer the query, the vector searched for is the mean of both; a failed or
        empty passage leaves the query's own. An index of another embedding model is an error.
        """
        self.check_model()
        k = search.over_fetch(top_k, max(self.size(self.store.entry()), 1), rerank is not None)
        hits = search.fused(search.dense(self.table("vectors"), self.query_vectors(queries, hyde), "chunk_id", k), self.lexical(queries, k), "chunk_id", k)
        found = self._described(hits)
        if rerank:
            found = found.join(queries.select("qid", F.col("text").alias("__q")), "qid")
            found = search.reranked(found, rerank(F.col("__q"), F.col("text")), top_k, "chunk_id").drop("__q")
        return found

    def _described(self, hits: DataFrame) -> DataFrame:
        return self.table("chunks").select("chunk_id", "doc_name", "page", "section", "text").join(search.near(hits), "chunk_id")

    def search_by_document(self, queries: DataFrame, doc: str, top_k: int = 5) -> DataFrame:
        """The best chunks of one document among the hits of a search with a budget that grows with the document's rarity; may be fewer than top_k.

        The places of its chunks in the dense, the lexical and the fused list are counted; the budget's other hits are never fetched.
        """
        self.check_model()
        members = self.table("chunks").select("chunk_id", F.col("doc_name").alias("doc"))
        own, n = members.where(F.col("doc") == doc).count(), self.size(self.store.entry())
        budget = max(1, min(n, max(3 * top_k, int(top_k / (own / n))))) if own else 1
        budgets = queries.select("qid").distinct().withColumn("doc", F.lit(doc)).withColumn("budget", F.lit(budget).cast("long"))
        own_budget = lambda d: d.withColumn("budget", F.lit(budget).cast("long"))
        dense = search.dense(self.table("vectors"), own_budget(self.query_vectors(queries)), "chunk_id", "budget")
        return self._described(search.scoped_fused(dense, self.lexical(own_budget(queries), "budget"), budgets, members.where(F.col("doc") == doc), "chunk_id", top_k, kept))

    def answer(self, queries: DataFrame, llm: Callable[[Column], Column], top_k: int = 5, rerank: Callable[[Column, Column], Column] | None = None, budget: int = context.BUDGET, verifier: Callable[[Column], Column] | None = None) -> DataFrame:
        """(qid, query, context, answer, mismatches, confidence): retrieve, resolve cross references, assemble, answer, check values.

        ``verifier`` replies to a verification prompt; without one no claim is checked, and the confidence is n/a, or low with a value that no source has.
        """
        hits = self.search(queries, top_k, rerank)
        full = context.with_referenced(hits.select("qid", "chunk_id", "doc_name", "page", "section", "text"), self.table("chunks"))
        a = context.assembled(full, budget=budget).join(queries.select("qid", F.col("text").alias("query")), "qid")
        a = a.withColumn("answer", llm(F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "query")))
        return checked_answers(a, full, verifier).select("qid", "query", "context", "answer", "mismatches", "confidence")


def checked_answers(answers: DataFrame, chunks: DataFrame, verifier: Callable[[Column], Column] | None) -> DataFrame:
    """Adds mismatches and confidence to answers (qid, answer, context); with a verifier the answer is the verified one."""
    if verifier is None:
        bad = T.value_mismatches(F.col("answer"), F.col("context"))
        return answers.withColumn("mismatches", bad).withColumn("confidence", F.when(F.size("mismatches") > 0, "low").otherwise("n/a"))
    sources = chunks.groupBy("qid").agg(F.collect_list(F.struct("chunk_id", "doc_name", "page", "text")).alias("__c"))
    a = answers.join(sources, "qid", "left")
    a = a.withColumn("__v", verification.verified(F.col("answer"), F.col("__c"), verifier(verification.prompt(F.col("answer"), F.col("__c")))))
    return a.withColumn("answer", F.col("__v.verified_answer")).withColumn("mismatches", F.col("__v.mismatches")).withColumn("confidence", F.col("__v.confidence")).drop("__v", "__c")
