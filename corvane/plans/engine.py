"""The engine: index directories, search them, list what is indexed."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import embed
from corvane.chunk.chunker import chunk_files
from corvane.functions.text import embed_text, preprocess_query, query_terms
from corvane.operators import catalogue, maintenance, search
from corvane.schemas import INDEXED_FILES, POSTINGS
from corvane.session import cut, workers_can_import
from corvane.sources.tree import scan
from corvane.store import Store, now_ms, project_path

MODES = ("semantic", "keyword", "hybrid")
Progress = Callable[[str, int, int], None]
#: A store larger than this that counts no chunks is taken to be damaged.
SUSPICIOUS_BYTES = 1_000_000
#: Chunks that are embedded before they are committed, on average.
EMBED_ROUND = 100_000


@dataclass
class IndexResult:
    files: int = 0
    chunks: int = 0
    embedded: int = 0
    skipped: int = 0
    removed: int = 0
    errors: list[str] = field(default_factory=list)
    duration: int = 0


@dataclass(frozen=True)
class SearchResult:
    chunk_key: str
    file_path: str
    name: str
    kind: str
    signature: str
    snippet: str
    start_line: int
    end_line: int
    score: float


class once_a_percent:
    """Passes progress on when the phase or the whole percentage changes."""

    def __init__(self, to: Progress | None):
        self.to, self.last = to, ("", -1)

    def __call__(self, phase: str, current: int = 0, total: int = 0) -> None:
        now = (phase, 100 * current // total if total > 0 else -1)
        if self.to and (now != self.last or total <= 0):
            self.last = now
            self.to(phase, current, total)


class Engine:
    def __init__(self, spark: SparkSession, path: str | None = None, embedder: embed.Embedder | None = None, embedding_model: str = "", clock: Callable[[], int] = now_ms):
        workers_can_import(spark)
        self.spark, self.store, self.clock = spark, Store(spark, path or project_path(os.getcwd())), clock
        self.embedder, self.model = embedder or embed.hashing_embedder, embedding_model or (embed.HASHING_MODEL if embedder is None else "custom")
        self._verified = False

    # --- writing

    def _codebase(self, root: str) -> tuple[int, list[int], DataFrame]:
        """Id of the codebase of a root, made if there is none; ids of those whose root lies over or under it; the table with its time set to now."""
        rows = {r.root_path: r.asDict() for r in self.store.read("codebases").collect()}  # one row a codebase
        own = rows.setdefault(root, {"id": 1 + max((r["id"] for r in rows.values()), default=0), "root_path": root, "name": root.rsplit("/", 1)[-1]})
        own["indexed_at"] = self.clock()
        schema = self.store.read("codebases").schema
        nested = [r["id"] for p, r in rows.items() if p != root and (f"{p}/".startswith(f"{root}/") or f"{root}/".startswith(f"{p}/"))]
        return own["id"], nested, self.spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows.values()], schema)

    def index(self, directory: str, languages: list[str] | None = None, progress: Progress | None = None) -> IndexResult:
        """Bring a codebase up to date: only files whose content changed are chunked and embedded again; files no longer scanned go.

        With `languages`, files of other languages count as no longer scanned. A file that can't be chunked keeps what is stored of
        it, and is tried again next time. All tables change in one commit; then chunks without a vector are embedded in rounds, each
        committed, so that a run that dies loses one round, and the next one goes on where it stopped.
        """
        began, root, tell = time.monotonic(), os.path.abspath(directory), once_a_percent(progress)
        result = IndexResult()
        codebase_id, nested, codebases = self._codebase(root)
        tell("scan")
        scanned = cut(scan(self.spark, root, languages))
        result.errors += [r.error for r in scanned.where("error is not null").select("error").collect()]
        files = scanned.where("error is null").select(F.lit(codebase_id).cast("long").alias("codebase_id"), F.col("abs_path").alias("file_path"), F.col("hash").alias("file_hash"), "abs_path", "language", "hash", "content")
        state = self.store.read("indexed_files", codebase_id)
        todo = maintenance.changed(files, state)
        n_files = files.count()
        tell("hash", n_files, n_files)

        chunked = cut(chunk_files(todo))
        result.errors += [r.error for r in chunked.where("error is not null").select("error").collect()]
        done = chunked.where("ok").select(F.lit(codebase_id).cast("long").alias("codebase_id"), "file_path", "file_hash")
        rows = chunked.where("ok is null")
        counts = rows.groupBy("file_path").agg(F.count("*").cast("int").alias("chunk_count"))
        now = self.clock()
        new_files = done.join(counts, "file_path", "left").select("codebase_id", "file_path", "file_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(now).cast("long").alias("indexed_at"))
        result.files, result.chunks = done.count(), rows.count()
        result.skipped = n_files - todo.count()
        tell("chunk", result.files, result.files)

        removed = maintenance.gone(state, files)
        result.removed = removed.count()
        kept_files = maintenance.gone(state.join(removed.select("file_path"), "file_path", "left_anti"), done)
        all_files = cut(kept_files.select(*INDEXED_FILES.names).unionByName(new_files.select(*INDEXED_FILES.names)))

        # chunks without those of replaced and removed files; then upsert on the key, which is global. A key begins with its file's
        # path, so only codebases that are nested with this one can hold the same, and only their folders are read
        everything = self.store.read("chunks", codebase_id, *nested)
        out_of_date = done.select("codebase_id", "file_path").unionByName(removed.select("codebase_id", "file_path"))
        kept = everything.join(out_of_date, ["codebase_id", "file_path"], "left_anti")
        fresh = rows.select(F.lit(codebase_id).cast("long").alias("codebase_id"), "file_path", "chunk_key", "language", "kind", "name", "signature", "snippet", "start_line", "end_line", "file_hash", F.lit(now).cast("long").alias("indexed_at"), "seq")
        chunks = maintenance.upsert_chunks(kept, fresh, "seq")
        taken_from = [r.codebase_id for r in everything.where(F.col("codebase_id") != codebase_id).join(fresh.select("chunk_key"), "chunk_key", "left_semi").select("codebase_id").distinct().collect()]
        own = cut(chunks.where(F.col("codebase_id") == codebase_id))

        index = cut(search.postings(own).select(*POSTINGS.names))
        # sorted by term over the files and within them, so that a query reads the row groups of its terms
        by_term = index.repartitionByRange("term").sortWithinPartitions("term")
        parts: dict = {"indexed_files": {codebase_id: all_files}, "chunks": {codebase_id: own}, "postings": {codebase_id: by_term}, "field_stats": {codebase_id: search.field_stats(index, own)}}
        for other in taken_from:  # rows that moved to this codebase; the other's postings stay until it is indexed again
            parts["chunks"][other] = chunks.where(F.col("codebase_id") == other)
        self.store.commit(codebases, parts)
        result.embedded = self._embed(codebase_id, tell)
        tell("cleanup")
        tell("fts")
        result.duration = round(1000 * (time.monotonic() - began))
        return result

    def _embed(self, codebase_id: int, tell: Progress) -> int:
        """Embed a codebase's chunks that have no vector of this model, and commit them round by round."""
        own = self.store.read("chunks", codebase_id)
        text = embed_text(*map(F.col, ("file_path", "kind", "name", "signature", "snippet")))
        total = catalogue.stale(own, self.model).count()
        rounds, done = -(-total // EMBED_ROUND), 0
        if not rounds:
            tell("embed", 0, 0)
        for k in range(rounds):
            mine = catalogue.stale(own, self.model).where(F.pmod(F.xxhash64("chunk_key"), F.lit(rounds)) == k)
            vectors = cut(mine.select("chunk_key", embed.embedding(self.embedder, text).alias("embedding"), F.lit(self.model).alias("embedding_model")))
            self.store.commit(parts={"chunks": {codebase_id: maintenance.write_embeddings(own, vectors)}})
            done += vectors.count()
            tell("embed", done, total)
            own = self.store.read("chunks", codebase_id)
        return done

    def remove_codebase(self, directory: str) -> None:
        """Drop all that is stored of a codebase but its own row."""
        root = os.path.abspath(directory)
        ids = [r.id for r in self.store.read("codebases").where(F.col("root_path") == root).collect()]
        self.store.commit(parts={t: {i: None for i in ids} for t in ("chunks", "indexed_files", "postings", "field_stats")})

    # --- reading

    def _verify(self) -> None:
        if self._verified:
            return
        self._verified = True
        size = self.store.size()
        if size > SUSPICIOUS_BYTES and self.store.read("codebases").count():
            if not catalogue.total_chunks(self.store.read("indexed_files")).first()[0]:
                raise RuntimeError(f"the store holds {size / 1e6:.0f} MB but counts no indexed chunks; its pointer or tables may be damaged")

    def _keyword(self, terms: list[str], limit: int) -> DataFrame:
        """(codebase_id, chunk_key, score, rank): per codebase over its stored postings, then merged."""
        found = search.keyword_topk_stored(self.store.read("postings"), self.store.read("field_stats"), terms, limit)
        return found.select("codebase_id", "chunk_key", "score", "rank")

    def _semantic(self, query: str, limit: int) -> DataFrame:
        vector = self.embedder([query])[0]
        top = search.vector_topk(self.store.read("chunks").select("chunk_key", "embedding"), vector, limit).select("chunk_key", "score")
        return top.withColumn("rank", F.expr("row_number() over (order by score desc, chunk_key)"))  # of `limit` rows

    def search(self, query: str, limit: int = 5, threshold: float = 0.0, include_snippet: bool = False, mode: str = "semantic") -> list[SearchResult]:
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if limit < 1:
            raise ValueError("limit must be at least 1")
        self._verify()
        if mode == "semantic":
            top = self._semantic(query, limit)
        else:
            terms = query_terms(preprocess_query(query, "keywords"))
            if not terms:
                return []
            top = self._keyword(terms, limit).select("chunk_key", "score", "rank")
            if mode == "hybrid":
                fused = cut(search.rrf(top, self._semantic(query, limit), limit))
                top = fused.withColumn("rank", F.expr("row_number() over (order by score desc)"))
        top = search.over_threshold(top, threshold)
        rows = search.with_chunks(top, self.store.read("chunks"), include_snippet).orderBy("rank").collect()
        return [SearchResult(**{k: r[k] for k in SearchResult.__dataclass_fields__}) for r in rows]

    def list_files(self, directory: str | None = None) -> list[dict]:
        files = self.store.read("indexed_files")
        if directory is not None:
            files = files.join(self.store.read("codebases").where(F.col("root_path") == os.path.abspath(directory)).select(F.col("id").alias("codebase_id")), "codebase_id", "left_semi")
        return [r.asDict() for r in catalogue.list_files(files).collect()]

    def list_codebases(self) -> list[dict]:
        return [r.asDict() for r in catalogue.list_codebases(self.store.read("codebases"), self.store.read("indexed_files")).collect()]

    def close(self) -> None:
        """Nothing is held open; the session is the caller's."""
