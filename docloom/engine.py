"""The engine: search, file details, removal, ingest, jobs and flush over a store."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom import schemas
from docloom.functions import domains
from docloom.functions.classify import classify
from docloom.functions.enhance import enhance
from docloom.functions.text import query_terms
from docloom.operators import jobs, learning, recommend, retrieval, statistics
from docloom.schemas import ChunkingConfig, EngineError, FileError, SearchOptions
from docloom.sources import files
from docloom.sources.embedding import Embedder, HashingEmbedder, embed_query
from docloom.sources.session import ship
from docloom.sources.store import Store, insert_missing
from docloom.streaming.streams import ingest_batch

log = logging.getLogger("docloom")
#: How long a vocabulary and a query's intent are kept, and how many intents.
VOCABULARY_SECONDS, INTENT_SECONDS, MOST_INTENTS = 300, 24 * 3600, 1000
STRATEGY_TEXT = {"removal": "Leave out terms that say little", "refinement": "Use a more telling term", "contextual_addition": "Add terms of the best results"}


class Engine:
    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None):
        ship(spark)
        self.spark, self.store, self.embedder = spark, Store(spark, f"{root}/tables"), embedder or HashingEmbedder()
        self.folders = files.make_folders(Path(root))
        if not self.store.exists("domain_vocabulary"):
            self.store.write("domain_vocabulary", insert_missing(self.store.read("domain_vocabulary"), domains.seed(spark), ["domain"]))
        self._vocabulary: tuple[float, domains.Vocabulary] | None = None
        self._intents: dict[str, tuple[float, Row]] = {}
        self._listeners: dict[str | None, list[Callable[[dict], None]]] = {}

    # ---- search

    def vocabulary(self) -> domains.Vocabulary:
        """The vocabulary, read again when it is older than VOCABULARY_SECONDS or was changed here."""
        if self._vocabulary is None or time.time() - self._vocabulary[0] > VOCABULARY_SECONDS:
            self._vocabulary = time.time(), domains.load(self.store.read("domain_vocabulary"))
        return self._vocabulary[1]

    def add_vocabulary(self, rows: DataFrame) -> None:
        self.store.upsert("domain_vocabulary", rows, ["domain"])
        self._vocabulary = None
        self._intents.clear()

    def intent(self, query: str) -> DataFrame:
        one = self.spark.createDataFrame([(query,)], "query string")
        return domains.query_intent(one, vocabulary=self.vocabulary()).withColumn("expires_at", F.current_timestamp() + F.expr("interval 24 hours"))

    def _intent(self, query: str) -> Row:
        """A query's intent, kept for INTENT_SECONDS; the MOST_INTENTS last ones are."""
        held = self._intents.pop(query, None)
        if held is None or time.time() - held[0] > INTENT_SECONDS:
            held = time.time(), self.intent(query).first()
        self._intents[query] = held
        while len(self._intents) > MOST_INTENTS:
            self._intents.pop(next(iter(self._intents)))
        return held[1]

    def search(self, query: str, options: SearchOptions | None = None) -> DataFrame:
        """Hits: chunk columns without vector, score, rank and metadata. One plan, run when it is asked for."""
        o = options or SearchOptions()
        intent = self._intent(query)
        found = intent["detected_domains"]
        chunks, meta = self.store.read("chunks"), self.store.read("content_metadata")
        if o.prefilter:
            cond = retrieval.metadata_predicate(o)
            if cond is not None:
                chunks = chunks.join(retrieval.latest(meta, ["chunk_id"], "created_at").where(cond).select("chunk_id"), "chunk_id", "left_semi")
        near = retrieval.knn(chunks.select("chunk_id", "embedding"), embed_query(query, self.embedder), o.limit or 10, o.mode).drop("embedding")
        # only ids and vectors are ranked; the texts of the hits, as many as the limit, are fetched afterwards
        hits = chunks.drop("embedding").join(F.broadcast(near), "chunk_id")
        hits = retrieval.with_score_at_least(hits, o.min_score) if o.mode == "similarity" or o.strict else hits
        hits = retrieval.join_metadata(hits, meta.drop("raw_content", "processed_content", "file_extension"))
        from pyspark.sql import Window

        first = F.desc("score") if o.mode == "similarity" else F.asc("score")
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(first, "chunk_id")))  # as many rows as the limit
        if found and (o.mode == "similarity" or o.strict):
            known = F.array(*[F.struct(F.lit(d["domain"]).alias("domain"), F.lit(d["confidence"]).alias("confidence"), F.array(*[F.lit(k) for k in d["matched_keywords"]]).cast("array<string>").alias("matched_keywords"), F.lit(d["boost_factor"]).alias("boost_factor")) for d in found])
            hits = retrieval.boost(hits, known)
        return retrieval.apply_filters(hits, o).orderBy("rank")

    def search_documents(self, query: str, options: SearchOptions | None = None, shown: int = 10) -> dict:
        """The answer to one search as plain values: hits, average, recommendation, next steps, warning about running jobs."""
        began = time.time()
        try:
            rows = retrieval.previews(self.search(query, options)).collect()  # at most the limit
        except Exception as e:
            log.exception("search failed")
            return {"query": query, "results": [], "total_results": 0, "average_score": 0.0, "error": str(e), "search_time_ms": int((time.time() - began) * 1000)}
        scores = [r["score"] for r in rows]
        average = sum(scores) / len(scores) if scores else 0.0
        terms = self.spark.range(1).select(query_terms(F.lit(query)).alias("t")).first()["t"]
        params = self.store.learning_parameters().first()
        rec = None
        if len(rows) < 3 or average < params["current_tfidf_threshold"] or len(terms) > 5:
            hit = recommend.cached(self.store.read("search_recommendations").where(F.col("query") == query), F.current_timestamp()).first()
            rec = hit.asDict() if hit else self.recommend(query, rows, params["current_tfidf_threshold"])
        steps = []
        if rec:
            steps.append(f"search_documents({' '.join(rec['suggested_terms'])!r})")
        if rows:
            steps.append(f"get_file_details({rows[0]['file_path']!r}, {rows[0]['chunk_index']})")
        if len(rows) > 1:
            steps += [f"get_file_details({p!r})" for p in list(dict.fromkeys(r["file_path"] for r in rows))[:3]]
        running = self.active_jobs().count()
        return {
            "query": query, "results": [r.asDict(True) for r in rows[:shown]], "total_results": len(rows), "average_score": average, "recommendation": rec,
            "recommendation_text": f"{STRATEGY_TEXT.get(rec['suggestion_strategy'], '')}: {' '.join(rec['suggested_terms'])} ({rec['confidence'] * 100:.0f} %)" if rec else None,
            "next_steps": steps, "warning": f"{running} jobs are running; results may be incomplete" if running else None, "search_time_ms": int((time.time() - began) * 1000), "options": asdict(options or SearchOptions()),
        }

    def recommend(self, query: str, rows: list[Row], threshold: float) -> dict | None:
        """A recommendation from a search's hits, stored and returned; None if there is none."""
        q = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        r = self.spark.createDataFrame([(0, i + 1, x["content"]) for i, x in enumerate(rows[: recommend.MAX_DOCS])], "query_id int, rank int, content string")
        total = self.store.read("documents_idx").count()
        found = recommend.recommend(q, r, total, threshold).drop("query_id").first()
        if found is None:
            return None
        self.store.store_recommendations(self.spark.createDataFrame([found.asDict()], schemas.struct(schemas.RECOMMENDATIONS)))
        return recommend.cached(self.store.read("search_recommendations").where(F.col("query") == query), F.current_timestamp()).first().asDict()

    def feedback(self, recommendation_id: str, was_used: bool, score: float, original_count: int, improved_results: bool | None = None, improved_count: int | None = None) -> learning.Params:
        """Records how well a recommendation worked and learns from it; returns the parameters that hold from now on."""
        self.store.record_effectiveness(recommendation_id, was_used, score, original_count, improved_results, improved_count, datetime.now(UTC))
        rec = self.store.read("search_recommendations").where(F.col("id") == recommendation_id).select("suggestion_strategy").first()
        p = learning.update(self.store.current_parameters(), float(score), rec["suggestion_strategy"] if rec else None)
        self.store.update_learning_parameters(p)
        return p

    def reset_learning(self) -> None:
        self.store.update_learning_parameters(learning.Params.reset())

    def file_details(self, path: str, chunk_index: int | None = None, context_size: int = 3) -> DataFrame:
        """A file's chunks, or those around one; with a preview of 500 characters."""
        rows = retrieval.file_chunks(self.store.read("chunks"), path)
        if chunk_index is not None:
            want = self.spark.createDataFrame([(path, chunk_index)], "file_path string, chunk_index int")
            rows = retrieval.context_window(rows, want, context_size).drop("target_index", "target_position")
        return retrieval.previews(rows.withColumn("score", F.lit(0.0)), 500).drop("score", "score_text").orderBy("chunk_index")

    # ---- changes

    def remove_file(self, path: str) -> int:
        return self.store.delete_file(path)

    def subscribe(self, listener: Callable[[dict], None], job_id: str | None = None) -> Callable[[], None]:
        """Calls listener with each event of a job, or of all; a job's last event is told at once. Returns what ends it."""
        if job_id is not None:
            last = jobs.latest_progress(self.store.read("job_events").where(F.col("job_id") == job_id)).first()
            if last is not None:
                listener(last.asDict())
        self._listeners.setdefault(job_id, []).append(listener)
        return lambda: self._listeners[job_id].remove(listener) if listener in self._listeners[job_id] else None

    def _event(self, job: str, kind: str, status: str, progress: float, message: str = "") -> None:
        at = datetime.now(UTC)
        row = self.spark.createDataFrame([(job, kind, status, float(progress), message, at)], schemas.JOB_EVENTS)
        self.store.append("job_events", row)
        shown = 100.0 if status == "completed" else 0.0 if status == "failed" else max(0.0, min(100.0, float(progress)))
        for listener in [*self._listeners.get(job, []), *self._listeners.get(None, [])]:
            try:
                listener({"job_id": job, "progress": shown, "message": message, "ts": at})
            except Exception:
                log.exception("a listener failed")

    def _process(self, found: DataFrame, kind: str, tell, config: ChunkingConfig | None, enrich: bool) -> int:
        """Files read (files.read_files) into the index: chunked, embedded, stored, described. Raises if nothing comes of it."""
        found = found.persist()
        try:
            if not found.where("status = 'ok'").take(1):
                said = found.select("status").distinct().limit(5).collect()
                raise FileError("no readable text: " + (", ".join(sorted(r["status"] for r in said)) or "no files"))
            tell(jobs.stage_progress(kind, "process", "chunk", 1.0), "read")
            n = ingest_batch(found.where("status = 'ok'"), self.store, config, self.embedder)
            if not n:
                raise FileError("no chunks")
            tell(jobs.stage_progress(kind, "process", "store", 1.0), "stored")
            if enrich:
                self.enrich(found.where("status = 'ok'").select("file_path"))
            return n
        finally:
            found.unpersist()

    def _run(self, kind: str, work) -> str:
        job = f"job_{uuid.uuid4().hex}"
        self._event(job, kind, "running", 0)
        try:
            n = work(lambda p, m: self._event(job, kind, "running", p, m))
            self._event(job, kind, "completed", 100, f"{n} chunks")
        except Exception as e:
            log.exception("job failed")
            self._event(job, kind, "failed", 0, str(e)[:500])
        return job

    def ingest_path(self, path: str, config: ChunkingConfig | None = None, enrich: bool = True) -> str:
        return self._run("file_download", lambda tell: self._process(files.read_files(self.spark, path), "file", tell, config, enrich))

    def ingest_file(self, url: str, filename: str, overwrite: bool = True, max_mb: int = 1024, config: ChunkingConfig | None = None, enrich: bool = True) -> str:
        def work(tell) -> int:
            path = files.download(url, filename, str(self.folders["fetched"]), overwrite, max_mb)
            tell(jobs.stage_progress("file", "land", "", 1.0), "downloaded")
            return self._process(files.read_files(self.spark, path), "file", tell, config, enrich)

        return self._run("file_download", work)

    def ingest_repo(self, source: str, branch: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, config: ChunkingConfig | None = None, enrich: bool = True) -> str:
        """A repository by address or folder, packed into one markdown document and ingested."""
        def work(tell) -> int:
            import shutil

            folder = source if Path(source).is_dir() else files.clone_repository(source, branch)
            try:
                name = self.spark.range(1).select(F.lit(source)).first()[0].rstrip("/").split("/")[-1].removesuffix(".git")
                target = files.write_pack(files.pack_repository(self.spark, folder, include, exclude), str(self.folders["repositories"] / f"{files.safe_filename(name)}.md"))
            finally:
                if folder != source:
                    shutil.rmtree(folder, ignore_errors=True)
            tell(jobs.stage_progress("repo", "land", "", 1.0), "packed")
            return self._process(files.read_files(self.spark, target), "repo", tell, config, enrich)

        return self._run("repo_download", work)

    def enriched(self, docs: DataFrame) -> DataFrame:
        """docs (file_path, file_extension, content) classified, enhanced and tagged on the enhanced text."""
        tagged = enhance(classify(docs))
        return domains.tag(tagged, content="enhanced_content", vocabulary=self.vocabulary())

    def enrich(self, paths: DataFrame) -> None:
        """Metadata rows for the chunks of the given files."""
        mine = self.store.read("chunks").join(paths.select("file_path").distinct(), "file_path", "left_semi").select("chunk_id", "file_path", "content")
        from docloom.functions.text import extension

        rich = self.enriched(mine.withColumn("file_extension", extension(F.col("file_path"))))
        rows = rich.select("chunk_id", "content_type", "language", "domain_tags", "quality_score", F.col("authority_score").alias("source_authority"), F.col("enhanced_content").alias("processed_content"), F.lit(None).cast("string").alias("raw_content"), "file_extension", "has_comments", "has_documentation", F.current_timestamp().alias("created_at"))
        self.store.upsert("content_metadata", rows, ["chunk_id"])

    # ---- jobs

    def job_states(self) -> DataFrame:
        return jobs.state(self.store.read("job_events"))

    def job_status(self, job_id: str) -> dict | None:
        r = self.job_states().where(F.col("job_id") == job_id).first()
        return r.asDict() if r else None

    def active_jobs(self) -> DataFrame:
        return jobs.active(self.job_states())

    def job_stats(self) -> DataFrame:
        return jobs.statistics(self.job_states())

    def index_statistics(self) -> dict:
        size = self.store.size()
        return statistics.index_statistics(self.store.read("documents_idx")).first().asDict() | {"size_bytes": size, "model": self.embedder.name}

    def flush_all(self) -> list[dict]:
        """Clears chunks, documents, metadata, recommendations, effectiveness and fetched files, and fails running jobs; the
        learning parameters and the vocabulary stay. Returns what each step did."""
        import shutil

        report = []
        for name in ("chunks", "documents_idx", "content_metadata", "search_recommendations", "recommendation_effectiveness"):
            try:
                report.append({"step": name, "ok": True, "rows": self.store.clear(name)})
            except Exception as e:
                report.append({"step": name, "ok": False, "error": str(e)})
        for name, folder in self.folders.items():
            n = sum(1 for p in folder.rglob("*") if p.is_file())
            shutil.rmtree(folder, ignore_errors=True)
            folder.mkdir(parents=True, exist_ok=True)
            report.append({"step": name, "ok": True, "files": n})
        states = self.active_jobs().select("job_id", "type").persist()
        n = states.count()
        if n:
            rows = states.select("job_id", "type", F.lit("failed").alias("status"), F.lit(0.0).alias("progress"), F.lit("Job cancelled by user").alias("message"), F.current_timestamp().alias("ts"))
            self.store.append("job_events", rows)
        states.unpersist()
        return [*report, {"step": "jobs", "ok": True, "rows": n}]

    def cancel_job(self, job_id: str) -> bool:
        s = self.job_status(job_id)
        if s is None:
            raise EngineError(f"no job {job_id}")
        if s["status"] != "running":
            return False
        self._event(job_id, s["type"], "failed", s["progress"], "Job cancelled by user")
        return True
