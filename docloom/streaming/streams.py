"""Streams: files into the index, jobs' states, feedback into parameters."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docloom.functions.chunking import chunk
from docloom.functions.text import extension, post_process
from docloom.operators.jobs import FINAL
from docloom.operators.learning import Params, update
from docloom.schemas import ChunkingConfig, JOB_EVENTS
from docloom.sources.embedding import Embedder, embed
from docloom.sources.store import Store

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, as they appear."""
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    p = F.regexp_replace("path", "^file:(//)?", "")
    return raw.select(p.alias("file_path"), F.col("modificationTime").alias("last_modified"), post_process(F.decode("content", "UTF-8"), extension(p)).alias("content"))


def ingest_batch(files: DataFrame, store: Store, config: ChunkingConfig | None = None, embedder: Embedder | None = None) -> int:
    """Cleaned files (file_path, content) chunked, embedded and stored in place of their older chunks."""
    rows = embed(chunk(files, config), embedder=embedder).withColumn("created_at", F.current_timestamp())
    return store.store_chunks(rows.where("embedding_error is null"))


def ingest_stream(files: DataFrame, store: Store, checkpoint: str, config: ChunkingConfig | None = None, embedder: Embedder | None = None):
    """Every micro-batch replaces its files, so a batch that is run again changes nothing."""
    return files.writeStream.foreachBatch(lambda df, _: ingest_batch(df, store, config, embedder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_state_stream(events: DataFrame, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """(job_id, status, progress, message, events): a job's state after each micro-batch that has events of it.

    A state is dropped ttl_ms after its job's last event; late events of a dropped job begin a new state. Without ttl_ms
    states stay, and a stream that is to end with its input needs that: a timeout keeps it running.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # the order of jobs.state: time, final, progress, status, message; progress is the last one known
        order, status, known_at, known, message, n = state.get if state.exists else ("", None, -1, 0.0, None, 0)
        best = tuple(json.loads(order)) if order else (-1,)
        for pdf in batches:
            n += len(pdf)
            for r in pdf[pdf["ts"].notna()].itertuples(index=False):
                at = int(r.ts.value // 1000)
                p = None if r.progress is None or r.progress != r.progress else float(r.progress)
                mine = (at, int(r.status in FINAL), -1.0 if p is None else p, r.status or "", r.message or "")
                if mine > best:
                    best, status, message = mine, r.status, r.message
                if p is not None and (at, p) > (known_at, known):
                    known_at, known = at, p
        progress = 100.0 if status == "completed" else max(0.0, min(100.0, known)) if known_at >= 0 else 0.0
        state.update((json.dumps(best), status, known_at, known, message, n))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], status, progress, message, n)], columns=["job_id", "status", "progress", "message", "events"])

    return events.where("job_id is not null").groupBy("job_id").applyInPandasWithState(step, "job_id string, status string, progress double, message string, events long", "last string, status string, known_at long, known double, message string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout if ttl_ms is not None else GroupStateTimeout.NoTimeout)


def learning_stream(log: DataFrame, key: str = "strategy", score: str = "score") -> DataFrame:
    """(key, n, threshold, rate): parameters after each micro-batch, with the last scores as state."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = state.get if state.exists else (Params().to_json(), 0)
        p = Params.from_json(text)
        for pdf in batches:
            for s in pdf.sort_values("ts")[score]:
                if s == s and s is not None:
                    p, n = update(p, float(s)), n + 1
        state.update((p.to_json(), n))
        yield pd.DataFrame([(k[0], n, p.threshold, p.rate)], columns=["key", "n", "threshold", "rate"])

    return log.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(step, "key string, n long, threshold double, rate double", "params string, n long", "update", GroupStateTimeout.NoTimeout)


def progress_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Events without repetitions, within the watermark; the source of subscribers."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job_id", "ts", "status"])


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))


def job_event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(JOB_EVENTS).parquet(folder)
