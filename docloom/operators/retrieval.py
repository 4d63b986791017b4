"""Search: nearest chunks, metadata, boosts, filters, context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.domains import boost_factor
from docloom.functions.vectors import matrix
from docloom.schemas import SearchOptions


def knn(chunks: DataFrame, vector: list[float], limit: int = 10, mode: str = "similarity", vector_col: str = "embedding", id_col: str = "chunk_id", one_per_id: bool = False) -> DataFrame:
    """The limit nearest rows with their score; ties: smaller id. Rows whose vector has another size, a null or no finite
    number take no part. one_per_id: rows of one id are one, the nearest of them.

    Distances are matrix products over Arrow batches; a batch hands on its best rows only (all that tie with the last), so
    the final TakeOrderedAndProject sees batches x limit rows. Select the columns wanted before, they go through Python.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("score", T.DoubleType())])
    q = np.array(vector, np.float64)
    norm = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = matrix(b.column(vector_col), len(q))
            if not len(rows):
                continue
            if mode == "similarity":
                n = np.sqrt(np.einsum("ij,ij->i", x, x)) * norm
                s = np.divide(x @ q, n, out=np.zeros(len(x)), where=n > 0)
                key = -s
            else:
                key = s = np.sqrt(((x - q) ** 2).sum(1))
            each = key
            if one_per_id:
                ids = b.column(id_col).take(pa.array(rows)).dictionary_encode().indices.fill_null(-1).to_numpy()
                order = np.argsort(key, kind="stable")
                each = key[order][np.unique(ids[order], return_index=True)[1]]  # the best of each id
            last = np.partition(each, min(limit, len(each)) - 1)[min(limit, len(each)) - 1]
            at = np.flatnonzero(key <= last)
            best = b.take(pa.array(rows[at]))
            yield pa.RecordBatch.from_arrays([*best.columns, pa.array(s[at])], names=[*best.schema.names, "score"])

    order = F.desc("score") if mode == "similarity" else F.asc("score")
    found = chunks.mapInArrow(run, schema)
    if one_per_id:
        rest = [c for c in found.columns if c != id_col]
        best = (F.max_by if mode == "similarity" else F.min_by)(F.struct(*rest), "score")
        found = found.groupBy(id_col).agg(best.alias("x")).select(*[F.col(id_col) if c == id_col else F.col(f"x.{c}").alias(c) for c in found.columns])
    return found.orderBy(order, id_col).limit(max(1, limit))


def with_score_at_least(hits: DataFrame, least: float) -> DataFrame:
    """Applied to hits, after the limit."""
    return hits.where(F.coalesce("score", F.lit(0.0)) >= least)


def join_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """hits with the newest metadata of each chunk; hits without any keep nulls. The few hits are the broadcast side."""
    cols = [c for c in metadata.columns if c not in hits.columns or c == "chunk_id"]
    keys = F.broadcast(hits.select("chunk_id").distinct())  # as many rows as the search's limit
    mine = metadata.select(*cols, *([] if "created_at" in cols else [F.col("created_at")])).join(keys, "chunk_id", "left_semi")
    newest = mine.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in cols if c != "chunk_id"]), F.struct("created_at", *[c for c in ("quality_score", "content_type", "language") if c in cols])).alias("m"))
    return hits.join(newest, "chunk_id", "left").select(*[F.col(c) for c in hits.columns], *[F.col(f"m.{c}").alias(c) for c in cols if c != "chunk_id"])


def average_score(hits: DataFrame) -> DataFrame:
    return hits.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"), F.count("*").alias("hits"))


def needs_recommendation(n: Column, average: Column, threshold: Column | float, n_terms: Column) -> Column:
    """Too few hits, poor ones, or a long query."""
    return (n < 3) | (average < threshold) | (n_terms > 5)


def boost(hits: DataFrame, domains: Column, rank_col: str = "rank") -> DataFrame:
    """hits with scores multiplied by the best boost among their tags, in descending order; equal scores keep their order."""
    out = hits.withColumn("score", F.col("score") * boost_factor(F.col("domain_tags"), domains))
    return out.withColumn(rank_col, F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), rank_col)))


def metadata_predicate(o: SearchOptions) -> Column | None:
    """The filters as one condition; hits without metadata always pass. None if no filter stage runs."""
    gate = bool(o.domain_filter or o.content_type_filter or o.language_filter)
    if not o.strict:
        gate = gate or o.min_quality_score is not None or o.min_authority_score is not None
    if not gate:
        return None
    conds: list[Column] = []
    if o.domain_filter:
        conds.append(F.arrays_overlap(F.coalesce("domain_tags", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in o.domain_filter])))
    if o.content_type_filter:
        conds.append(F.col("content_type").isin(o.content_type_filter))
    if o.language_filter:
        conds.append(F.coalesce(F.col("language").isin(o.language_filter), F.lit(False)))
    if o.min_quality_score is not None:
        conds.append(F.coalesce("quality_score", F.lit(0.0)) >= o.min_quality_score)
    if o.min_authority_score is not None:
        conds.append(F.coalesce("source_authority", F.lit(0.0)) >= o.min_authority_score)
    return F.col("content_type").isNull() | reduce(lambda a, b: a & b, conds)


def apply_filters(hits: DataFrame, o: SearchOptions) -> DataFrame:
    p = metadata_predicate(o)
    return hits if p is None else hits.where(p)


def file_chunks(chunks: DataFrame, path: str) -> DataFrame:
    """A file's chunks in order, without vectors; of several deliveries of a chunk the newest."""
    return latest(chunks.where(F.col("file_path") == path), ["chunk_id"], "created_at").drop("embedding").orderBy("chunk_index")


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The newest row of each key; rows equal in it are settled by their other columns' hash."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(by, F.xxhash64(*[c for c in df.columns if c != "embedding"]))).alias("x")).select(*[F.col(k) if c in keys else F.col(f"x.{c}").alias(c) for c in df.columns for k in [c]])


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The chunk of an id, without vector; of several deliveries the newest. No row for an unknown id."""
    return latest(chunks.where(F.col("chunk_id") == chunk_id).drop("embedding"), ["chunk_id"], "created_at")


def metadata_of(metadata: DataFrame, chunk_id: str) -> DataFrame:
    """The newest metadata of a chunk. No row for an unknown id."""
    return latest(metadata.where(F.col("chunk_id") == chunk_id), ["chunk_id"], "created_at")


#: Chunk numbers that are placed together; a file of any size is dealt out to tasks by them.
SPAN = 4096


def positioned(chunks: DataFrame) -> DataFrame:
    """chunks with position: their place in their file by chunk_index, from 0.

    Places are counted within spans of chunk numbers, and the spans before are added up; no task sees a whole large file.
    """
    span = F.coalesce(F.floor(F.col("chunk_index") / SPAN), F.lit(-(1 << 40)))  # no number comes first
    rows = chunks.withColumn("_span", span)
    sizes = rows.groupBy("file_path", "_span").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file_path").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_path", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("file_path", "_span").orderBy("chunk_index"))
    return rows.join(starts, ["file_path", "_span"]).withColumn("position", (F.col("_start") + inside - 1).cast("long")).select(*chunks.columns, "position")


def context_window(chunks: DataFrame, targets: DataFrame, size: int = 3) -> DataFrame:
    """(file_path, position, ..., target_index, target_position): the chunks around each target, by position in its file.

    targets: file_path, chunk_index. A target that does not exist gives no row. Targets meet their surroundings by position.
    """
    want = targets.select("file_path", F.col("chunk_index").alias("target_index")).distinct()
    mine = chunks.join(want.select("file_path").distinct(), "file_path", "left_semi")
    placed = positioned(mine)
    at = placed.select("file_path", F.col("chunk_index").alias("target_index"), F.col("position").alias("target_position")).distinct()
    found = want.join(at, ["file_path", "target_index"])
    around = found.withColumn("position", F.explode(F.sequence(F.col("target_position") - size, F.col("target_position") + size)))
    return placed.join(around, ["file_path", "position"])


def neighbours(chunks: DataFrame, size: int, content: str = "content", id: str = "chunk_id") -> DataFrame:
    """chunks with context: the contents of the size chunks before and after each in its file, joined by line ends.

    id must be unique. Only ids are placed; contents go to the positions that need them.
    """
    placed = positioned(chunks.select("file_path", "chunk_index", id))
    texts = placed.select(id, "file_path", "position").join(chunks.select(id, F.col(content).alias("_text")).where("_text is not null"), id)
    sent = texts.select("file_path", F.explode(F.sequence(F.col("position") - size, F.col("position") + size)).alias("to"), "position", "_text")
    gathered = sent.groupBy("file_path", "to").agg(F.sort_array(F.collect_list(F.struct("position", "_text"))).alias("_around"))  # 2 * size + 1 texts
    context = placed.select(id, "file_path", F.col("position").alias("to")).join(gathered, ["file_path", "to"], "left")
    joined = F.concat_ws("\n", F.transform(F.coalesce("_around", F.array().cast("array<struct<position:bigint,_text:string>>")), lambda x: x["_text"]))
    return chunks.join(context.select(id, joined.alias("context")), id)


def previews(hits: DataFrame, length: int = 180) -> DataFrame:
    """hits with preview (cut with an ellipsis) and score_text (three decimals)."""
    c = F.coalesce("content", F.lit(""))
    return hits.withColumns({"preview": F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c), "score_text": F.format_string("%.3f", F.coalesce("score", F.lit(0.0)))})
