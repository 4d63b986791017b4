"""Distances of vectors, as expressions and as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for an empty vector or one of length zero, an error for two sizes."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of two sizes")).cast("double")).when((F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def matrix(arr: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector has dim numbers, those vectors as float64)."""
    size = np.asarray(arr.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    if not len(rows):
        return rows, np.empty((0, dim))
    flat = arr.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    ok = np.isfinite(x).all(1)
    return rows[ok], x[ok]


def top_k(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id: str = "chunk_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of each query among those of its length; ties: smaller id first.

    The query set is stated by the caller and goes to all tasks in blocks of a fixed number of vectors; the corpus is read
    once per block and never shuffled. Each batch hands on its k best per query only, so what is shuffled for the last
    ranking is bounded by batches x queries x k.
    """
    from pyspark.sql import Window

    rows = [r for r in queries.select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")).toLocalIterator() if r["v"]]
    spark = corpus.sparkSession
    q_type, i_type = queries.schema[query_id].dataType.simpleString(), corpus.schema[id].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"query_id {q_type}, id {i_type}, score double, rank int")
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r["v"]), []).append(r)
    parts = []
    for dim, some in ((dim, of[at : at + block]) for dim, of in sorted(by_dim.items()) for at in range(0, len(of), block)):
        sent = spark.sparkContext.broadcast(([r["q"] for r in some], np.array([r["v"] for r in some], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, dim=dim) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            ask = pa.array(names)
            qn = np.sqrt((q * q).sum(1))
            for b in batches:
                ok, x = matrix(b.column("v"), dim)
                if not len(ok):
                    continue
                prod = q @ x.T
                if metric == "cosine":
                    n = np.sqrt((x * x).sum(1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        s = np.where((qn[:, None] * n) > 0, prod / (qn[:, None] * n), 0.0)
                    key = -s
                else:
                    s = np.empty_like(prod)
                    for j in range(len(q)):
                        s[j] = np.sqrt(((x - q[j]) ** 2).sum(1))
                    key = s
                # all that tie with the k-th best go on, so ties are settled by id at the end
                cut = np.partition(key, min(k, key.shape[1]) - 1, axis=1)[:, min(k, key.shape[1]) - 1]
                qi, xi = np.nonzero(key <= cut[:, None])
                yield pa.RecordBatch.from_arrays([ask.take(pa.array(qi)), b.column("id").take(pa.array(ok[xi])), pa.array(s[qi, xi])], names=["query_id", "id", "score"])

        parts.append(corpus.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("v is not null").mapInArrow(run, f"query_id {q_type}, id {i_type}, score double"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= k)
