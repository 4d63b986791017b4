"""Mixing sources to target weights (problem 8).

Tokens are summed by source and bucket of a hash of the document's id. From these histograms the driver (sources x
BUCKETS numbers, whatever the data's size) finds each source's budget threshold: buckets below it are taken whole, and only
the one bucket the budget falls into is refined by the next bits of the hash, until it holds one document. A document is in
when its hash is under its source's threshold, so nothing is sorted and the choice for a smaller budget is part of that for
a larger one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bits of the hash per level; 2 ** BITS buckets per source reach the driver.
BITS = 10
LEVELS = 6
#: The most sources a mixture may name; the driver holds LEVELS x 2 ** BITS numbers for each.
MAX_SOURCES = 10_000


# Fixed value: how the byte-level BPE of 50,257 tokens splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """df without column text, with the number of tokens of the whole text (0 for null and empty)."""
    schema = T.StructType([f for f in df.schema.fields if f.name not in (text, out)] + [T.StructField(out, T.LongType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(tokenizer)
        for b in batches:
            texts = b.column(text)
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(n, pa.int64())], names=[*names, out])

    return df.mapInArrow(run, schema)


def source_key(c) -> F.Column:  # type: ignore[name-defined]
    """One spelling per source: case, outer white space and '-' for '_' don't matter."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "-", "_")


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, h, n_tokens) of documents with a source; h is a 60-bit hash of the id."""
    base = df.select(F.col(f"`{doc_id}`").alias("doc_id"), source_key(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("text")).where("source is not null")
    return count_tokens(base, "text", "n_tokens", tokenizer).select("doc_id", "source", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS).alias("h"), "n_tokens")


def plan_mixture(docs: DataFrame, targets: list[Row], total: int | None = None) -> list[dict]:
    """Per source: budget, whole passes over the source, and the hash threshold under which a document is taken once more.

    Without total, the largest mixture is made in which no source needs more than max_repeats uses of a document. Sources of
    targets without documents get no budget; the shares of the others are then taken in proportion.
    """
    if len(targets) > MAX_SOURCES:
        raise ValueError(f"{len(targets)} sources; at most {MAX_SOURCES}")
    want = {}
    for r in targets:
        if r["source"] is not None and (r["target_share"] or 0) > 0:
            key = r["source"].strip().lower().replace("-", "_")
            share, reps = want.get(key, (0.0, 0))
            want[key] = (share + float(r["target_share"]), max(reps, int(r["max_repeats"] or 0)))

    def histogram(level: int, inside: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
        at = F.shiftright("h", BITS * (LEVELS - 1 - level))
        wanted = F.broadcast(docs.sparkSession.createDataFrame(list(inside.items()), "source string, prefix long"))  # a row per source
        rows = docs.join(wanted, "source")
        if level:  # only the boundary bucket of each source
            rows = rows.where(F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix"))
        out: dict[str, list[tuple[int, int, int]]] = {}
        for r in rows.groupBy("source", at.alias("b")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("c")).collect():
            out.setdefault(r["source"], []).append((r["b"], r["n"], r["c"]))
        return {k: sorted(v) for k, v in out.items()}

    if not want:
        return []
    hist = histogram(0, dict.fromkeys(want, 0))
    have = {s: sum(n for _, n, _ in v) for s, v in hist.items()}
    usable = {s: w for s, w in want.items() if have.get(s, 0) > 0 and w[1] > 0}
    shares = sum(w[0] for w in usable.values())
    cap = min((have[s] * reps / (share / shares) for s, (share, reps) in usable.items()), default=0.0)
    size = cap if total is None else min(float(total), cap)
    plans, open_ = {}, {}
    for s, (share, reps) in want.items():
        plan = plans[s] = {"source": s, "target_share": share, "max_repeats": reps, "available": have.get(s, 0), "budget": 0.0, "passes": 0, "threshold": 0}
        if s in usable:
            budget = plan["budget"] = size * share / shares
            plan["passes"] = min(reps, int(budget / have[s] + 1e-9))
            rest = budget - plan["passes"] * have[s]
            if plan["passes"] < reps and rest > 0:
                open_[s] = rest
    level = 0
    while open_ and level < LEVELS:
        shift = BITS * (LEVELS - 1 - level)
        again = {}
        for s, rest in open_.items():
            edge = None
            for b, n, c in hist.get(s, []):
                if n <= rest:
                    rest -= n
                    plans[s]["threshold"] = (b + 1) << shift
                    continue
                edge = (b, c)
                break
            if edge and edge[1] > 1 and level + 1 < LEVELS:
                plans[s]["threshold"] = edge[0] << shift
                again[s] = (edge[0], rest)
            elif edge and rest > 0:
                # one document is left at the edge: it is taken if that comes nearer to the budget
                n = next(n for b, n, _ in hist[s] if b == edge[0])
                plans[s]["threshold"] = (edge[0] + (n - rest < rest)) << shift
        level += 1
        open_ = {s: rest for s, (_, rest) in again.items()}
        hist = histogram(level, {s: b for s, (b, _) in again.items()}) if again else {}
    return list(plans.values())


def _plan_frame(spark: SparkSession, plans: list[dict]) -> DataFrame:
    schema = "source string, target_share double, max_repeats int, available long, budget double, passes int, threshold long"
    return spark.createDataFrame(pd.DataFrame(plans), schema) if plans else spark.createDataFrame([], schema)


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER, cut=None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: doc_id, source, n_tokens, copies (1..max_repeats) of every document used. shares: source, target_share,
    available_tokens, used_tokens, actual_share, most_copies of every source of targets. Documents whose source is null or in
    no target are not used; empty texts weigh nothing and go with their hash. Rows of targets naming one source are added.
    cut: writes the sized documents to a table and reads it again, so texts are tokenized once; by default they are persisted.
    """
    docs = sized(documents, tokenizer=tokenizer)
    docs = cut(docs) if cut else docs.persist()
    plan = F.broadcast(_plan_frame(documents.sparkSession, plan_mixture(docs, targets.limit(MAX_SOURCES + 1).collect(), total)))  # a row per source
    used = docs.join(plan, "source").withColumn("copies", F.col("passes") + (F.col("h") < F.col("threshold")).cast("int"))
    mixture = used.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    sums = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    every = plan.join(F.broadcast(sums), "source", "left").select("source", "target_share", F.col("available").alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    total_used = every.agg(F.sum("used_tokens").alias("all_tokens"))
    shares = every.crossJoin(F.broadcast(total_used)).select("source", "target_share", "available_tokens", "used_tokens", F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"), "most_copies")  # one row
    return mixture, shares


def default_tokenizer() -> str:
    return os.environ.get("DOCLOOM_TOKENIZER", TOKENIZER)
