"""Cutting texts into overlapping chunks.

A text is first cut into segments (fixed size with good break points, sentences, or paragraphs), the segments are joined
by one blank, and the joined text is cut into windows of chunk_size that advance by chunk_size - overlap. All of it is
built-in expressions; only the windows are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.enhance import placeholder_blocks
from docloom.functions.text import token_estimate, trim
from docloom.schemas import ChunkingConfig

METHODS = ("fixed", "sentence-aware", "paragraph-aware")


def _last(s: Column, mark: str) -> Column:
    """0-based position of the last occurrence of a character, -1 if there is none."""
    return F.length(s) - F.length(F.substring_index(s, mark, -1)) - 1


def piece_end(piece: Column, size: int) -> Column:
    """How much of a window of size characters is kept: up to the last sentence end in its later half, else before the last
    blank after 30 % of it, else all."""
    dot = F.greatest(_last(piece, "."), _last(piece, "!"), _last(piece, "?"))
    blank = _last(piece, " ")
    return F.when(F.length(piece) <= 0.8 * size, F.length(piece)).when(dot > 0.5 * size, dot + 1).when(blank > 0.3 * size, blank).otherwise(F.length(piece))


def fixed_segments(c: Column, size: int) -> Column:
    """array<string>: the text walked through in windows of size characters, each shortened to a good break point."""
    most = F.ceil(F.length(c) / max(1, int(0.3 * size))).cast("int") + 1  # a piece but the last has over 0.3 size characters
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        window = F.substr(c, acc["at"], F.lit(size))
        end = piece_end(window, size)
        grown = F.struct((acc["at"] + end).cast("int").alias("at"), F.concat(acc["out"], F.array(F.substr(window, F.lit(1), end.cast("int")))).alias("out"))
        return F.when(acc["at"] > F.length(c), acc).otherwise(grown)

    folded = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["out"])
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(folded)


def sentence_segments(c: Column) -> Column:
    return F.filter(F.split(c, r"[.!?]+\s+"), lambda s: trim(s) != "")


def paragraph_segments(c: Column) -> Column:
    return F.filter(F.split(c, r"\n\s*\n"), lambda s: trim(s) != "")


def windows(joined: Column, size: int, overlap: int) -> Column:
    """array<struct<chunk_offset,content>>; empty for an empty text."""
    step = max(size - overlap, 1)
    at = F.when(F.length(joined) > 0, F.sequence(F.lit(0), F.length(joined) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("chunk_offset"), F.substr(joined, i + 1, F.lit(size)).alias("content")))


def chunk(df: DataFrame, config: ChunkingConfig | None = None, content: str = "content", path: str = "file_path", strict: bool = False) -> DataFrame:
    """One row per chunk: file_path, chunk_id, chunk_index, content, file_size, chunk_offset, token_count.

    Offsets and file_size are those of the joined text. Null and empty texts give no chunk. strict replaces fenced blocks
    by placeholders in the sentence method when preserve_code_blocks is set; otherwise they are kept.
    """
    cfg = config or ChunkingConfig()
    if cfg.method not in METHODS:
        raise ValueError(cfg.method)
    c = F.col("_text")
    src = df.where(F.col(content).isNotNull()).select(F.col(path).alias("file_path"), F.col(content).alias("_text"))
    if cfg.method == "sentence-aware" and cfg.preserve_code_blocks and strict:
        src = src.withColumn("_text", placeholder_blocks("_text"))
    seg = {"fixed": lambda: fixed_segments(c, cfg.chunk_size), "sentence-aware": lambda: sentence_segments(c), "paragraph-aware": lambda: paragraph_segments(c)}[cfg.method]()
    joined = src.withColumn("_joined", F.concat_ws(" ", seg)).select("file_path", "_joined")
    # outer, then filtered: an inner explode would have the joined text computed twice, see text.exploded
    out = joined.select("file_path", F.octet_length("_joined").alias("file_size"), F.posexplode_outer(windows(F.col("_joined"), cfg.chunk_size, cfg.overlap)).alias("chunk_index", "w")).where("chunk_index is not null")
    return out.select("file_path", F.concat_ws(":", "file_path", F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", F.col("w.content").alias("content"), "file_size", F.col("w.chunk_offset").alias("chunk_offset"), token_estimate(F.col("w.content")).alias("token_count"))
