"""Splitting oversized items at natural boundaries (problem 6).

Two ways to choose the cuts, over the same windows:

* cohesion: lexical-cohesion segmentation. The text is a row of small blocks of words; the similarity of the blocks left and
  right of each gap makes a curve whose valleys mark changes of topic. Within each size window the deepest valley is cut.
* kind: the rule of this project's data, the last paragraph end in the later half of the window, else the last sentence end,
  else the last word end, else the window's end. Valley depth cannot reproduce it, as it ignores what the words are.

Cuts are where new text begins; the piece that starts there is led by the last overlap characters before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Words in a block and blocks on each side of a gap for the cohesion curve.
BLOCK_WORDS, SIDE_BLOCKS = 12, 3
_BLANKS = np.array([0x20, 0x09, 0x0D, 0x0A], np.uint32)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions where a word begins after white space, their kinds: 3 after a blank line, 2 after a sentence, 1 else)."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(cp, _BLANKS)
    at = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(at) == 0:
        return at, at
    # the run of white space before each position begins after the last non-blank
    solid = np.maximum.accumulate(np.where(blank, -1, np.arange(len(cp))))
    before = solid[at - 1]  # -1: the text begins with white space
    lf = np.concatenate([[0], np.cumsum(cp == 0x0A)])
    n_lf = lf[at] - lf[before + 1]
    ends = np.zeros(len(at), bool)
    has = before >= 0
    ends[has] = np.isin(cp[before[has]], np.frombuffer(".!?".encode("utf-32-le"), np.uint32))
    return at, np.where(n_lf >= 2, 3, np.where(ends, 2, 1))


def cuts_by_kind(text: str, size: int, overlap: int) -> list[int]:
    """Cuts by the best kind of boundary in the later half of each window."""
    at, kind = boundaries(text)
    out, s, w = [], 0, size
    while len(text) - s > w:
        a, b = np.searchsorted(at, [s + w // 2, s + w], side="right")
        if b > a:
            k = kind[a:b]
            p = int(at[a + np.flatnonzero(k == k.max())[-1]])
        else:
            p = s + w
        out.append(p)
        s, w = p, max(size - overlap, 1)
    return out


def valleys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the gaps between blocks, depth of the similarity valley at each)."""
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) < 2 * BLOCK_WORDS:
        return np.empty(0, np.int64), np.empty(0)
    _, ids = np.unique([text[a:b].lower() for a, b in spans], return_inverse=True)
    block = np.arange(len(spans)) // BLOCK_WORDS
    n = int(block[-1]) + 1
    # sliding dot products of neighbouring sides, word by word, without a dense matrix of blocks by words
    sides = [{} for _ in range(n)]
    for b, i in zip(block.tolist(), ids.tolist(), strict=True):
        sides[b][i] = sides[b].get(i, 0) + 1
    sim = np.zeros(n - 1)
    for g in range(n - 1):
        left: dict[int, int] = {}
        right: dict[int, int] = {}
        for side, blocks in ((left, sides[max(0, g + 1 - SIDE_BLOCKS) : g + 1]), (right, sides[g + 1 : g + 1 + SIDE_BLOCKS])):
            for d in blocks:
                for i, c in d.items():
                    side[i] = side.get(i, 0) + c
        dot = sum(c * right.get(i, 0) for i, c in left.items())
        sim[g] = dot / np.sqrt(sum(c * c for c in left.values()) * sum(c * c for c in right.values()))
    peak_l, peak_r = np.empty(n - 1), np.empty(n - 1)
    for g in range(n - 1):  # the peak on a side: as far as the curve rises
        peak_l[g] = max(sim[g], peak_l[g - 1]) if g and sim[g - 1] >= sim[g] else sim[g]
    for g in range(n - 2, -1, -1):
        peak_r[g] = max(sim[g], peak_r[g + 1]) if g < n - 2 and sim[g + 1] >= sim[g] else sim[g]
    return np.array([spans[(g + 1) * BLOCK_WORDS][0] for g in range(n - 1)]), (peak_l - sim) + (peak_r - sim)


def cuts_by_cohesion(text: str, size: int, overlap: int) -> list[int]:
    """Cuts at the deepest valley in the later half of each window, moved to the nearest boundary of the best kind around it."""
    gap, depth = valleys(text)
    at, kind = boundaries(text)
    out, s, w = [], 0, size
    while len(text) - s > w:
        lo, hi = s + w // 2, s + w
        a, b = np.searchsorted(gap, [lo, hi], side="right")
        if b > a and depth[a:b].max() > 0:
            g = int(gap[a + int(np.argmax(depth[a:b]))])
            i, j = np.searchsorted(at, [lo, hi], side="right")
            near = at[i:j]
            p = g if not len(near) else int(near[np.lexsort((np.abs(near - g), -kind[i:j] * (np.abs(near - g) <= size // 8)))[0]])
        else:
            i, j = np.searchsorted(at, [lo, hi], side="right")
            p = int(at[i + np.flatnonzero(kind[i:j] == kind[i:j].max())[-1]]) if j > i else hi
        out.append(p)
        s, w = p, max(size - overlap, 1)
    return out


def latest_config(config: DataFrame) -> DataFrame:
    """(ext, chunk_size, overlap) of each file_extension's highest config_version (one row for each of a fixed, small set)."""
    return config.where("chunk_size > 0").groupBy(F.col("file_extension").alias("ext")).agg(F.max_by(F.struct("chunk_size", F.greatest(F.lit(0), F.least(F.coalesce("overlap", F.lit(0)), F.col("chunk_size") - 1)).alias("overlap")), "config_version").alias("c")).select("ext", "c.chunk_size", "c.overlap")


def oversized(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """(chunk_id, content, chunk_offset, size, overlap) of chunks longer than the limit of their file, one row per chunk_id.

    The configuration is a fixed set of at most a few dozen extensions; it becomes one map in a broadcast row.
    """
    conf = latest_config(config).agg(F.map_from_entries(F.collect_list(F.struct("ext", F.struct("chunk_size", "overlap").alias("v")))).alias("conf"))
    ext = F.element_at(F.split("file_path", r"\."), -1)
    found = F.coalesce(F.try_element_at("conf", F.when(F.col("file_path").contains("."), ext).otherwise("*")), F.try_element_at("conf", F.lit("*")))
    rows = chunks.select("chunk_id", "file_path", "content", "chunk_offset").where("content is not null and chunk_id is not null").crossJoin(F.broadcast(conf)).withColumn("c", found)  # one row
    large = rows.where(F.length("content") > F.col("c.chunk_size")).select("chunk_id", "content", "chunk_offset", F.col("c.chunk_size").alias("size"), F.col("c.overlap").alias("overlap"))
    return large.groupBy("chunk_id").agg(F.min_by(F.struct("content", "chunk_offset", "size", "overlap"), F.struct(F.col("chunk_offset").isNull(), "chunk_offset")).alias("x")).select("chunk_id", "x.*")


def split_oversized(chunks: DataFrame, config: DataFrame, by: str = "cohesion") -> DataFrame:
    """(chunk_id, piece_no, cut_at, start, chunk_offset, content): the pieces of every chunk longer than its limit.

    cut_at is where the piece's new text begins (0 for the first piece), start where the piece begins, overlap characters
    earlier; chunk_offset is start added to the chunk's own offset, null if that is null. No piece is longer than the limit.
    Null contents and contents within the limit give no row; a text without any boundary is cut at the limit. An overlap
    as large as the limit counts as one less. Several rows of one chunk_id are one chunk.
    """
    choose = {"cohesion": cuts_by_cohesion, "kind": cuts_by_kind}[by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                cuts = [0, *choose(r.content, int(r.size), int(r.overlap))]
                for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(r.content)], strict=True)):
                    start = max(0, a - int(r.overlap)) if i else 0
                    rows.append((r.chunk_id, i, a, start, None if pd.isna(r.chunk_offset) else int(r.chunk_offset) + start, r.content[start:b]))
            out = pd.DataFrame(rows, columns=["chunk_id", "piece_no", "cut_at", "start", "chunk_offset", "content"])
            yield out.astype({"chunk_offset": "Int32"})

    return oversized(chunks, config).mapInPandas(run, "chunk_id string, piece_no int, cut_at int, start int, chunk_offset int, content string")
