"""Evaluation texts leaking into training text (problem 7).

Windows of words are embedded by a random walk (CGK): step j copies the current word's hash to position j of the output and
moves on if a random bit of (j, word) says so. Windows at a small edit distance get outputs at a small Hamming distance, so a
few sampled positions of the output agree with good odds; several repetitions reach a recall that can be set. What agrees
is verified by the exact edit distance of the words (0: the words are equal).

Of a window that is to have at most so many edits, a run of words stays whole (width - edits words in edits + 1 runs). Where
edits are allowed, only windows of documents that hold such a run of some item are walked; none that could be found is left out.

The evaluation items are a fixed small set: their windows go to every task, checked against a limit; beyond it they are
handled in blocks of items. Documents are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm._text import alnum_table, codepoints, mix64, scan_rows, sliding_hash, words

#: Code points of items that one pass over the documents looks for.
BLOCK_CHARS = 8_000_000
#: Steps of the walk per word.
STRETCH = 3
SAMPLES = 6
#: The same where edits are allowed: fewer agree by more odds, and what agrees is verified.
EDITED_SAMPLES = 4
MOST_REPETITIONS = 200


class Walk:
    """Bit-sampled positions of the random-walk embedding of windows of width words."""

    def __init__(self, width: int, seed: int, samples: int = SAMPLES):
        rng = np.random.default_rng([width, seed])
        self.width, self.steps = width, STRETCH * width
        self.salt = rng.integers(1, 2**63 - 1, self.steps, dtype=np.uint64)
        self.kept = np.zeros(self.steps, bool)
        # the walk is over a word's last copy after two thirds of the steps or so; samples come from the part before
        self.kept[rng.choice(2 * width, min(samples, 2 * width), replace=False)] = True

    def keys(self, tokens: np.ndarray, starts: np.ndarray, held: np.ndarray) -> np.ndarray:
        """held: words from each start on that are the window's, width at most."""
        at = np.zeros(len(starts), np.int64)
        key = np.zeros(len(starts), np.uint64)
        for j in range(int(np.flatnonzero(self.kept)[-1]) + 1):
            done = at >= held
            x = tokens[starts + np.minimum(at, held - 1)]
            if self.kept[j]:
                key = (key ^ np.where(done, np.uint64(0), x)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
                key ^= key >> np.uint64(29)
            at += ((x * self.salt[j] | np.uint64(0)) >> np.uint64(63)).astype(np.int64)
        return mix64(key)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int, open_end: bool = False) -> np.ndarray:
    """Edit distance of each row of a to that of b (rows x words), in a band of most; most + 1 where it is larger.

    open_end: to the nearest beginning of the row of b.
    """
    n, wa = a.shape
    wb = b.shape[1]
    big = np.int8(most + 1)
    # word by word of all rows, so that each step runs over contiguous numbers
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(n, big, np.int8)
    row = [np.full(n, min(j, most + 1), np.int8) for j in range(wb + 1)]
    for i in range(1, wa + 1):
        new = [far] * (wb + 1)
        if i <= most:
            new[0] = np.full(n, i, np.int8)
        for j in range(max(1, i - most), min(wb, i + most) + 1):
            v = row[j - 1] + (a[i - 1] != b[j - 1])
            np.minimum(v, row[j] + 1, out=v)
            np.minimum(v, new[j - 1] + 1, out=v)
            new[j] = np.minimum(v, big)
        row = new
    return np.min(row, axis=0) if open_end else row[wb]


class Probe:
    """The items' windows, indexed for every repetition of the walk."""

    def __init__(self, ids: list[int], texts: list[str], width: int, repetitions: int, stride: int, samples: int = SAMPLES, most: int = 0):
        self.width, self.ids = width, np.array(ids, np.int64)
        self.tokens, off = words(*codepoints(pa.array(texts, pa.string())), alnum_table())
        n = np.diff(off)
        # every stride-th window of an item, and its last
        starts = [np.unique(np.append(np.arange(a, a + m - width + 1, stride), a + m - width)) if m >= width else np.empty(0, np.int64) for a, m in zip(off[:-1], n, strict=True)]
        self.item = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        self.starts = np.concatenate([*starts, np.empty(0, np.int64)]).astype(np.int64)
        self.run = (width - most) // (most + 1) if most else 0  # words that stay together whatever the edits
        if self.run:
            self.runs = np.unique(sliding_hash(self.tokens, off, self.run)[0])
            self.run_bits = np.zeros(1 << 22, bool)
            self.run_bits[(self.runs >> np.uint64(42)).astype(np.int64)] = True
        self.tables = []
        for r in range(repetitions):
            walk = Walk(width, r, samples)
            keys = walk.keys(self.tokens, self.starts, np.full(len(self.starts), width))
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(keys >> np.uint64(42)).astype(np.int64)] = True
            self.tables.append((walk, keys[order], order, bits))

    def find(self, tokens: np.ndarray, off: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, item window, edits) of the windows of documents that match a window of an item.

        A window of a document begins at any word that least words follow, and ends where it is nearest to the item's: width - most
        to width + most words on.
        """
        least = max(1, self.width - most)
        count = np.maximum(np.diff(off) - least + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        starts = np.arange(len(row)) + np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        found = []
        if len(self.starts) == 0 or len(starts) == 0:
            return tuple(np.empty(0, np.int64) for _ in range(4))  # type: ignore[return-value]
        if self.run:
            h, at = sliding_hash(tokens, off, self.run)
            hit = self.run_bits[(h >> np.uint64(42)).astype(np.int64)]
            where = np.flatnonzero(hit)
            hit[where] = self.runs[np.minimum(np.searchsorted(self.runs, h[where]), len(self.runs) - 1)] == h[where]
            before = np.concatenate([[0], np.cumsum(hit)])
            first = at[row] + starts - off[row]
            keep = before[np.minimum(first + self.width + most - self.run + 1, at[row + 1])] > before[np.minimum(first, at[row + 1])]
            row, starts = row[keep], starts[keep]
            if not len(starts):
                return tuple(np.empty(0, np.int64) for _ in range(4))  # type: ignore[return-value]
        left = off[1:][row] - starts
        held = np.minimum(left, self.width)
        for walk, keys, order, bits in self.tables:
            mine = walk.keys(tokens, starts, held)
            maybe = np.flatnonzero(bits[(mine >> np.uint64(42)).astype(np.int64)])
            lo = np.searchsorted(keys, mine[maybe], side="left")
            n = np.searchsorted(keys, mine[maybe], side="right") - lo
            w = np.repeat(maybe, n)
            q = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(int(n.sum()))]
            found.append(w * len(self.starts) + q)
        pair = np.unique(np.concatenate(found))
        w, q = pair // len(self.starts), pair % len(self.starts)
        span, reach = np.arange(self.width), np.arange(self.width + most)
        edits = np.empty(len(w), np.int16)
        for a in range(0, len(w), 100_000):
            v = w[a : a + 100_000]
            # past the row's end stands a word that no item has
            mine = np.where(reach < left[v, None], tokens[np.minimum(starts[v, None] + reach, len(tokens) - 1)], np.uint64(0))
            theirs = self.tokens[self.starts[q[a : a + 100_000], None] + span]
            edits[a : a + 100_000] = (mine != theirs).any(1) if most == 0 else edit_distance(theirs, mine, most, open_end=True)
        ok = edits <= most
        return row[w[ok]], self.item[q[ok]], q[ok], edits[ok].astype(np.int64)


@lru_cache
def repetitions_for(width: int, most: int, recall: float, samples: int = EDITED_SAMPLES) -> int:
    """Repetitions after which a window most edits away shares a key with the stated odds, MOST_REPETITIONS at most.

    Counted on random windows with words inserted, deleted or replaced, for the kind that needs most. Equal windows always
    share their key.
    """
    if most == 0:
        return 1
    rng = np.random.default_rng([width, most, samples])
    n, held = 300, np.full(300, width)
    base = rng.integers(1, 2**63 - 1, (n, width), dtype=np.uint64)
    kinds = []
    for kind in ("insert", "delete", "replace"):
        rows = []
        for r in base.tolist():
            for _ in range(most):
                at = int(rng.integers(0, len(r)))
                r[at : at + (kind != "insert")] = [] if kind == "delete" else [int(rng.integers(1, 2**63 - 1))]
            rows.append((r + rng.integers(1, 2**63 - 1, most).tolist())[:width])
        kinds.append(np.array(rows, np.uint64).ravel())
    met = np.zeros((len(kinds), n), bool)
    starts = np.arange(n) * width
    for r in range(MOST_REPETITIONS):
        walk = Walk(width, r, samples)
        own = walk.keys(base.ravel(), starts, held)
        for k, rows in enumerate(kinds):
            met[k] |= walk.keys(rows, starts, held) == own
        if met.mean(1).min() >= recall:
            return r + 1
    return MOST_REPETITIONS


def find_leaks(documents: DataFrame, items: DataFrame, width: int = 12, most: int = 0, recall: float = 0.95, stride: int = 1, shorter: bool = False) -> DataFrame:
    """(doc_id, item_id, n_windows, least_edits) of each document that holds a window of width words of an item, with at most edits.

    Edits are words inserted, deleted or replaced. shorter: an item of fewer than width words is one window of its own size, with
    edits in proportion (most * words // width).

    n_windows: different windows of the item found. Words are maximal runs of letters and digits, lower-cased. Null texts
    and, unless shorter, items of fewer than width words match nothing. Items of one id are separate texts of that item.
    """
    # items come to the driver one after another, and a block of them at a time goes out
    blocks: list[list] = [[]]
    size = 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        size += len(r["text"])
        if size > BLOCK_CHARS and blocks[-1]:
            blocks.append([])
            size = len(r["text"])
        blocks[-1].append(r)
    parts = [_find_block(documents, b, width, most, recall, stride, shorter) for b in blocks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if len(parts) == 1 else out.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.min("least_edits").alias("least_edits"))


def _probes(ids: list[int], texts: list[str], width: int, most: int, recall: float, stride: int, shorter: bool) -> list[tuple[Probe, int]]:
    """The probe of windows of width words and, for shorter items, one of each size; with the edits each allows."""
    out = [(Probe(ids, texts, width, repetitions_for(width, most, recall), stride, EDITED_SAMPLES if most else SAMPLES, most), most)]
    size = np.diff(words(*codepoints(pa.array(texts, pa.string())), alnum_table())[1]) if shorter and texts else np.empty(0, np.int64)
    for n in np.unique(size[(size > 0) & (size < width)]).tolist():
        of, edits = np.flatnonzero(size == n), most * n // width
        out.append((Probe([ids[i] for i in of], [texts[i] for i in of], n, repetitions_for(n, edits, recall), 1, EDITED_SAMPLES if edits else SAMPLES, edits), edits))
    return out


def _find_block(documents: DataFrame, items: list, width: int, most: int, recall: float, stride: int, shorter: bool) -> DataFrame:
    spark: SparkSession = documents.sparkSession
    ids, texts = [r["item_id"] for r in items], [r["text"] for r in items]
    sent = spark.sparkContext.broadcast((ids, texts))  # at most BLOCK_CHARS
    made: dict[str, list[tuple[Probe, int]]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan_rows(batch, "text"):
                if "probes" not in made:
                    made["probes"] = _probes(*sent.value, width, most, recall, stride, shorter)
                tokens, off = words(*codepoints(part.column("text")), alnum_table())
                hits, n_windows = [], 0
                for probe, allowed in made["probes"]:
                    row, item, window, edits = probe.find(tokens, off, allowed)
                    hits.append((row, probe.ids[item], window + n_windows, edits))
                    n_windows += len(probe.starts)
                row, which, window, edits = (np.concatenate(c) for c in zip(*hits, strict=True))
                if not len(row):
                    continue
                _, first, inverse = np.unique(np.stack([row, which]), axis=1, return_index=True, return_inverse=True)
                inverse = inverse.ravel()
                least = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(least, inverse, edits)
                n = np.bincount(np.unique(inverse.astype(np.int64) * n_windows + window) // n_windows, minlength=len(first))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row[first])), pa.array(which[first], pa.int64()), pa.array(n, pa.int64()), pa.array(least, pa.int64())], names=["doc_id", "item_id", "n_windows", "least_edits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, f"doc_id {kind}, item_id long, n_windows long, least_edits long")
