"""Near-duplicate records with small edits (problem 5).

A record's set of word sequences gets a fixed-length signature: SEGMENTS x LENGTH positions, each the smallest of its set
under one hash function, so two records agree in a position with odds equal to their similarity. The signature is cut into
segments so short that near-duplicates differ in at most one position of some segment; each segment is indexed once per
position with that position deleted (its deletion variants). Records of one variant are the candidates (an equality join of
the variants with themselves, made in one shuffle by sorting), which are verified exactly on the sets. At similarity s a pair is missed with odds (1 - s^r - r (1-s) s^(r-1)) ^ SEGMENTS, r = LENGTH:
below 0.2 % at 0.6 with the values here, and below one in a million at 0.75.

Records with one set of sequences are one class; only classes are joined, so copies never meet one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._graph import components
from docloom.llm._text import ascii_word_table, by_group, codepoints, mix64, row_of, scan_rows, sliding_hash, words

LENGTH, SEGMENTS = 5, 16
#: Records of one variant that a task pairs; of a variant with more, every two parts of so many records are a task.
PART = 2000
#: Pairs a task holds at once.
PAIRS = 1_000_000
_ONE = np.uint64(1)


def shingle_sets(df: DataFrame, id: str, text: str, width: int, least_words: int) -> DataFrame:
    """(id, c, n, sequences): each record's distinct sequences of width words as sorted hashes, and c, the class of equal sets.

    Words are maximal runs of ASCII letters, digits and '_', lower-cased. Records with fewer than least_words words (or than
    width) are left out, null texts and ids too.
    """
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in scan_rows(batch, "text"):
                tokens, off = words(*codepoints(part.column("text")), ascii_word_table())
                keep = np.flatnonzero(np.diff(off) >= max(least_words, width))
                if not len(keep):
                    continue
                seq, so = sliding_hash(tokens, off, width)
                row = row_of(so)
                order = np.lexsort((seq, row))
                seq, row = seq[order], row[order]
                new = np.ones(len(seq), bool)
                new[1:] = (seq[1:] != seq[:-1]) | (row[1:] != row[:-1])
                keep_row = np.zeros(part.num_rows, bool)
                keep_row[keep] = True
                new &= keep_row[row]
                seq, row = seq[new], row[new]
                size = np.bincount(row, minlength=part.num_rows)[keep]
                at = np.concatenate([[0], np.cumsum(size)])
                c = mix64(np.add.reduceat(mix64(seq), at[:-1]) + size.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep)), pa.array(c.view(np.int64)), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(seq.view(np.int64)))], names=["id", "c", "n", "sequences"])

    return rows.mapInArrow(run, f"id {kind}, c long, n int, sequences array<long>")


def _variants(classes: DataFrame, length: int, segments: int) -> DataFrame:
    """(variant, c): every segment of the signature with one position deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.random.default_rng(11).integers(1, 2**63 - 1, length * segments, dtype=np.uint64) | _ONE
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                lists = b.column("sequences")
                seq = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))[:-1]]).astype(np.int64)
                mins = np.empty((b.num_rows, length * segments), np.uint64)
                for k, f in enumerate(factor):
                    x = seq * f
                    x ^= x >> np.uint64(32)
                    mins[:, k] = np.minimum.reduceat(x, starts)
                out = []
                for s in range(segments):
                    part = mins[:, s * length : (s + 1) * length]
                    for gone in range(length):
                        h = np.full(b.num_rows, s * length + gone + 1, np.uint64)
                        for k in range(length):
                            if k != gone:
                                h = mix64(h ^ part[:, k]) + np.uint64(k)
                        out.append(h)
                v = np.stack(out, 1)
                yield pa.RecordBatch.from_arrays([pa.array(v.ravel().view(np.int64)), pa.array(np.repeat(b.column("c").to_numpy(), v.shape[1]))], names=["variant", "c"])

    return classes.select("c", "sequences").mapInArrow(run, "variant long, c long")


def _pairs_of(groups: list[np.ndarray]) -> np.ndarray:
    """All pairs within each group of distinct numbers, smaller first."""
    out = []
    by_size: dict[int, list[np.ndarray]] = {}
    for g in groups:
        by_size.setdefault(len(g), []).append(g)
    for n, same in by_size.items():
        m = np.stack(same)
        i, j = np.triu_indices(n, 1)
        out.append(np.stack([m[:, i].ravel(), m[:, j].ravel()], 1))
    p = np.concatenate([*out, np.empty((0, 2), np.int64)])
    p.sort(axis=1)
    return p


def _distinct(p: np.ndarray) -> pa.RecordBatch:
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])] if len(p) else p
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def _candidates(variants: DataFrame, part: int) -> DataFrame:
    """(a, b), a < b, distinct: classes with a common variant.

    Variants of up to part classes are paired where they are sorted; the classes of larger ones are handed on with a number
    counted up along the group, and every two parts of a group are a task of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pairs: pa.RecordBatch, variant: list[np.ndarray], c: list[np.ndarray], number: list[np.ndarray]) -> pa.RecordBatch:
            v, k, m = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (variant, c, number))
            none = pa.nulls(len(v), pa.int64()), pa.nulls(pairs.num_rows, pa.int64())
            cols = [pa.concat_arrays([pairs.column(0), none[0]]), pa.concat_arrays([pairs.column(1), none[0]]), *(pa.concat_arrays([none[1], pa.array(x)]) for x in (v, k, m))]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "variant", "c", "number"])

        held_v, held_c = np.empty(0, np.int64), np.empty(0, np.int64)  # of the last group, which may go on
        large, count = None, 0  # a group that is handed on, and how many of it were
        for batch in _with_end(batches):
            if batch is None:
                v, c, end = held_v, held_c, True
            else:
                v, c, end = np.concatenate([held_v, batch.column("variant").to_numpy()]), np.concatenate([held_c, batch.column("c").to_numpy()]), False
            if not len(v):
                continue
            edge = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])])
            out_v, out_c, out_n, groups, n_pairs = [], [], [], [], 0
            open_from = len(v)
            for k, (lo, hi) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                last = k == len(edge) - 2 and not end
                if v[lo] == large or hi - lo > part:
                    if v[lo] != large:
                        large, count = v[lo], 0
                    g = c[lo:hi][new[lo:hi]] if not last else c[lo:hi]
                    g = np.unique(g)
                    out_v.append(np.full(len(g), v[lo]))
                    out_c.append(g)
                    out_n.append(np.arange(count, count + len(g)))
                    count += len(g)
                elif last:
                    open_from = lo
                elif hi - lo > 1:
                    g = c[lo:hi][new[lo:hi]]
                    if len(g) > 1:
                        groups.append(g)
                        n_pairs += len(g) * (len(g) - 1) // 2
                        if n_pairs > PAIRS:
                            yield rows(_distinct(_pairs_of(groups)), [], [], [])
                            groups, n_pairs = [], 0
            held_v, held_c = v[open_from:], c[open_from:]
            yield rows(_distinct(_pairs_of(groups)), out_v, out_c, out_n)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "task", 50_000):
            task, c, side = (t.column(n).to_numpy() for n in ("task", "c", "side"))
            edge = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                x = np.unique(c[lo:hi][side[lo:hi] != 2])
                if not (side[lo:hi] == 2).any():
                    yield _distinct(_pairs_of([x]))
                    continue
                y = np.unique(c[lo:hi][side[lo:hi] == 2])
                p = np.stack([np.repeat(x, len(y)), np.tile(y, len(x))], 1)
                p.sort(axis=1)
                yield _distinct(p[p[:, 0] != p[:, 1]])

    placed = variants.repartition("variant").sortWithinPartitions("variant", "c")
    found = placed.mapInArrow(run, "a long, b long, variant long, c long, number long").persist()
    pairs = found.where("a is not null").select("a", "b")
    rest = found.where("variant is not null").select("variant", "c", F.floor(F.col("number") / part).cast("int").alias("part"))
    parts = rest.groupBy("variant").agg((F.max("part") + 1).alias("parts"))
    every = rest.join(parts, "variant").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    tasks = every.select(F.xxhash64("variant", low, high).alias("task"), "c", F.when(low == high, 0).when(F.col("part") == low, 1).otherwise(2).alias("side"))
    if not rest.isEmpty():
        pairs = pairs.unionByName(tasks.repartition("task").sortWithinPartitions("task").mapInArrow(cross, "a long, b long"))
    return pairs.distinct()


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(df: DataFrame, id: str, text: str, width: int = 5, least: float = 0.8, least_words: int = 0, length: int = LENGTH, segments: int = SEGMENTS, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: id, c - every record with its class of equal sets (rows of one id are one record). links: a, b, similarity -
    pairs of classes, a < b, whose sets have at least the least Jaccard similarity. A class is named by a 64-bit hash of its
    set. Empty tables give empty results.
    """
    sets = shingle_sets(df, id, text, width, least_words).persist()
    members = sets.select("id", "c").distinct()
    classes = sets.groupBy("c").agg(F.first("n").alias("n"), F.first("sequences").alias("sequences")).persist()
    found = _candidates(_variants(classes, length, segments), part)
    one = classes.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("sequences").alias("seq_a"))
    two = classes.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("sequences").alias("seq_b"))
    both = F.size(F.array_intersect("seq_a", "seq_b"))
    fits = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b")
    pairs = found.join(one, "a").join(two, "b").where(fits).select("a", "b", both.alias("both"), (F.col("n_a") + F.col("n_b")).alias("sum"))
    # both / (sum - both) >= least, without a rounded quotient
    links = pairs.where(F.col("both") >= F.lit(least) * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))
    return members, links


def member_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_1, id_2): all pairs of records that the links and classes stand for, smaller id first."""
    m1, m2 = members.select(F.col("c").alias("a"), F.col("id").alias("i")), members.select(F.col("c").alias("b"), F.col("id").alias("j"))
    across = links.select("a", "b").join(m1, "a").join(m2, "b")
    several = members.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
    copies = members.join(several, "c", "left_semi")
    within = copies.alias("x").join(copies.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    return across.select("i", "j").unionByName(within).select(F.least("i", "j").alias("id_1"), F.greatest("i", "j").alias("id_2"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_links, group_id): one row per record; group_id is the smallest class of its connected component."""
    links = links.persist()
    ends = links.select(F.col("a").alias("c")).unionByName(links.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("n_links"))
    comp = components(links.select("a", "b")).select(F.col("id").alias("c"), F.col("component").alias("group_id"))
    found = members.join(ends, "c", "left").join(comp, "c", "left")
    return found.select("id", F.col("c").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "c").alias("group_id"))
