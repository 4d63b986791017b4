"""The most similar vectors of every vector (problem 1).

Cross-polytope hashing: unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random signs and a
Hadamard transform, here as two small matrix products); blocks of coordinates of the turned vector are hashed to the
nearest signed axis. A table joins blocks; a vector stands in its PROBES likeliest cells of each table (multiprobe), and two
vectors are compared wherever any cell of one is a cell of the other, which finds far more for each row sent than looking
from the own cell only. What meets is compared by a sketch of sign bits, and pairs that may reach the least cosine are
verified exactly with the vectors themselves.

A cell of more than SMALL rows is divided by one more block, whose likeliest axes travel with the row: two rows are then
compared if the nearest axis of one is among the NEAR likeliest of the other. A cell of more than HOT rows is dealt out to
several tasks, so that every two of its rows still meet in one of them.

Vectors travel once per group of mutual candidates, not once per pair: the pair (a, b) is verified in the block of a's
smallest candidate, and blocks are split by a's hash where they grow large. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._text import by_group

DIM = 512
#: Coordinates in a hash block (64 cells of signed axes).
BLOCK = 32
#: Cells of a table that a vector stands in, by the blocks joined; axes per block considered for them.
PROBES, AXES = {2: 6, 3: 12, 4: 24}, 6
#: Likeliest axes of the further block that travel with a row.
NEAR = 8
SKETCH_WORDS = 8
#: Standard deviations of the sketch's error that a pair at the least cosine may fall behind and still be verified.
SLACK = 2.3
#: The same for the first two words of the sketch, which are compared first.
FIRST_SLACK = 3.5
#: Modelled odds that a pair at the least cosine is found; the tables are set by it.
RECALL = 0.94
#: Rows in a cell from which it is divided by a further block, that indexing aims at most at, and that a task takes.
SMALL, CELL, HOT = 4096, 65_536, 262_144
#: Cells of more than HOT rows that are sent to all tasks; beyond it they are joined.
HOT_CELLS = 200_000
#: The filter of vectors with candidates has at most 2 ** FILTER_BITS bits (8 MB); beyond about 8 M vectors it lets more through.
FILTER_BITS = 26
#: Pairs verified at once in a task, and pairs after which a block is split.
VERIFY, BLOCK_PAIRS = 20_000, 50_000
#: Rows compared at once.
TILE = 64, 2048


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return (h / np.sqrt(n)).astype(np.float32)


class Rotation:
    """Three rounds of random signs and a Hadamard transform of a power-of-two dimension; shorter vectors are padded."""

    def __init__(self, dim: int, seed: int):
        self.dim = 1 << max(5, (dim - 1).bit_length())
        a = 1 << (self.dim.bit_length() - 1) // 2
        self.left, self.right = _hadamard(self.dim // a), _hadamard(a)
        self.signs = np.random.default_rng([seed, dim]).choice(np.array([-1, 1], np.float32), (3, self.dim))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.dim), np.float32)
        y[:, : x.shape[1]] = x
        for s in self.signs:
            z = (y * s).reshape(len(x), len(self.left), len(self.right))
            y = np.matmul(self.left, np.matmul(z, self.right)).reshape(len(x), self.dim)
        return y


def usable(arr: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector has dim entries, none null, NaN or infinite, and is not all zero; those vectors)."""
    size = np.asarray(arr.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    flat = arr.take(pa.array(rows)).flatten()
    x = np.array(flat.to_numpy(zero_copy_only=False), np.float32).reshape(len(rows), dim)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    if flat.null_count:
        ok &= ~np.asarray(flat.is_null()).reshape(len(rows), dim).any(1)
    return rows[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None]).astype(np.float32)


def class_of(x: np.ndarray) -> np.ndarray:
    """A hash of each vector; equal vectors are one class."""
    bits = np.ascontiguousarray(x + np.float32(0)).view(np.uint32).astype(np.uint64)
    factor = np.random.default_rng(7).integers(1, 2**63 - 1, x.shape[1], dtype=np.uint64) | np.uint64(1)
    h = ((bits + np.uint64(1)) * factor).sum(1, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


class Hasher:
    def __init__(self, dim: int, blocks: int = 2, tables: int = 4, probes: int | None = None):
        self.blocks, self.tables, self.probes = blocks, tables, probes or PROBES[blocks]
        per = (1 << max(5, (dim - 1).bit_length())) // BLOCK
        self.rotations = [Rotation(dim, s) for s in range(-(-tables * (blocks + 1) // per))]
        self.sketchers = [Rotation(dim, 99)]
        while sum(r.dim for r in self.sketchers) < SKETCH_WORDS * 64:
            self.sketchers.append(Rotation(dim, 100 + len(self.sketchers)))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        y = np.concatenate([r(x) for r in self.sketchers], axis=1)[:, : SKETCH_WORDS * 64]
        return np.packbits(y > 0, axis=1, bitorder="little").view(np.int64)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((rows, tables, probes) cell numbers, likeliest first; (rows, tables, NEAR) axes of the further block)."""
        y = np.concatenate([r(x) for r in self.rotations], axis=1)[:, : self.tables * (self.blocks + 1) * BLOCK]
        y = y.reshape(len(x), self.tables, self.blocks + 1, BLOCK)
        size = np.abs(y)
        most = max(AXES, NEAR)
        axes = np.argpartition(-size, most - 1, axis=3)[..., :most]
        top = np.take_along_axis(size, axes, 3)
        order = np.argsort(-top, axis=3, kind="stable")
        axes, top = np.take_along_axis(axes, order, 3), np.take_along_axis(top, order, 3)
        codes = axes * 2 + (np.take_along_axis(y, axes, 3) < 0)
        near = codes[:, :, -1, :NEAR].astype(np.uint8)
        code, top = codes[..., :AXES], top[..., :AXES]
        lost = (top[..., :1] - top) ** 2  # how far an axis is from being the nearest
        cell, cost = code[:, :, 0, :].astype(np.int64), lost[:, :, 0, :]
        for b in range(1, self.blocks):
            cell = (cell[..., :, None] * (2 * BLOCK) + code[:, :, b, None, :]).reshape(len(x), self.tables, -1)
            cost = (cost[..., :, None] + lost[:, :, b, None, :]).reshape(len(x), self.tables, -1)
            if cell.shape[2] > 4 * self.probes:
                best = np.argsort(cost, axis=2, kind="stable")[..., : 4 * self.probes]
                cell, cost = np.take_along_axis(cell, best, 2), np.take_along_axis(cost, best, 2)
        best = np.argsort(cost, axis=2, kind="stable")[..., : self.probes]
        return np.take_along_axis(cell, best, 2) * self.tables + np.arange(self.tables)[None, :, None], near


def most_bits(least_cosine: float, slack: float = SLACK, words: int = SKETCH_WORDS) -> int:
    n = words * 64
    p = float(np.arccos(least_cosine) / np.pi)
    return int(n * p + slack * np.sqrt(n * p * (1 - p)))


def blocks_for(n: int) -> int:
    """Blocks joined in a table, so that a cell has CELL rows at most on average; from 45 million vectors three."""
    return next((b for b, p in PROBES.items() if n * p <= CELL * (2 * BLOCK) ** b), max(PROBES))


@lru_cache
def tables_for(dim: int, blocks: int, least: float, pairs: int = 2000) -> int:
    """Tables that find a pair at the least cosine with odds of RECALL at any size of cells, by hashing random pairs at that
    cosine: a table finds it if the two share a cell and the further block does not part them."""
    rng = np.random.default_rng([dim, blocks])
    x, z = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= np.einsum("ij,ij->i", x, z)[:, None] * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    x, y = x.astype(np.float32), (least * x + np.sqrt(1 - least * least) * z).astype(np.float32)
    hasher = Hasher(dim, blocks, 6)
    (a, near_a), (b, near_b) = hasher.cells(x), hasher.cells(y)
    met = np.zeros(a.shape[:2], bool)
    for k in range(a.shape[2]):
        met |= (b == a[:, :, k : k + 1]).any(2)
    met &= (near_b == near_a[:, :, :1]).any(2) | (near_a == near_b[:, :, :1]).any(2)
    apart = np.bitwise_count((hasher.sketch(x) ^ hasher.sketch(y)).view(np.uint64)).sum(1)
    need = min(0.99, RECALL / max(float((apart <= most_bits(least)).mean()), 1e-3))
    return max(2, int(np.ceil(np.log(1 - need) / np.log(1 - min(max(float(met.mean()), 1e-3), 0.99)))))


def _codes(vectors: DataFrame, dim: int, blocks: int, tables: int) -> DataFrame:
    """(id, c, s0.., cells, near) of every usable vector; cells is null for a vector that its task has seen before."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim, blocks, tables)
        seen = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                rows, x = usable(b.column("v"), dim)
                if not len(rows):
                    continue
                x = unit(x)
                c = class_of(x)
                new = np.zeros(len(c), bool)
                new[np.unique(c, return_index=True)[1]] = True
                new &= ~np.isin(c, seen)
                seen = np.concatenate([seen, c[new]])
                s, (cells, near) = hasher.sketch(x[new]), hasher.cells(x[new])
                words = [_spread(s[:, i], new) for i in range(SKETCH_WORDS)]
                lists = [_lists(m, new) for m in (cells.reshape(len(s), -1), near.reshape(len(s), -1).view(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(c), *words, *lists], names=["id", "c", *(f"s{i}" for i in range(SKETCH_WORDS)), "cells", "near"])

    return vectors.mapInArrow(run, f"id {kind}, c long, {', '.join(f's{i} long' for i in range(SKETCH_WORDS))}, cells array<long>, near array<long>")


def _spread(values: np.ndarray, where: np.ndarray) -> pa.Array:
    out = np.zeros(len(where), np.int64)
    out[where] = values
    return pa.array(out, mask=~where)


def _lists(m: np.ndarray, where: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(where * m.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(m.ravel()), mask=pa.array(~where))


def _near_in_sketch(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of x and y whose sketches are near enough; i < j if both are the same rows."""
    first, every = most_bits(least, FIRST_SLACK, 2), most_bits(least)
    out = []
    for i in range(0, len(x), TILE[0]):
        a = x[i : i + TILE[0]]
        for j in range(i if same else 0, len(y), TILE[1]):
            b = y[j : j + TILE[1]]
            d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
            d += np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])
            p, q = np.nonzero(d <= first)
            if same:
                later = p + i < q + j
                p, q = p[later], q[later]
            ok = np.bitwise_count(a[p] ^ b[q]).sum(1, dtype=np.int64) <= every
            out.append((p[ok] + i, q[ok] + j))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _divided(x: np.ndarray, y: np.ndarray, near_x: np.ndarray, near_y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The same over large cells, where the nearest axis of one is among the likeliest of the other; i and j in any order."""
    out = []
    for axis in range(2 * BLOCK):
        for one, other in ((near_x[:, :1], near_y), (near_x, near_y[:, :1])):
            i, j = (np.flatnonzero((m == axis).any(1)) for m in (one, other))
            if len(i) and len(j):
                p, q = _near_in_sketch(x[i], y[j], least, False)
                out.append((i[p], j[q]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _meet(codes: DataFrame, least: float, small: int, hot: int) -> DataFrame:
    """(a, b), a < b, distinct: classes that share a cell and whose sketches are near."""
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]
    indexed = codes.where("cells is not null")
    per = F.size("cells") / F.size("near")
    rows = indexed.select("c", *sketch, "near", per.cast("int").alias("per"), F.posexplode("cells").alias("place", "cell")).select("c", *sketch, F.get("near", F.floor(F.col("place") / F.col("per")).cast("int")).alias("near"), "cell")
    full = indexed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("cell", F.ceil(F.col("n") / hot).cast("int").alias("parts")).persist()
    n_full = full.count()
    if n_full:
        # a row of a full cell belongs to one of its parts and goes to the task of every pair of parts with its own
        rows = rows.join(F.broadcast(full) if n_full <= HOT_CELLS else full, "cell", "left").withColumn("part", F.pmod("c", F.coalesce("parts", F.lit(1))).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        low, high = F.least("part", "other"), F.greatest("part", "other")
        side = F.when(low == high, 0).when(F.col("part") == low, 1).otherwise(2)
        task = F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", low, high))
    else:
        side, task = F.lit(0), F.col("cell")
    rows = rows.select(F.shiftleft(task, 2).bitwiseOR(side.cast("long")).alias("task"), "c", "near", *sketch)

    def work(t: pa.Table) -> pa.RecordBatch:
        task, c, near = (t.column(n).to_numpy() for n in ("task", "c", "near"))
        s = np.stack([t.column(n).to_numpy() for n in sketch], 1).view(np.uint64)
        near = np.ascontiguousarray(near).view(np.uint8).reshape(len(c), NEAR)
        edge = np.flatnonzero(np.concatenate([[True], task[1:] >> 2 != task[:-1] >> 2, [True]]))
        found = []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo < 2:
                continue
            one = lo + np.unique(c[lo:hi], return_index=True)[1]
            side = task[one] & 3
            x, y = (one, one) if not side.any() else (one[side == 1], one[side == 2])
            if len(x) * len(y) <= small * small:
                i, j = _near_in_sketch(s[x], s[y], least, x is y)
            else:
                i, j = _divided(s[x], s[y], near[x], near[y], least)
            found.append(np.stack([c[x[i]], c[y[j]]], 1))
        p = np.concatenate([*found, np.empty((0, 2), np.int64)])
        p.sort(axis=1)
        p = p[p[:, 0] != p[:, 1]]
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        p = p[np.concatenate([[True], (p[1:] != p[:-1]).any(1)])] if len(p) else p
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(_cells_only(batches), "cell", 200_000):
            yield work(t)

    # all sides of a task stand together
    placed = rows.withColumn("cell", F.shiftright("task", 2)).repartition("cell").sortWithinPartitions("cell").drop("cell")
    return placed.mapInArrow(run, "a long, b long").distinct()


def _cells_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.append_column("cell", pa.array(b.column("task").to_numpy() >> 2))


def _packed(x: np.ndarray) -> list[bytes]:
    """Each row's numbers, byte by byte (all first bytes, all second ones, ...), compressed without loss: the low bytes of
    numbers that were once shorter are zero, and high bytes repeat."""
    codec = pa.Codec("zstd", compression_level=1)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1)).reshape(len(x), -1)
    return [codec.compress(r, asbytes=True) for r in planes]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    codec = pa.Codec("zstd")
    planes = np.frombuffer(b"".join(codec.decompress(r, decompressed_size=4 * dim, asbytes=True) for r in rows), np.uint8).reshape(-1, 4, dim)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.float32).reshape(-1, dim)


def _verify(rows: DataFrame, dim: int, least: float) -> DataFrame:
    """(a, b, cosine) of rows sorted by block: vectors (block, a, v) and pairs (block, a, b)."""

    def work(t: pa.Table) -> pa.RecordBatch:
        block, a = t.column("block").to_numpy(), t.column("a").to_numpy()
        v = t.column("v").combine_chunks()
        has = np.asarray(v.is_valid())
        x = unit(_unpacked(v.filter(pa.array(has)).to_pylist(), dim))
        b = t.column("b").filter(pa.array(~has)).to_numpy()
        group = np.unique(block, return_inverse=True)[1]
        order = np.lexsort((a[has], group[has]))
        kg, ka = group[has][order], a[has][order]
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        key = kg * len(ids) + where[: len(a)][has][order]
        pg = group[~has] * len(ids)
        i, j = np.searchsorted(key, pg + where[: len(a)][~has]), np.searchsorted(key, pg + where[len(a) :])
        cos = np.empty(len(i))
        for s in range(0, len(i), VERIFY):
            cos[s : s + VERIFY] = np.einsum("ij,ij->i", x[order[i[s : s + VERIFY]]], x[order[j[s : s + VERIFY]]], dtype=np.float64)
        ok = cos >= least - 1e-7
        return pa.RecordBatch.from_arrays([pa.array(a[~has][ok]), pa.array(b[ok]), pa.array(np.round(cos[ok], 7))], names=["a", "b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_group(batches, "block", VERIFY):
            yield work(t)

    return rows.mapInArrow(run, "a long, b long, cosine double")


def similar_pairs(vectors: DataFrame, id: str = "chunk_id", vector: str = "embedding", dim: int = DIM, k: int = 10, least: float = 0.75, expected: int | None = None, small: int = SMALL, hot: int = HOT) -> DataFrame:
    """(id_1, id_2, cosine): pairs of which one is among the other's k most similar vectors with at least the least cosine.

    Ties: smaller id first. A vector is usable if it has dim entries, none null or NaN, and is not all zero; others, and null
    ids, take no part. Rows of one id are one vector. expected: the number of vectors, counted if not given.
    """
    rows = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("v")).where("id is not null and v is not null")
    n = expected or vectors.count()
    blocks = blocks_for(n)
    codes = _codes(rows, dim, blocks, tables_for(dim, blocks, least)).persist()
    members = codes.select("id", "c").distinct()
    pairs = _meet(codes, least, small, hot).persist()

    # a fixed-size filter of the vectors that have candidates, so that the others are not shuffled
    bits = 1 << min(FILTER_BITS, max(16, int(8 * n).bit_length()))
    place = F.pmod(F.col("c"), F.lit(bits))
    words = pairs.select(F.explode(F.array("a", "b")).alias("c")).groupBy((place / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(c, 64) as int)))").alias("m")).toPandas()
    maybe = np.zeros(bits // 64, np.int64)
    maybe[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    sent_filter = vectors.sparkSession.sparkContext.broadcast(maybe)

    turned = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = pairs.select(F.explode(turned).alias("x")).select("x.a", "x.b").groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("lead"))
    placed = pairs.join(lead, "a")
    load = placed.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK_PAIRS).alias("parts"))
    placed = placed.join(load, "lead").select("a", "b", F.xxhash64("lead", F.when(F.col("parts") > 1, F.pmod(F.hash("a"), F.col("parts"))).otherwise(0)).alias("block")).persist()
    needed = placed.select("block", F.explode(F.array("a", "b")).alias("a")).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent_filter.value
        seen = np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ok, x = usable(batch.slice(at, 2048).column("v"), dim)
                if len(ok):
                    c = class_of(unit(x))
                    place = c % bits
                    keep = (held[place >> 6] >> (place & 63)) & 1 == 1
                    first = np.zeros(len(c), bool)
                    first[np.unique(c, return_index=True)[1]] = True
                    keep &= first & ~np.isin(c, seen)  # a task sends one of equal vectors
                    seen = np.concatenate([seen, c[keep]])
                    yield pa.RecordBatch.from_arrays([pa.array(c[keep]), pa.array(_packed(x[keep]), pa.binary())], names=["a", "v"])

    held = rows.select("v").mapInArrow(packed, "a long, v binary")
    sent = needed.join(held, "a").select("block", "a", F.lit(None).cast("long").alias("b"), "v")
    both = sent.unionByName(placed.select("block", "a", "b", F.lit(None).cast("binary").alias("v")))
    cos = _verify(both.repartition("block").sortWithinPartitions("block"), dim, least)

    # a class's k + 1 smallest members stand for it as neighbours; every member is a query
    w = Window.partitionBy("c").orderBy("id")
    first = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    near = cos.select(F.explode(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))).alias("x")).select("x.*")
    # of a class's neighbours only the k + 1 best by cosine, with all ties, can hold its k best vectors
    near = near.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cosine")))).where(F.col("r") <= k + 1).drop("r")
    itself = first.where("n = 2").select(F.col("c").alias("a"), F.col("c").alias("b"), F.lit(1.0).alias("cosine"))
    named = near.unionByName(itself).join(first.select(F.col("c").alias("b"), F.col("id").alias("id_b")), "b")
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "id_b"))).where(F.col("r") <= k + 1).select("a", "cosine", "id_b")
    mine = ranked.join(members.select(F.col("c").alias("a"), F.col("id").alias("id_a")), "a").where("id_a <> id_b")
    kept = mine.withColumn("r", F.row_number().over(Window.partitionBy("a", "id_a").orderBy(F.desc("cosine"), "id_b"))).where(F.col("r") <= k)
    return kept.groupBy(F.least("id_a", "id_b").alias("id_1"), F.greatest("id_a", "id_b").alias("id_2")).agg(F.max("cosine").alias("cosine"))
