"""Arrow text as numpy code points: class tables, word hashes and batching shared by the operators here."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Tables are built one by one up to here; beyond it lie only Han extensions (letters) and unassigned or special code points.
TABLE_END = 0x20000
N_CODEPOINTS = 0x110000
#: Code points handled at once; bounds the memory of a Python worker whatever the batch holds.
SLICE_CODEPOINTS = 1_000_000

os.environ.setdefault("OMP_NUM_THREADS", "1")


def scan_rows(table: pa.RecordBatch | pa.Table, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about SLICE_CODEPOINTS bytes in total (one row at least)."""
    arr = table.column(column)
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return
    offsets = _offsets(arr)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_CODEPOINTS, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield table.slice(at, end - at)
        at = end


def _offsets(arr: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint32 code points of all rows one after another, row offsets). Null rows are empty.

    Bytes that are not UTF-8 become U+FFFD, row by row, so offsets stay right.
    """
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if len(arr) == 0:
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    off = _offsets(arr)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0] : off[-1]] if buf is not None else np.empty(0, np.uint8)
    off = off - off[0]
    try:
        text = data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    if len(text) == len(data):
        return data.astype(np.uint32), off
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), lead[off]


def to_strings(cp: np.ndarray, off: np.ndarray) -> pa.Array:
    """Code points and row offsets back to an Arrow string array, without a Python string per row."""
    cp = np.where((cp >= 0xD800) & (cp < 0xE000), np.uint32(0xFFFD), cp)
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])[off]
    data = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


@lru_cache(1)
def _mix_table() -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 2**63 - 1, N_CODEPOINTS, dtype=np.uint64) | np.uint64(1)


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case of each code point; where lower case has several code points, the first."""
    table = np.arange(N_CODEPOINTS, dtype=np.uint32)
    for i in range(TABLE_END):
        if not 0xD800 <= i < 0xE000:
            table[i] = ord(chr(i).lower()[0])
    return table


@lru_cache(1)
def alnum_table() -> np.ndarray:
    """True for letters and digits of every script."""
    table = np.zeros(N_CODEPOINTS, bool)
    for i in range(TABLE_END):
        table[i] = chr(i).isalnum()
    table[0x20000:0x32400] = True
    return table


@lru_cache(1)
def ascii_word_table() -> np.ndarray:
    """True for ASCII letters, digits and the low line."""
    table = np.zeros(N_CODEPOINTS, bool)
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z"), ("_", "_")):
        table[ord(a) : ord(b) + 1] = True
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words(cp: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, word offsets of the rows). Words are maximal runs of member code points, lower-cased; a row's end ends a word."""
    n = len(cp)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    low = lower_table()[cp]
    inside = member[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < n]
    first[edge] = inside[edge]
    where = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    at = np.searchsorted(where, starts)
    length = np.diff(np.append(at, len(where)))
    place = np.arange(len(where)) - np.repeat(at, length)
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
    value = _mix_table()[low[where]] * power[place]
    return mix64(np.add.reduceat(value, at)), np.searchsorted(starts, off)


def row_of(off: np.ndarray) -> np.ndarray:
    """The row of each element, given row offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def sliding_hash(tokens: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of width consecutive tokens within a row, offsets of the rows)."""
    count = np.maximum(np.diff(off) - width + 1, 0)
    new = np.concatenate([[0], np.cumsum(count)])
    total = int(new[-1])
    if total == 0:
        return np.empty(0, np.uint64), new
    at = np.arange(total) + np.repeat(off[:-1] - new[:-1], count)
    h = np.zeros(total, np.uint64)
    for k in range(width):
        h = (h ^ tokens[at + k]) * np.uint64(0x100000001B3 | (k * 2 << 44)) + np.uint64(k + 1)
    return mix64(h), new


def by_group(batches: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.Table]:
    """Tables of least rows or more of batches sorted by column, none of which ends within a group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            t = pa.Table.from_batches(held)
            key = t.column(column).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
            least = max(least, 2 * n) if not cut else least
    if n:
        yield pa.Table.from_batches(held)
