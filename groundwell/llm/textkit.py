"""Vectorised word and n-gram hashing over Arrow text columns (numpy only).

All functions work on a *block*: the UTF-8 bytes of some whole documents, one
after another, with the offsets of the documents.  Words are maximal runs of
bytes that are not separators; all separators are ASCII, so bytes and code
points agree about word borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
BLOCK_BYTES = 1 << 20


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs of anything but ASCII white space.
WHITE_SPACE = separators((0x09, 0x0D), (0x20, 0x20))
#: Words are runs of ASCII letters and digits (lower-cased) and non-ASCII characters.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BLOCK_BYTES)
            self.up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, _BASE_INV)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n+1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0]


def doc_blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes each."""
    low, n = 0, len(offs) - 1
    while low < n:
        high = int(np.searchsorted(offs, offs[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums with which ``(sums[b] - sums[a]) * down[a]`` hashes the bytes from a to b."""
    n = len(data)
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    return sums, down


@dataclass
class Words:
    start: np.ndarray  #: byte offset in the block
    end: np.ndarray
    doc: np.ndarray  #: document index in the block, ascending
    first: np.ndarray  #: n_docs+1 offsets into the words
    hash: np.ndarray


def split_words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = WHITE_SPACE, lower: bool = False) -> Words:
    """Words of a block with 64-bit hashes of their bytes."""
    n = len(data)
    if lower:
        data = LOWER[data]
    inside = ~sep[data]
    before = np.empty(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[:-1] = inside[1:]
    edges = offs[:-1]
    before[edges[edges < n]] = False
    edges = offs[1:] - 1
    after[edges[edges >= 0]] = False
    if n:
        before[0] = after[-1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    total, down = prefix_sums(data)
    with np.errstate(over="ignore"):
        value = (total[end] - total[start]) * down[start]
        value = mix(value + (end - start).astype(U64) * U64(0xD1B54A32D192ED03))
    return Words(start, end, doc, first, value)


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two equally long hash columns."""
    with np.errstate(over="ignore"):
        return mix(left * U64(0xA24BAED4963EE407) + right)


def gram_hashes(value: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive items from every position, by doubling.

    The result has ``len(value) - size + 1`` items (none if that is negative);
    runs over a document's end must be masked by the caller.
    """
    out, done, span, level = None, 0, 1, value
    while True:
        if size & span:
            part = level
            if out is None:
                out = part
            else:
                m = min(len(out), len(part) - done)
                if m <= 0:
                    return value[:0]
                out = combine(out[:m], part[done : done + m])
            done += span
        if done == size:
            return out[: max(0, len(value) - size + 1)]
        m = len(level) - span
        if m <= 0:
            return value[:0]
        level = combine(level[:m], level[span : span + m])
        span *= 2


def sliding_argmin(value: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of each ``width`` consecutive values."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = value, np.arange(len(value)), 1
    while span < width:
        step = min(span, width - span)
        m = len(best) - step
        take = best[step : step + m] < best[:m]
        best = np.where(take, best[step : step + m], best[:m])
        at = np.where(take, at[step : step + m], at[:m])
        span += step
    return at[:n]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Batches sorted by ``keys`` as tables of whole groups, of about ``rows`` rows or ``size`` bytes unless one group has more.

    Streams: no more than one such table and one batch are held.
    """
    held: list[pa.RecordBatch] = []
    n = n_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, n_bytes = n + batch.num_rows, n_bytes + batch.nbytes
        if n < rows and n_bytes < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = 0  # where the last group begins
        change = np.zeros(n, dtype=bool)
        for k in keys:
            value = table.column(k).to_numpy()
            change[1:] |= value[1:] != value[:-1]
        if change.any():
            cut = int(np.flatnonzero(change)[-1])
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut).combine_chunks()
        held, n, n_bytes = rest.to_batches(), n - cut, rest.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
