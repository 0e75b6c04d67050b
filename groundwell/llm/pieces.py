"""Word pieces of a byte-level BPE without regular expressions.

The split is that of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Every code point becomes a symbol (its class, with what the pattern's look-ahead
needs folded in).  A symbol is a function on eight states; composing functions
is associative, so the state before every code point comes from a blocked scan:
compose within blocks, scan the blocks' functions, then fill the blocks.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np

from . import textkit as K

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Unicode white space, a fixed list.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# symbols: letter, number, other as above; then
LAST_BLANK, LAST_SPACE, MORE_SPACE, SHORT_FORM, LONG_FORM = 3, 4, 5, 6, 7
N_SYMBOLS = 8
# states: what the running piece is
END, BLANK, SPACES, LETTERS, NUMBERS, OTHERS, TWO_LEFT, ONE_LEFT = range(8)


@functools.lru_cache(maxsize=None)
def class_table() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[_SPACES] = SPACE
    return table


@functools.lru_cache(maxsize=None)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and border flag by (symbol, state), flat; symbols from 8 on begin a document."""
    step = np.zeros((2 * N_SYMBOLS, 8), np.uint8)
    border = np.ones((2 * N_SYMBOLS, 8), bool)
    joins = {LETTER: (LETTERS, {BLANK, LETTERS}), NUMBER: (NUMBERS, {BLANK, NUMBERS}), OTHER: (OTHERS, {BLANK, OTHERS}), MORE_SPACE: (SPACES, {SPACES})}
    for symbol, (to, from_) in joins.items():
        step[symbol] = to
        border[symbol, list(from_)] = False
    for state, to in ((TWO_LEFT, ONE_LEFT), (ONE_LEFT, END)):  # letters of 's, 'll and so on
        step[LETTER, state] = to
        border[LETTER, state] = False
    step[LAST_BLANK] = BLANK
    step[LAST_SPACE] = END
    for symbol, to in ((SHORT_FORM, ONE_LEFT), (LONG_FORM, TWO_LEFT)):
        step[symbol] = to
        step[symbol, [BLANK, OTHERS]] = OTHERS  # an apostrophe inside a piece is an ordinary sign
        border[symbol, [BLANK, OTHERS]] = False
    step[N_SYMBOLS:] = step[:N_SYMBOLS, [END]]
    return step.ravel(), border.ravel()


def symbols(points: np.ndarray, last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of every code point; ``first``/``last``: those that begin or end a document."""
    kind = class_table()[points]
    n = len(points)
    out = kind.copy()
    follows = np.empty(n, dtype=bool)  # by something other than white space, in the same document
    follows[:-1] = kind[1:] != SPACE
    follows[last] = False
    space = kind == SPACE
    out[space] = MORE_SPACE
    out[space & follows] = LAST_SPACE
    out[space & follows & (points == 0x20)] = LAST_BLANK
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        over = np.concatenate([points, np.zeros(2, points.dtype)])
        ends = np.zeros(n + 2, dtype=bool)
        ends[:n] = last
        one, two = over[quote + 1], over[quote + 2]
        here = ~ends[quote]
        short = here & np.isin(one, [ord(c) for c in "stmd"])
        pair = here & ~ends[quote + 1] & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        out[quote[pair]] = LONG_FORM
        out[quote[short]] = SHORT_FORM
    out[first] += N_SYMBOLS
    return out


SPAN = 64


def _compose(codes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For rows of symbols, the function of each whole row."""
    maps = np.tile(np.arange(8, dtype=np.uint8), (len(codes), 1))
    for k in range(codes.shape[1]):
        maps = step[(codes[:, k, None].astype(np.intp) << 3) + maps]
    return maps


def _entries(maps: np.ndarray) -> np.ndarray:
    """The state before each function when they are applied in turn, from END on."""
    n = len(maps)
    if n <= SPAN:
        out, state = np.zeros(n, np.uint8), 0
        for k in range(n):
            out[k] = state
            state = maps[k, state]
        return out
    rows = -(-n // SPAN)
    full = np.tile(np.arange(8, dtype=np.uint8), (rows * SPAN, 1))
    full[:n] = maps
    full = full.reshape(rows, SPAN, 8)
    whole = full[:, 0]
    for k in range(1, SPAN):
        whole = np.take_along_axis(full[:, k], whole, axis=1)
    state = _entries(whole)
    out = np.empty((rows, SPAN), np.uint8)
    at = np.arange(rows)
    for k in range(SPAN):
        out[:, k] = state
        state = full[at, k, state]
    return out.ravel()[:n]


def borders(codes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each symbol."""
    step, border = machine()
    n = len(codes)
    rows = -(-n // SPAN)
    grid = np.full(rows * SPAN, END, np.uint8)
    grid[:n] = codes
    grid = grid.reshape(rows, SPAN)
    state = _entries(_compose(grid, step))
    out = np.empty((rows, SPAN), bool)
    for k in range(SPAN):
        at = (grid[:, k].astype(np.intp) << 3) + state
        out[:, k] = border[at]
        state = step[at]
    return out.ravel()[:n]


def split_pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pieces of a block (with the end), and each document's first piece."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.searchsorted(at, offs)
    full = edge[:-1] < edge[1:]
    first = np.zeros(len(points), bool)
    first[edge[:-1][full]] = True
    last = np.zeros(len(points), bool)
    last[edge[1:][full] - 1] = True
    start = at[borders(symbols(points, last, first))]
    return np.append(start, len(data)), np.searchsorted(start, offs)


def flattened(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and concatenation of lists of ids."""
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return size, np.fromiter((x for y in lists for x in y), np.int32, int(size.sum()))


class PieceCoder:
    """Token ids of pieces, kept in a direct-mapped cache of bounded size.

    ``encode`` gives, of distinct pieces that are not in the cache, the number of
    ids of each and all ids in turn.
    """

    SLOTS = 1 << 19

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(self.SLOTS, K.U64)
        self.entry = np.zeros(self.SLOTS, np.int32)
        self.begin = np.zeros(1, np.int64)
        self.size = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        size, flat = self.encode(pieces)
        at = np.arange(len(self.begin), len(self.begin) + len(pieces))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, flat])
        return at

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block, each document's first id, the byte offset of each piece and its first id."""
        start, first = split_pieces(data, offs)
        n = len(start) - 1
        if len(self.begin) > 4 * self.SLOTS:
            self.reset()
        total, down = K.prefix_sums(data)
        with np.errstate(over="ignore"):
            key = K.mix((total[start[1:]] - total[start[:-1]]) * down[start[:-1]] + (start[1:] - start[:-1]).astype(K.U64) * K.U64(0xD1B54A32D192ED03)) | K.U64(1)
        slot = (key >> K.U64(45)).astype(np.int64)
        entry = self.entry[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            new, at, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            raw, where = data.tobytes(), miss[at]
            added = self._add([raw[a:b] for a, b in zip(start[where].tolist(), start[where + 1].tolist(), strict=True)])
            entry[miss] = added[inverse]
            self.key[slot[where]], self.entry[slot[where]] = new, added
        size = self.size[entry]
        ends = np.cumsum(size)
        out = np.repeat(self.begin[entry] - (ends - size), size) + np.arange(int(ends[-1]) if n else 0)
        begin = np.concatenate([[0], ends])
        return self.ids[out], begin[first], start, begin
