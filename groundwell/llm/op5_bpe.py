"""Byte-level BPE encoding and decoding, with vectorised pre-tokenisation.

Code-point classes and a scan of transition functions find the pieces
(:mod:`pieces`); distinct new pieces are merged together, all at once, and kept
in a bounded cache; the offsets of the pieces are kept for decoding single
stretches.  Ids are those of the ranks file: a piece that is a token is that
token, others merge their lowest-ranked pair first, the leftmost of equals.

A null text is the empty text, which has no tokens; a text of any length is encoded
whole, and equal texts have equal ids.  Rows without a doc_id are
left out; rows that repeat an id are encoded each; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textkit as K
from .pieces import PieceCoder, flattened
from .storage import documents, read_table, small_batches

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
NO_RANK = np.int64(1 << 40)


class Ranks:
    """A ranks file as lookup tables."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {v: k for k, v in self.rank.items()}
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 20) | b] = rank
        self.pair = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair.tolist()], np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NO_RANK)

    def _rank_at(self, rank: np.ndarray, tokens: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        """Set ``rank`` of the pairs that begin at ``at``."""
        rank[at[at == len(tokens) - 1]] = NO_RANK
        at = at[at < len(tokens) - 1]
        found = self.ranks_of(tokens[at], tokens[at + 1])
        rank[at] = np.where(owner[at] == owner[at + 1], found, NO_RANK)

    def one(self, piece: bytes) -> list[int]:
        """The merges of one piece, one by one."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NO_RANK:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.rank[p] for p in parts]

    def many(self, pieces: list[bytes]) -> list:
        """Ids of distinct pieces, merged side by side.

        A round merges every occurrence of each piece's lowest-ranked pair; if
        that makes a pair of a still lower rank, the piece is done one by one.
        """
        out: list = [None] * len(pieces)
        todo = []
        for k, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is None:
                todo.append(k)
            else:
                out[k] = (whole,)
        if not todo:
            return out
        raw = np.frombuffer(b"".join(pieces[k] for k in todo), np.uint8)
        tokens = self.of_byte[raw]
        owner = np.repeat(np.arange(len(todo)), [len(pieces[k]) for k in todo])
        odd: set[int] = set()
        least = np.full(len(todo), -1, np.int64)  # rank of the last merge
        rank = np.full(len(tokens), NO_RANK)  # of the pair that begins at each token
        self._rank_at(rank, tokens, owner, np.arange(len(tokens) - 1))
        while len(tokens):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            mine = owner[begin]
            odd.update(mine[best < least[mine]].tolist())
            over = best == NO_RANK
            size = np.diff(np.append(begin, len(tokens)))
            if over.any():
                ids = tokens.tolist()
                for k, a, n in zip(mine[over].tolist(), begin[over].tolist(), size[over].tolist(), strict=True):
                    out[todo[k]] = ids[a : a + n]
                go = np.repeat(~over, size)
                tokens, owner, rank = tokens[go], owner[go], rank[go]
                best, size, mine = best[~over], size[~over], mine[~over]
                if not len(tokens):
                    break
            least[mine] = best
            hit = rank == np.repeat(best, size)
            # of overlapping occurrences, every second one from the left
            new = hit & ~np.concatenate([[False], hit[:-1]])
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(new, place, -1))
            hit &= run % 2 == 0
            tokens = np.where(hit, rank, tokens)
            stay = ~np.concatenate([[False], hit[:-1]])
            tokens, owner, rank, hit = tokens[stay], owner[stay], rank[stay], np.flatnonzero(hit[stay])
            near = np.unique(np.concatenate([hit, hit[hit > 0] - 1]))
            self._rank_at(rank, tokens, owner, near)
        for k in odd:
            out[todo[k]] = self.one(pieces[todo[k]])
        return out


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@functools.lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(lambda pieces: flattened(ranks(path).many(pieces)))


def decode_ids(ids: list[int], path: str) -> bytes:
    table = ranks(path).bytes
    return b"".join([table[i] for i in ids])


def _blocks(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of documents: range, ids, first id of each, piece offsets and first ids.

    Ids that do not decode to the text (two pieces with one cache key) are made anew.
    """
    data, offs = K.text_bytes(batch.column("text"))
    for low, high in K.doc_blocks(offs):
        block, own = data[offs[low] : offs[high]], offs[low : high + 1] - offs[low]
        got = coder(path).block(block, own)
        if decode_ids(got[0].tolist(), path) != block.tobytes():
            got = PieceCoder(lambda pieces: flattened([ranks(path).one(p) for p in pieces])).block(block, own)
            if decode_ids(got[0].tolist(), path) != block.tobytes():
                raise RuntimeError("token ids do not decode to their text")
        yield low, high, *got


def _encode_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, ids, first, start, begin in _blocks(batch, path):
                piece = np.searchsorted(begin[:-1], first)  # first piece of each document
                shift = np.repeat(start[np.minimum(piece[:-1], len(start) - 1)], np.diff(piece))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        K.list_column(np.diff(first), pa.array(ids.astype(np.int32))),
                        K.list_column(np.diff(piece), pa.array((start[:-1] - shift).astype(np.int32))),
                        K.list_column(np.diff(piece), pa.array((begin[:-1] - np.repeat(first[:-1], np.diff(piece))).astype(np.int32))),
                    ],
                    ["doc_id", "ids", "piece_offsets", "piece_tokens"],
                )

    return rows


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, piece_offsets, piece_tokens)``: token ids, and for each
    piece its byte offset in the text and the index of its first token."""
    return documents(docs).mapInArrow(_encode_rows(path), "doc_id long, ids array<int>, piece_offsets array<int>, piece_tokens array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` as bytes, from ``(doc_id, ids)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(ids or [], path) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text binary")


def _digest_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, ids, first, _, _ in _blocks(batch, path):
                wire, plain = ids.astype("<u4"), ids.tolist()
                edges = first.tolist()
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(np.diff(first)),
                        pa.array([hashlib.sha256(wire[a:b]).hexdigest() for a, b in spans]),
                        pa.array([hashlib.sha256(decode_ids(plain[a:b], path)).hexdigest() for a, b in spans]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return rows


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and digest both: the ids never leave their task."""
    return documents(docs).mapInArrow(_digest_rows(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS_FILE))
