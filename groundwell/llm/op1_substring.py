"""Substring dedup with repeated-phrase automata.

A *window* is ``WINDOW`` consecutive words (runs of anything but ASCII white
space) of one document.  Every word covered by a window whose word sequence
starts anywhere else, in the same document or another, is removed.

1. Winnowing picks from every window the position of its least ``GRAM``-word
   hash (its *anchor*).  Equal windows pick equal anchors, so only anchors whose
   hash is seen twice can hold recurring windows.
2. Every recurring anchor occurrence ships the words of the windows that it
   anchors to the shard of its hash.  Hot anchors are dealt over several salts.
3. A shard confirms the windows that recur, compiles Aho-Corasick automata of
   confirmed passages (word ids as symbols) and streams all its contexts
   through them to locate every occurrence.
4. Windows of a salted anchor that are alone in their shard are settled by
   counting their 128-bit hashes over all shards.

Inside, a row's name is its doc_id and its ``mark``, a hash of its text: rows that
repeat an id with another text are documents of their own, and rows that agree in
both are copies, whose windows all recur.  A text may have any length; equal least
hashes are settled by the leftmost.  A null text and a text without words have no
windows.  Rows without a doc_id are left out.  An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .storage import documents, materialise, read_table, small_batches

WINDOW = 35
GRAM = 8
#: Contexts of one anchor that go to one shard.
SALT_ROWS = 2048
#: Occurrences in one batch from which an anchor's rows stand apart.
HOT = 32
#: Contexts compiled into one automaton; bounds its memory.
SHARD_ROWS = 12_000


def _window_anchors(words: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts (word indexes), their anchors' word indexes, the gram hashes."""
    grams = K.gram_hashes(words.hash, gram)
    at = K.sliding_argmin(grams, window - gram + 1)
    start = np.arange(len(at))
    whole = words.doc[: len(at)] == words.doc[window - 1 : window - 1 + len(at)]
    return start[whole], at[whole], grams


PLAIN, APART, NOTICE = range(3)


def _anchor_rows(window: int, gram: int, hot: int):
    """Anchor occurrences, by a key that groups them.

    The key is the anchor's hash; but an anchor seen ``hot`` times or more in
    one batch is known to recur: its rows stand apart under a key of their own,
    and one notice goes to the anchor's key.  So a hot anchor brings less than
    ``hot`` rows a batch to its key.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
            parts = []
            for low, high in K.doc_blocks(offs):
                words = K.split_words(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low])
                _, at, grams = _window_anchors(words, window, gram)
                at = at[np.diff(at, prepend=-1) != 0]
                doc = words.doc[at]
                parts.append((grams[at], ids[low + doc], marks[low + doc], (at - words.first[doc]).astype(np.int32)))
            if not parts or not sum(len(p[0]) for p in parts):
                continue
            key, doc, mark, pos = (np.concatenate(p) for p in zip(*parts, strict=True))
            new, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            apart = count[inverse] >= hot
            seed = K.combine(doc[:1].view(K.U64), mark[:1].view(K.U64))  # another one for each batch
            known = new[count >= hot]
            n = len(known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(K.signed(np.concatenate([np.where(apart, K.combine(key, np.broadcast_to(seed, key.shape)), key), known]))),
                    pa.array(np.concatenate([np.where(apart, APART, PLAIN), np.full(n, NOTICE)]).astype(np.int32)),
                    *[pa.array(np.concatenate([x, np.zeros(n, x.dtype)])) for x in (doc, mark, pos)],
                ],
                ["key", "kind", "doc_id", "mark", "pos"],
            )

    return rows


def _recurring(salt_rows: int):
    """Of rows sorted by key, those whose anchor occurs twice or more, dealt over salts.

    Streams: at most ``salt_rows`` rows of one key are held back.  ``split``
    rows belong to an anchor that has rows elsewhere too.
    """

    def emit(table: pa.Table, before: int) -> Iterator[pa.RecordBatch]:
        """``before``: rows of the leading key that went out earlier."""
        if not table.num_rows:
            return
        key, kind = table.column("key").to_numpy(), table.column("kind").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(new, len(key)))
        rank = np.arange(len(key)) - np.repeat(new, size)
        noticed = np.repeat(kind[new] != PLAIN, size)  # notices are sorted first
        size = np.repeat(size, size)
        lead = key == key[0]
        rank[lead] += before
        size[lead] += before
        keep = (size > 1) & (kind != NOTICE)
        if keep.any():
            part = table.filter(pa.array(keep)).combine_chunks()
            salt = rank[keep] // salt_rows + np.where(kind[keep] == APART, (key[keep] & 0x3FFFFFFF) + 1, 0)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).combine_chunks() for c in ("doc_id", "mark", "pos")], pa.array(salt.astype(np.int32)), pa.array((size[keep] > salt_rows) | noticed[keep])],
                ["doc_id", "mark", "pos", "salt", "split"],
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the last key that wait
        last, sent = None, 0  # rows of the last key that went out
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            key = table.column("key").to_numpy()
            if key[0] != last:
                sent = 0
            tail = int(np.searchsorted(key, key[-1]))
            if tail:
                yield from emit(table.slice(0, tail), sent)
                sent = 0
            held, last = table.slice(tail), key[-1]
            if held.num_rows + sent > salt_rows:
                yield from emit(held, sent)
                sent += held.num_rows
                held = None
        if held is not None:
            yield from emit(held, sent)

    return rows


def _context_rows(window: int, gram: int):
    """Of each document with recurring anchors, the words around each of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            ids, marks = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
            hits = batch.column("hits")
            h_offs = hits.offsets.to_numpy()
            flat = hits.values
            pos, salt, split = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for low, high in K.doc_blocks(offs):
                block = data[offs[low] : offs[high]]
                words = K.split_words(block, offs[low : high + 1] - offs[low])
                start, at, grams = _window_anchors(words, window, gram)
                own = slice(h_offs[low], h_offs[high])
                doc = np.repeat(np.arange(high - low), np.diff(h_offs[low : high + 1]))
                wanted = words.first[doc] + pos[own]  # word indexes of anchors
                left = np.searchsorted(at, wanted, "left")
                known = wanted < words.first[doc + 1]
                known[known] = at[np.minimum(left[known], len(at) - 1)] == wanted[known] if len(at) else False
                doc, wanted, left = doc[known], wanted[known], left[known]
                right = np.searchsorted(at, wanted, "right")
                first, last = start[left], start[right - 1]
                whole = block.tobytes()
                texts = [b" ".join(whole[a:b].split()) for a, b in zip(words.start[first].tolist(), words.end[last + window - 1].tolist(), strict=True)]
                if texts:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(K.signed(grams[wanted])),
                            pa.array(salt[own][known].astype(np.int32)),
                            pa.array(split[own][known]),
                            pa.array(ids[low + doc]),
                            pa.array(marks[low + doc]),
                            pa.array((first - words.first[doc]).astype(np.int32)),
                            pa.array(texts, pa.binary()),
                        ],
                        ["anchor", "salt", "split", "doc_id", "mark", "first", "context"],
                    )

    return rows


def _runs(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within one group."""
    n = len(flags)
    edge = np.ones(n, dtype=bool)
    edge[1:] = group[1:] != group[:-1]
    begin = flags & (edge | ~np.concatenate([[False], flags[:-1]]))
    over = np.ones(n, dtype=bool)
    over[:-1] = edge[1:]
    end = flags & (over | ~np.concatenate([flags[1:], [False]]))
    return np.flatnonzero(begin), np.flatnonzero(end)


def _locate(window: int, shard_rows: int):
    """Confirm, compile and stream, for the whole groups of one partition.

    Rows out: ranges of covered words (kind 0), and of split anchors the hashes
    of windows to be settled over all shards (kind 1).
    """

    def shard(contexts: list[bytes], doc: np.ndarray, mark: np.ndarray, first: np.ndarray, split: np.ndarray) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids = [[known.setdefault(w, len(known)) for w in c.split(b" ")] for c in contexts]
        size = np.array([len(x) for x in ids])
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.fromiter((y for x in ids for y in x), dtype=np.int64, count=int(begin[-1]))
        with np.errstate(over="ignore"):
            value = K.gram_hashes(K.mix(flat.astype(K.U64) + K.U64(1)), window)
        n = size - window + 1  # windows of each context
        ctx = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(ctx)) - np.repeat(np.cumsum(n) - n, n)
        where = begin[ctx] + off
        _, inverse, count = np.unique(value[where], return_inverse=True, return_counts=True)
        confirmed = count[inverse] > 1
        one, two = _runs(confirmed, ctx)
        # the first and the last window of a run cover all of it: a context has at most WINDOW windows
        automaton, passages = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        for w in np.unique(np.concatenate([one, two])).tolist():
            key = tuple(ids[ctx[w]][off[w] : off[w] + window])
            if key not in automaton:
                automaton.add_word(key, passages)
                passages += 1
        out: list[tuple[int, int, int]] = []
        if passages:
            automaton.make_automaton()
            for k in np.unique(ctx[confirmed]).tolist():
                out.extend((k, at - window + 1, p) for at, p in automaton.iter(tuple(ids[k])))
        if out:
            k, at, p = np.array(out).T
            twice = np.bincount(p, minlength=passages)[p] > 1
            k, at = k[twice], at[twice]
            zeros = np.zeros(len(k), np.int64)
            yield _located(0, doc[k], mark[k], first[k] + at, zeros, zeros)
        rest = split[ctx]
        if rest.any():  # alone here, or the first of those that recur here
            rep = np.zeros(len(ctx), dtype=bool)
            rep[np.unique(inverse, return_index=True)[1]] = True
            w = np.flatnonzero(rest & rep)
            names = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in known), dtype=np.int64).reshape(-1, 2)
            h = [K.signed(K.gram_hashes(K.mix(names[flat, j].astype(K.U64)), window)[where[w]]) for j in (0, 1)]
            yield _located(1, doc[ctx[w]], mark[ctx[w]], first[ctx[w]] + off[w], *h)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, ["anchor", "salt"], shard_rows):
            yield from shard(table.column("context").to_pylist(), *[table.column(c).to_numpy() for c in ("doc_id", "mark", "first", "split")])

    return rows


def _located(kind: int, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), pa.array(mark), pa.array(start.astype(np.int32)), pa.array(h1), pa.array(h2)],
        ["kind", "doc_id", "mark", "start", "h1", "h2"],
    )


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, salt_rows: int = SALT_ROWS, shard_rows: int = SHARD_ROWS, hot: int = HOT) -> DataFrame:
    """``(doc_id, mark, start)`` of windows that together cover all recurring ones.

    ``start`` counts words; each row stands for ``window`` words from there.
    """
    if not 1 <= gram <= window or window < 2:
        raise ValueError("gram must be between 1 and window, window at least 2")
    docs = _marked(docs)
    anchors = docs.mapInArrow(_anchor_rows(window, gram, hot), "key long, kind int, doc_id long, mark long, pos int")
    recurring = anchors.repartition("key").sortWithinPartitions("key", F.desc("kind")).mapInArrow(_recurring(salt_rows), "doc_id long, mark long, pos int, salt int, split boolean")
    hits = recurring.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("pos", "salt", "split"))).alias("hits"))
    contexts = docs.join(hits, ["doc_id", "mark"]).select("doc_id", "mark", "text", "hits").mapInArrow(_context_rows(window, gram), "anchor long, salt int, split boolean, doc_id long, mark long, first int, context binary")
    shards = contexts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = materialise(shards.mapInArrow(_locate(window, shard_rows), "kind int, doc_id long, mark long, start int, h1 long, h2 long"), "op1-located")
    alone = found.where("kind = 1")
    twice = alone.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return found.where("kind = 0").select("doc_id", "mark", "start").union(alone.join(twice, ["h1", "h2"]).select("doc_id", "mark", "start"))


def _marked(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("mark", F.xxhash64("text"))


def _cut(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = (text or "").encode().split()
                removed = 0
                if starts:
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    at = np.array(starts)
                    at = at[at + window <= len(words)]
                    np.add.at(step, at, 1)
                    np.add.at(step, at + window, -1)
                    clear = np.cumsum(step)[:-1] == 0
                    removed = len(words) - int(clear.sum())
                    words_kept = [words[i] for i in np.flatnonzero(clear).tolist()]
                else:
                    words_kept = words
                n_words.append(len(words))
                n_removed.append(removed)
                kept.append(b" ".join(words_kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows


def remove_repeats(docs: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: every document without its repeated words.

    ``kept`` is the UTF-8 text of the remaining words, joined by one space.
    """
    starts = repeated_windows(docs, window, **options).groupBy("doc_id", "mark").agg(F.collect_set("start").alias("starts"))
    joined = _marked(docs).join(starts, ["doc_id", "mark"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    kept = remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
