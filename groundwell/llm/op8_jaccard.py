"""N-gram Jaccard join with token-group matrices.

A document's tokens are its distinct word shingles.  Two documents link when
``100 * |A & B| >= percent * |A | B|``.

1. Documents with equal token sets are one class; the least id stands for it.
2. Similar documents are partitioned into *groups*.  Tokens have one order
   everywhere, rare ones first (by counts over all documents, kept in a table of
   ``COUNTERS`` hash counters).  Linked documents share one of their first
   ``n - ceil(percent % of n) + 1`` tokens (prefix filter; Chaudhuri et al., 2006).
   Of documents that share such a token, those are joined whose token
   histograms differ by no more than linked documents can; joined
   documents form a group, and no link leaves a group.
3. In a group, the token-group matrix has subgroups of documents and the union
   of their tokens, held by token.  A document opens a subgroup only if it shares
   at least ``percent`` % of its own tokens with the union, the bound for a link
   to any member; members already connected with it need no comparison.
4. Links and classes give components.

A group that is too large for one tile is parted first, in ``ROUNDS`` rounds: all
its documents are compared with one of them, its pivot, and fall into rings by
their Jaccard distance from it, as wide as the largest distance of a link.  By the
triangle inequality links lie within a ring or between neighbouring ones, and those
of the innermost ring are connected through the pivot.  So a group of near copies
is settled in linear time.  What is left is dealt into tiles of pairs of chunks,
those already connected or compared elsewhere apart, so no task holds a whole
group.

A text of any length is read whole.  Of ties the least id counts.  A null text or a text without words has an empty set and links with
nothing.  Rows without a doc_id are left out; rows that repeat an id count as
one class if their texts agree.  Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .components import connected_components
from .storage import documents, materialise, read_table, small_batches

#: Shingle words and similarity unless a caller says otherwise; the query says 3 and 90.
SHINGLE = 5
PERCENT = 80
#: Members and tokens of one chunk of a large group, about.
CHUNK = 1024
CHUNK_TOKENS = 400_000
#: Rounds of pivots for large groups.
ROUNDS = 2
#: Rows of whole buckets or tiles that a task holds at a time.
HELD = 2048
#: Counters of the table that orders tokens, a power of two; one byte each is sent to every task.
COUNTERS = 1 << 20
#: Cells of the token histogram of a document of up to ``DENSE`` tokens; longer ones have
#: twice as many for each doubling of their length.
CELLS = 64
DENSE = 1024
#: Documents with one token whose histograms are compared; more are joined as they are.
BUCKET = 1024
#: Counters of one row while the table is added up.
STRIPE = 4096


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the block's documents, sorted in each; offsets."""
    words = K.split_words(data, offs, lower=True)
    n_words = np.diff(words.first)
    grams = K.gram_hashes(words.hash, size)
    whole = words.doc[: len(grams)] == words.doc[size - 1 : size - 1 + len(grams)]
    doc, value = words.doc[: len(grams)][whole], grams[whole]
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        parts = [words.hash[words.first[d] : words.first[d + 1]] for d in short]
        alone = np.array([K.gram_hashes(p, len(p))[0] for p in parts], dtype=K.U64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, K.mix(alone + n_words[short].astype(K.U64))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(offs)))


def _stripe_rows(size: int):
    """Counts of the distinct tokens of each document of one partition, by hash, in stripes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            for low, high in K.doc_blocks(offs):
                value, _ = shingle_sets(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low], size)
                total += np.bincount(_counter(value), minlength=COUNTERS)
        if total.any():
            yield _stripes(range(COUNTERS // STRIPE), total.reshape(-1, STRIPE))

    return rows


def _counter(value: np.ndarray) -> np.ndarray:
    return (value >> K.U64(65 - COUNTERS.bit_length())).astype(np.int64)


def _stripes(names, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(names), pa.int32()), pa.array([c.tobytes() for c in counts], pa.binary())], ["stripe", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("stripe").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(raw, np.int64)
    if total:
        yield _stripes(total, total.values())


def token_ranks(docs: DataFrame, size: int) -> np.ndarray:
    """How common tokens are, by hash counter: four steps for each doubling of the count."""
    ranks = np.zeros(COUNTERS, np.uint8)
    stripes = docs.mapInArrow(_stripe_rows(size), "stripe int, counts binary").repartition("stripe").mapInArrow(_added, "stripe int, counts binary")
    for k, raw in stripes.toLocalIterator():
        ranks[k * STRIPE : (k + 1) * STRIPE] = 4 * np.log2(1 + np.frombuffer(raw, np.int64))
    return ranks


def prefix_keys(value: np.ndarray, first: np.ndarray, ranks: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many keys each document has, and its first tokens in the common order."""
    size = np.diff(first)
    length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((value, ranks[_counter(value)], doc))
    return length, value[order][np.arange(len(value)) - first[doc] < length[doc]]


def levels(size: np.ndarray) -> np.ndarray:
    """How often the cells of a document of so many tokens are doubled."""
    return np.frexp(np.maximum(size, 0) // DENSE)[1]


def histograms(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Tokens of each document in each cell, one byte a cell; linked documents differ in few cells."""
    size = np.diff(first)
    n_cells = CELLS << levels(size)
    begin = np.concatenate([[0], np.cumsum(n_cells)])
    doc = np.repeat(np.arange(len(size)), size)
    cell = begin[doc] + (K.mix(value) & (n_cells[doc] - 1).astype(K.U64)).astype(np.int64)
    flat = np.minimum(np.bincount(cell, minlength=begin[-1]), 255).astype(np.uint8).tobytes()
    return [flat[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _set_rows(size: int, percent: int, ranks: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            for low, high in K.doc_blocks(offs):
                value, first = shingle_sets(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low], size)
                n_keys, keys = prefix_keys(value, first, ranks.value, percent)
                with np.errstate(over="ignore"):
                    total = np.concatenate([np.zeros((2, 1), K.U64), np.cumsum([K.mix(value), K.mix(~value)], axis=1)], axis=1)
                    h1, h2 = (t[first[1:]] - t[first[:-1]] for t in total)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(first).astype(np.int64)), pa.array(K.signed(h1)), pa.array(K.signed(h2)), K.list_column(n_keys, pa.array(K.signed(keys))), pa.array(histograms(value, first), pa.binary())],
                    ["doc_id", "n_shingles", "h1", "h2", "keys", "cells"],
                )

    return rows


def _bucket_rows(limit: int):
    """Of rows sorted by (key, id), the buckets of one key, each set of ids once a batch.

    Rows out: (bucket, id), or of a key with more than ``limit`` rows (id, least):
    its ids beside the least of them.  Streams: at most ``limit`` rows of a key are held.
    """

    def batch_of(bucket: np.ndarray | None, ids: np.ndarray, least: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([none if bucket is None else pa.array(bucket), pa.array(ids), none if least is None else pa.array(least)], ["bucket", "id", "least"])

    def whole(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(new, len(key)))
        with np.errstate(over="ignore"):
            name = K.combine(np.add.reduceat(K.mix(ids.view(K.U64)), new), n.astype(K.U64))
        once = np.zeros(len(new), dtype=bool)
        once[np.unique(name, return_index=True)[1]] = True
        keep = np.repeat(once & (n > 1) & (n <= limit), n)
        if keep.any():
            yield batch_of(K.signed(np.repeat(name, n)[keep]), ids[keep], None)
        large = np.repeat(n > limit, n)
        if large.any():
            yield batch_of(None, ids[large], np.repeat(ids[new], n)[large])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the last key, that wait
        hot, least = None, 0  # the last key, if it has more rows than may wait
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([ids, batch.column("id").to_numpy()])
            if hot is not None:
                end = int(np.searchsorted(key, hot, "right"))
                if end:
                    yield batch_of(None, ids[:end], np.full(end, least))
                key, ids = key[end:], ids[end:]
                if not len(key):
                    continue
                hot = None
            tail = int(np.searchsorted(key, key[-1]))
            yield from whole(key[:tail], ids[:tail])
            key, ids = key[tail:], ids[tail:]
            if len(key) > limit:
                hot, least = key[0], ids[0]
                yield batch_of(None, ids, np.full(len(ids), least))
                key, ids = key[:0], ids[:0]
        yield from whole(key, ids)

    return rows


def joined_pairs(cells: list[bytes], size: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect all documents whose histograms allow a link."""
    level = levels(size)
    place = np.zeros(len(size), np.int64)
    own: dict[int, np.ndarray] = {}
    half: dict[int, np.ndarray] = {}  # cells as of the level below
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        place[at] = np.arange(len(at))
        own[k] = np.frombuffer(b"".join([cells[i] for i in at]), np.uint8).reshape(len(at), -1).astype(np.int16)
        half[k] = np.minimum(own[k].reshape(len(at), 2, -1).sum(1), 255).astype(np.int16)

    def apart(x: int, rest: np.ndarray) -> np.ndarray:
        """Whether a link of ``x`` to each of the rest is ruled out."""
        out, k = np.ones(len(rest), dtype=bool), int(level[x])
        for other in (k - 1, k, k + 1):  # sizes further apart can't link
            at = np.flatnonzero(level[rest] == other)
            if len(at):
                mine = (own if other >= k else half)[k][place[x]]
                theirs = (own if other <= k else half)[other][place[rest[at]]]
                differ = np.abs(theirs - mine).sum(1, dtype=np.int64)
                out[at] = (100 + percent) * differ > (100 - percent) * (size[rest[at]] + size[x])
        return out

    pairs, rest = [], np.arange(len(size))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            far = apart(x, rest)
            near = rest[~far].tolist()
            queue.extend(near)
            pairs.extend((y, x) for y in near)
            rest = rest[far]
    return pairs


def _edges(*keys: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of rows that agree in all keys, which are sorted."""
    change = np.ones(len(keys[0]) + 1, dtype=bool)
    change[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(change).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def _pairs(u: list[int], v: list[int]) -> Iterator[pa.RecordBatch]:
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _joined_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, ["bucket"], HELD):
            bucket, ids, size = (table.column(c).to_numpy() for c in ("bucket", "id", "n_shingles"))
            cells = table.column("cells").to_pylist()
            u: list[int] = []
            v: list[int] = []
            for low, high in _edges(bucket):
                for p, q in joined_pairs(cells[low:high], size[low:high], percent):
                    u.append(ids[low + p])
                    v.append(ids[low + q])
            yield from _pairs(u, v)

    return rows


def _token_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            for low, high in K.doc_blocks(offs):
                value, first = shingle_sets(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low], size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), batch.column("grp").slice(low, high - low), K.list_column(np.diff(first), pa.array(K.signed(value)))],
                    ["doc_id", "grp", "tokens"],
                )

    return rows


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def group_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets of one group (a spanning forest of them).

    ``side``: only links between its two values are wanted.  ``root``: sets with
    one value, other than -1, are connected already.
    """
    if not sets:
        return []
    flat, dense = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    sets = np.split(dense, cuts)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    forest, links = _Forest(len(sets)), []
    if root is not None:
        least: dict[int, int] = {}
        for k, r in enumerate(root.tolist()):
            forest.up[k] = k if r < 0 else least.setdefault(r, k)
    mark = np.zeros(len(flat), dtype=bool)
    subgroups: list[list[int]] = []  # members
    matrix: dict[int, list[int]] = {}  # token: the subgroups whose union holds it
    for x in order:
        mine, names = sets[x], sets[x].tolist()
        mark[mine] = True
        shared = Counter(chain.from_iterable(matrix.get(t, ()) for t in names))
        for k, n in shared.items():
            if 100 * n < percent * len(mine):
                continue  # no member can link
            members = subgroups[k]
            for j in range(len(members)):
                y = members[j]
                if 100 * len(sets[y]) < percent * len(mine) or (side is not None and side[x] == side[y]):
                    continue
                a, b = forest.root(x), forest.root(y)
                if a == b:
                    continue
                common = int(mark[sets[y]].sum())
                if 100 * common >= percent * (len(mine) + len(sets[y]) - common):
                    forest.up[a] = b
                    links.append((x, y))
                    if j:  # sought first next time
                        members.insert(0, members.pop(j))
        mark[mine] = False
        best = max(shared, key=lambda k: (shared[k], -k), default=-1)
        if best < 0 or 2 * shared[best] < len(mine):
            best = len(subgroups)
            subgroups.append([])
        subgroups[best].append(x)
        for t in names:
            held = matrix.setdefault(t, [])
            if best not in held:
                held.append(best)
    return links


def _token_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tokens = table.column("tokens").combine_chunks()
    flat = tokens.flatten().to_numpy()
    return flat, np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])


def _link_rows(percent: int):
    """Links of tiles; documents without a root are the only ones of it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, ["grp", "a", "b"], HELD):
            ids, grp, a, b, own, root = (table.column(c).to_numpy() for c in ("doc_id", "grp", "a", "b", "own", "root"))
            flat, first = _token_lists(table)
            u: list[int] = []
            v: list[int] = []
            for low, high in _edges(grp, a, b):
                side = own[low:high] if a[low] != b[low] else None
                for p, q in group_links([flat[first[k] : first[k + 1]] for k in range(low, high)], percent, side, root[low:high]):
                    u.append(ids[low + p])
                    v.append(ids[low + q])
            yield from _pairs(u, v)

    return rows


def rings(common: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    """Which ring a distance is in: 0 is that of links, each is as wide as the largest distance of a link."""
    if percent == 100:
        return (common < union).astype(np.int64)
    return np.maximum(-(-100 * (union - common) // (union * (100 - percent))) - 1, 0)


def _ring_rows(percent: int):
    """Of rows sorted by (grp, salt, role), each document's ring about its group's pivot, which comes first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.whole_groups(batches, ["grp", "salt"], HELD):
            ids, grp, salt = (table.column(c).to_numpy() for c in ("doc_id", "grp", "salt"))
            flat, first = _token_lists(table)
            flat = flat.view(K.U64)  # in this order they are sorted in each document
            ring, pivot = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            rest = np.ones(len(ids), dtype=bool)
            for low, high in _edges(grp, salt):
                rest[low] = False
                mine = flat[first[low] : first[low + 1]]
                theirs = flat[first[low + 1] : first[high]]
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)  # lists are sorted, none is empty
                hits = np.concatenate([[0], np.cumsum(mine[at] == theirs)])
                n = np.diff(first[low + 1 : high + 1])
                common = np.diff(hits[first[low + 1 : high + 1] - first[low + 1]])
                ring[low + 1 : high] = rings(common, n + len(mine) - common, percent)
                pivot[low:high] = ids[low]
            if rest.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[rest]) for x in (ids, grp, pivot, ring)], ["doc_id", "grp", "pivot", "ring"])

    return rows


MEMBER = ["doc_id", "grp", "old", "both", "root", "n_shingles"]


def _chunks(members: DataFrame, chunk: int) -> DataFrame:
    """``(grp, fresh, stale)``: how many chunks the new and the old documents of each group make."""

    def of(old: bool) -> Column:
        n, tokens = F.count_if(F.col("old") == old), F.sum(F.when(F.col("old") == old, F.col("n_shingles")).otherwise(0))
        return F.when(n > 0, F.greatest(F.floor((n - 1) / chunk), F.floor(tokens / CHUNK_TOKENS)) + 1).otherwise(0).cast("int")

    return members.groupBy("grp").agg(of(False).alias("fresh"), of(True).alias("stale"))


def _parted(members: DataFrame, tokens: DataFrame, percent: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """One round of pivots: links to the pivots, and the members of what is left to compare.

    Members of a group are new or old; wanted are the pairs of a new one with an
    old one and, if the group says ``both``, those of two new ones.  The pivot is
    copied to each chunk of its group; nothing else is.
    """
    first = F.min(F.when(~F.col("old"), F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")))["doc_id"]
    chosen = members.groupBy("grp").agg(first.alias("chosen")).join(_chunks(members, chunk), "grp")  # one row a group each
    chosen = chosen.select("grp", "chosen", (F.col("fresh") + F.col("stale")).alias("tiles"))
    seats = members.select("doc_id", "grp").join(chosen.hint("merge"), "grp").where("doc_id <> chosen")  # merge joins of hot groups can be split
    own = seats.select("doc_id", "grp", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int").alias("salt"), F.lit(1).alias("role"))
    copied = chosen.select(F.col("chosen").alias("doc_id"), "grp", F.explode(F.expr("sequence(0, tiles - 1)")).alias("salt"), F.lit(0).alias("role"))
    placed = own.unionByName(copied).join(tokens.hint("merge"), "doc_id")
    ringed = placed.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role").select("doc_id", "grp", "salt", "tokens")
    ringed = materialise(ringed.mapInArrow(_ring_rows(percent), "doc_id long, grp long, pivot long, ring long"), "op8-rings")
    links = ringed.where("ring = 0").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v"))

    def seat(k: Column, old: bool) -> Column:
        return F.struct(k.alias("k"), F.lit(old).alias("stays"))

    ring = F.col("ring")
    # a pair goes to the bucket of its new document's ring, of two new ones the outer ring; in the innermost all are connected
    as_new = F.array(seat(ring, False), F.when(F.col("both"), seat(ring + 1, True)))
    as_old = F.array(F.when(ring > 0, seat(ring - 1, True)), F.when(ring > 0, seat(ring, True)), seat(ring + 1, True))
    seats = F.filter(F.when(F.col("old"), as_old).otherwise(as_new), lambda x: x.isNotNull())
    root = F.when(ring == 0, F.col("pivot")).otherwise(F.col("root"))
    left = ringed.join(members, ["doc_id", "grp"]).select("doc_id", "grp", "both", root.alias("root"), "n_shingles", F.inline(seats))
    left = left.select("doc_id", F.xxhash64("grp", "k").alias("grp"), F.col("stays").alias("old"), (F.col("both") & (F.col("k") > 0)).alias("both"), "root", "n_shingles")
    new, old = F.count_if(~F.col("old")), F.count_if("old")
    live = left.groupBy("grp").agg(new.alias("new"), old.alias("stale"), F.bool_or("both").alias("b")).where("new > 0 and (stale > 0 or (b and new > 1))").select("grp")
    return links, left.join(live.hint("merge"), "grp", "left_semi").select(*MEMBER)


def _tiled(members: DataFrame, chunk: int) -> DataFrame:
    """``(doc_id, grp, a, b, own, root)``: every wanted pair of a group's members meets in one tile."""
    sized = members.join(_chunks(members, chunk).hint("merge"), "grp")
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("old"), F.col("stale")).otherwise(F.col("fresh"))).cast("int") + F.when(F.col("old"), F.col("fresh")).otherwise(0)
    from_, to = F.when(F.col("old") | F.col("both"), 0).otherwise(F.col("fresh")), F.when(F.col("old"), F.col("fresh")).otherwise(F.col("fresh") + F.col("stale"))
    others = F.when(to > from_, F.sequence(from_, to - 1)).otherwise(F.array().cast("array<int>"))
    tiled = sized.select("doc_id", "grp", "root", own.alias("own"), F.explode(others).alias("other"))
    return tiled.select("doc_id", "grp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "root")


def group_members_links(members: DataFrame, tokens: DataFrame, percent: int, chunk: int = CHUNK, rounds: int = ROUNDS) -> DataFrame:
    """``(u, v)``: links that connect whatever is linked in each group of ``members``."""
    links = members.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).where(F.lit(False))
    settled = None  # members for tiles
    for _ in range(rounds):
        sized = members.join(_chunks(members, chunk).select("grp", ((F.col("fresh") > 1) | (F.col("stale") > 1)).alias("large")).hint("merge"), "grp")
        small = sized.where("not large").select(*MEMBER)
        settled = small if settled is None else settled.unionByName(small)
        large = sized.where("large").select(*MEMBER)
        if large.isEmpty():
            members = None
            break
        found, left = _parted(materialise(large, "op8-large"), tokens, percent, chunk)
        links, members = links.unionByName(found), materialise(left, "op8-left")
    if members is not None:
        settled = members if settled is None else settled.unionByName(members)
    placed = _tiled(settled, chunk).join(tokens.hint("merge"), "doc_id")
    placed = placed.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b").select("doc_id", "grp", "a", "b", "own", "root", "tokens")
    return links.unionByName(placed.mapInArrow(_link_rows(percent), "u long, v long"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document; see the module."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be between 50 and 100: below, histograms two levels apart may link")
    docs = documents(docs)
    ranks = docs.sparkSession.sparkContext.broadcast(token_ranks(docs, size))  # COUNTERS bytes
    sets = materialise(docs.mapInArrow(_set_rows(size, percent, ranks), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>, cells binary"), "op8-sets")
    classes = sets.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id"))
    classes = materialise(classes, "op8-classes")
    heads = sets.select("doc_id", "keys").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    keyed = heads.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    buckets = keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_bucket_rows(bucket), "bucket long, id long, least long")
    buckets = materialise(buckets.distinct(), "op8-buckets")
    placed = buckets.where("bucket is not null").select("bucket", "id").join(sets.select(F.col("doc_id").alias("id"), "n_shingles", "cells").hint("merge"), "id")
    joined = placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_joined_rows(percent), "u long, v long")
    groups = connected_components(joined.union(buckets.where("bucket is null").select(F.col("id").alias("u"), F.col("least").alias("v"))))
    inside = groups.select(F.col("id").alias("doc_id"), F.col("component").alias("grp"))
    texts = docs.join(inside.hint("merge"), "doc_id").select("doc_id", "grp", "text")  # the same plan at every size
    held = materialise(texts.mapInArrow(_token_rows(size), "doc_id long, grp long, tokens array<long>"), "op8-tokens")
    members = held.select("doc_id", "grp", F.lit(False).alias("old"), F.lit(True).alias("both"), F.lit(-1).cast("long").alias("root"), F.size("tokens").cast("long").alias("n_shingles"))
    links = group_members_links(members, held.select("doc_id", "tokens"), percent, chunk, rounds)
    linked = connected_components(links).select(F.col("id").alias("class_id"), F.col("component").alias("linked_id"))
    named = classes.join(linked, "class_id", "left").select("n_shingles", "h1", "h2", F.coalesce("linked_id", "class_id").alias("component_id"))
    out = sets.select("doc_id", "n_shingles", "h1", "h2").join(named, ["n_shingles", "h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=90)
