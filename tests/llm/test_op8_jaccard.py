from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from groundwell.llm import op8_jaccard as op
from groundwell.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts: dict, size: int) -> dict:
    out = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(FOLD))
        out[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    return out


def components_of(nodes, edges) -> dict:
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def brute(texts: dict, size: int, percent: int) -> dict:
    sets = sets_of(texts, size)
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components_of(sets, links)
    return {d: (len(sets[d]), root[d]) for d in sets}


@pytest.mark.parametrize(("size", "percent", "chunk"), [(3, 90, 1024), (3, 90, 2), (5, 80, 1024), (3, 100, 1024)])
def test_components_are_those_of_brute_force(docs, texts, size, percent, chunk):
    want = brute(texts, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(docs, size, percent, chunk).collect()}
    assert got == want
    assert len({v[1] for v in want.values()}) < len(want) - 6


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_linked_sets_share_a_key(percent):
    """The prefix argument, on random sets about the threshold, whatever the order of tokens."""
    rng = np.random.default_rng(6)
    seen = 0
    for n in [1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 17, 18, 19, 26, 27, 40, 60, 61, 89, 90, 133, 200, 450]:
        for _ in range(12):
            ranks = rng.integers(0, 5, op.COUNTERS).astype(np.uint8)
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 5, dtype=np.uint64) * np.uint64(2))
            rng.shuffle(pool)
            drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            add = max(0, (n - drop) * 100 // percent - n)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[drop:n], pool[n : n + add]]))
            common = n - drop
            if 100 * common < percent * (len(a) + len(b) - common):
                continue
            seen += 1
            counts, keys = zip(*[op.prefix_keys(s, np.array([0, len(s)]), ranks, percent) for s in (a, b)], strict=True)
            assert [c[0] for c in counts] == [len(k) for k in keys]
            assert set(keys[0].tolist()) & set(keys[1].tolist()), (n, drop, add)
    assert seen > 100


def test_hot_keys_are_joined_as_they_are(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.near_duplicates(docs, 3, 80, bucket=2).collect()}
    assert got == brute(texts, 3, 80)


def test_buckets_stream():
    rng = np.random.default_rng(9)
    key = np.sort(np.concatenate([rng.integers(0, 30, 200), np.full(90, 12), np.full(9, 40)]))
    ids = np.concatenate([np.sort(rng.integers(0, 1000, (key == k).sum())) for k in np.unique(key)])
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 7]), pa.array(ids[a : a + 7])], ["key", "id"]) for a in range(0, len(key), 7)]
    out = pa.Table.from_batches(list(op._bucket_rows(20)(iter(batches)))).to_pylist()
    members: dict = {}
    for r in out:
        if r["bucket"] is not None:
            members.setdefault(r["bucket"], []).append(r["id"])
    want = {k: ids[key == k].tolist() for k in np.unique(key).tolist()}
    assert {tuple(m) for m in members.values()} == {tuple(m) for m in want.values() if 1 < len(m) <= 20}
    hot = [(x, m[0]) for m in want.values() if len(m) > 20 for x in m]
    assert sorted((r["id"], r["least"]) for r in out if r["bucket"] is None) == sorted(hot)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_histograms_never_part_a_link(percent):
    rng = np.random.default_rng(10)
    for _ in range(20):
        n = int(rng.choice([300, 1100, 2100]))  # about the borders of histogram levels
        base = rng.integers(0, 1 << 62, n, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(2 * n // 3, n + 1)], rng.integers(0, 1 << 62, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(12)]
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        cells = op.histograms(np.concatenate(sets), first)
        links = [(a, b) for a, b in itertools.combinations(range(12), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        joined = components_of(range(12), op.joined_pairs(cells, np.diff(first), percent))
        assert all(joined[a] == joined[b] for a, b in links)


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_links_lie_in_neighbouring_rings(percent):
    rng = np.random.default_rng(11)
    for _ in range(40):
        pool = np.arange(60)
        base = [rng.choice(pool, rng.integers(5, 40), replace=False) for _ in range(3)]
        sets = [set(rng.permutation(base[k % 3])[: rng.integers(3, 40)].tolist()) | set(rng.integers(0, 60, 2).tolist()) for k in range(30)]
        pivot, rest = sets[0], sets[1:]
        ring = op.rings(np.array([len(pivot & x) for x in rest]), np.array([len(pivot | x) for x in rest]), percent)
        for k, x in enumerate(rest):
            assert (ring[k] == 0) == (100 * len(pivot & x) >= percent * len(pivot | x))
            for j, y in enumerate(rest):
                if 100 * len(x & y) >= percent * len(x | y):
                    assert abs(int(ring[k]) - int(ring[j])) <= 1


@pytest.mark.parametrize(("percent", "chunk", "rounds"), [(80, 4, 0), (80, 3, 2), (90, 2, 4), (60, 3, 3)])
def test_large_groups_are_parted_without_losing_a_link(spark, percent, chunk, rounds):
    rng = random.Random(percent + chunk)
    sets, groups = {}, {}
    for g in range(4):
        seeds = [rng.sample(range(1000), 30) for _ in range(3)]
        hashed = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(1000)]
        for k in range(25):
            s = set(seeds[rng.randrange(3)])
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 9])):
                s.discard(rng.choice(sorted(s)))
                if rng.random() < 0.5:
                    s.add(rng.randrange(1000))
            sets[100 * g + k], groups[100 * g + k] = {hashed[x] for x in s}, g
    rows = [(d, groups[d], sorted(s, key=lambda x: x % (1 << 64)), len(s)) for d, s in sets.items()]
    table = spark.createDataFrame(rows, "doc_id long, grp long, tokens array<long>, n_shingles long").cache()
    members = table.selectExpr("doc_id", "grp", "false AS old", "true AS both", "-1L AS root", "n_shingles")
    found = op.group_members_links(members, table.select("doc_id", "tokens"), percent, chunk, rounds).collect()
    links = {(a, b) for a, b in itertools.combinations(sets, 2) if groups[a] == groups[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    for r in found:
        assert (min(r.u, r.v), max(r.u, r.v)) in links or sets[r.u] == sets[r.v]
    assert components_of(sets, [(r.u, r.v) for r in found]) == components_of(sets, links)
    assert len(links) > 50


def test_a_group_of_near_copies_takes_linear_time(spark):
    """All link with the pivot: nothing is left for tiles."""
    base = list(range(0, 4000, 2))
    rows = [(k, 7, sorted(base[: 1000 + k % 3] + [10_000 + k]), 1001 + k % 3) for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, grp long, tokens array<long>, n_shingles long")
    members = table.selectExpr("doc_id", "grp", "false AS old", "true AS both", "-1L AS root", "n_shingles")
    found, left = op._parted(members, table.select("doc_id", "tokens"), 90, 16)
    assert found.count() == 299 and left.count() == 0


def test_group_links_connect_what_brute_force_connects():
    rng = random.Random(7)
    for _ in range(30):
        sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 40)))) for _ in range(14)]
        links = [(a, b) for a, b in itertools.combinations(range(14), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
        assert components_of(range(14), op.group_links(sets, 80)) == components_of(range(14), links)


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(5, 5), (200, 201), (201, 200)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == components_of(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rounds_are_deleted_and_a_cluster_needs_a_shared_folder(spark, tmp_path, monkeypatch):
    from groundwell.llm import components, storage

    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    chain = [(k, k + 1) for k in range(200)]
    assert {r.component for r in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()} == {0}
    assert len(list(tmp_path.iterdir())) == 1
    monkeypatch.undo()

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster)


def test_odd_ids_and_empty_tables(odd_docs, no_docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op.near_duplicates(odd_docs).collect())
    assert got == [(1, 76, 1), (1, 76, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3)]
    assert op.near_duplicates(no_docs).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r[0]: tuple(r[1:3]) for r in op.query(spark, sf).collect()} == brute(texts, 3, 90)
