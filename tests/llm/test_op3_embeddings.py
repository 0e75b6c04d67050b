from __future__ import annotations

import numpy as np
import pytest

from groundwell.llm import op3_embeddings as op

SCHEMA = "rep int, embedding array<float>, n string, label int, vec_id long, bucket long"


def vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    out = []
    for c in range(60):
        centre = rng.standard_normal(48)
        for _ in range(int(rng.integers(1, 9))):
            noise = rng.standard_normal(48) * rng.choice([0.0, 0.05, 0.15, 0.25])
            out.append(((centre + noise) * rng.uniform(0.5, 2)).astype(np.float32).tolist())
    rows = [(0, v, "x", k % 3, k, 1) for k, v in enumerate(out)]
    n = len(rows)
    rows += [(0, out[0], "x", 0, n + k, 1) for k in range(40)]  # copies
    n = len(rows)
    odd = [None, [0.0] * 48, [float("nan")] + [1.0] * 47, [float("inf")] + [1.0] * 47, [None] + [1.0] * 47, [], [1.0], [2.0]]
    rows += [(0, v, "x", 0, n + k, 1) for k, v in enumerate(odd)]
    rows += [(0, out[0], "x", None, n + 20, 1), (0, out[0], "x", None, n + 21, 1), (0, out[0], "x", 0, None, 1)]
    return rows


def brute(rows: list[tuple]) -> dict:
    good = {}
    up = {r[4]: r[4] for r in rows if r[4] is not None}
    for _, v, _, label, vec, _ in rows:
        if vec is None or v is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        good[vec] = (label, x / np.linalg.norm(x))
    links = dict.fromkeys(up, 0)

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(good)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and float(x @ y) >= 0.98:
                links[a] += 1
                links[b] += 1
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {v: (links[v], root(v), root(v) == v) for v in up}


@pytest.mark.parametrize("chunk", [1024, 4])
def test_links_and_components(spark, chunk):
    rows = vectors()
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.near_duplicates(df, chunk=chunk).collect()}
    assert got.keys() == want.keys()
    assert all(got[v][0] <= want[v][0] for v in got)  # no link below the threshold
    total = sum(x[0] for x in want.values())
    assert total > 1000
    assert sum(x[0] for x in got.values()) >= 0.99 * total
    assert sum(got[v] == want[v] for v in got) >= 0.97 * len(got)


def test_recall_against_all_pairs_on_noisy_vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((2000, 64))
    near = base + 0.19 * rng.standard_normal(base.shape)  # cosines around the threshold
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (base, near)]
    wanted = (unit[0] * unit[1]).sum(1) >= 0.98
    met = np.zeros(2000, bool)
    for t in range(op.TABLES):
        a, b = (op.probe_codes(u, t, op.HASHES, op.PROBES) for u in unit)
        met |= (a[:, :1] == b).any(1) | (b[:, :1] == a).any(1)
    assert wanted.sum() > 500
    assert met[wanted].mean() >= 0.95


@pytest.mark.parametrize("width", [64, 256])
def test_the_query_on_vectors_with_links(spark, tmp_path, width):
    rng = np.random.default_rng(width)
    rows, centres = [], rng.standard_normal((120, width))
    for k in range(1500):
        v = centres[k % 120] + rng.choice([0.02, 0.1, 0.14, 0.18]) * rng.standard_normal(width)  # cosines on both sides of 0.98
        rows.append((0, v.astype(np.float32).tolist(), "x", int(k % 2), k, 1))
    rows += [(0, rows[5][1], "x", rows[5][3], 1500 + k, 1) for k in range(30)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op.query(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(got[v][0] <= want[v][0] for v in got)
    total = sum(x[0] for x in want.values())
    recall = sum(x[0] for x in got.values()) / total
    print(f"recall of links at cosine 0.98 and more, {width} components: {recall:.4f} of {total // 2}")
    assert total > 2000
    assert recall >= 0.99
    assert sum(got[v][1] == want[v][1] for v in got) >= 0.99 * len(got)


def test_classes_are_told_by_independent_hashes(spark):
    df = spark.createDataFrame([(0, [float(k), 1.0, -2.5 * k], "", 1, k, 0) for k in range(50)], SCHEMA)
    from pyspark.sql import functions as F

    pairs = df.select(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"), F.xxhash64(F.xxhash64("embedding"), F.lit(1)).alias("c"))
    assert pairs.distinct().count() == 50
    assert pairs.where("a = b or b = c").count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 32))
    assert np.allclose(np.linalg.norm(op.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(op.hadamard(op.hadamard(x)), x)


def test_empty_table_and_repeated_ids(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1.0, 2.0], "", 1, 5, 0)] * 2
    got = [tuple(r) for r in op.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(5, 1, 5, True)] * 2
