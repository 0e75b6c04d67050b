from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from groundwell.llm import op1_substring as op
from groundwell.llm import textkit as K

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts: dict, window: int) -> dict:
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    seen = collections.Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(
    ("window", "options"),
    [(35, {}), (35, {"salt_rows": 3, "shard_rows": 20, "hot": 2}), (35, {"hot": 4, "salt_rows": 2}), (4, {"gram": 2, "salt_rows": 5, "hot": 6}), (8, {"gram": 8})],
)
def test_removed_words_are_those_of_brute_force(docs, texts, window, options):
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in op.remove_repeats(docs, window, **options).collect()}
    assert got == brute(texts, window)
    assert sum(v[1] for v in got.values()) > 0


def test_odd_ids_and_empty_tables(odd_docs, no_docs):
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in op.remove_repeats(odd_docs).collect())
    assert got == [(1, 80, 80), (1, 80, 80), (2, 0, 0), (3, 1, 0), (3, 2, 0)]
    assert op.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("options", [{}, {"salt_rows": 3, "hot": 2, "shard_rows": 5}])
def test_rows_that_repeat_an_id_are_documents_of_their_own(spark, options):
    shared, other = [f"w{k}" for k in range(50)], [f"v{k}" for k in range(70)]
    rows = [
        (1, " ".join(shared)),
        (1, " ".join(other[:60])),  # recurs nowhere
        (2, " ".join(["x", *shared, "y"])),
        (3, " ".join(["z"] + other[62:] + ["q"] * 20)),
        (4, " ".join(f"u{k}" for k in range(40))),  # a true copy
        (4, " ".join(f"u{k}" for k in range(40))),
        (5, "short"),
        (5, None),
    ]
    want = sorted((rows[k][0], *v) for k, v in brute({k: t for k, (_, t) in enumerate(rows)}, 35).items())
    got = sorted((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect())
    assert got == want
    assert sorted(x[2] for x in got) == [0, 0, 0, 0, 40, 40, 50, 50]


def test_groups_are_whole_in_a_stream():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 40, 500))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 7]), pa.array(np.arange(a, min(a + 7, 500)))], ["key", "n"]) for a in range(0, 500, 7)]
    for rows in (1, 20, 10_000):
        tables = list(K.whole_groups(iter(batches), ["key"], rows))
        assert np.concatenate([t.column("n").to_numpy() for t in tables]).tolist() == list(range(500))
        assert sum(len(np.unique(t.column("key").to_numpy())) for t in tables) == len(np.unique(key))
    assert list(K.whole_groups(iter([]), ["key"], 5)) == []


def test_query_digest(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in brute(texts, 35).items()}
    assert {r[0]: tuple(r[1:4]) for r in op.query(spark, sf).collect()} == want


def test_bad_sizes_are_refused(docs):
    with pytest.raises(ValueError):
        op.repeated_windows(docs, 5, gram=6)
