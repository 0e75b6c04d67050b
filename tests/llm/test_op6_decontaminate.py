from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from groundwell.llm import op6_decontaminate as op


@pytest.fixture(scope="module")
def items(spark, texts):
    words = re.findall(r"[a-z0-9]+", texts[33] or "")
    rows = [
        (1, " ".join(words[5:30]), "x"),
        (2, "SAME same " * 6, "x"),
        (3, "two words", "x"),
        (4, "One", "x"),
        (5, "", "x"),
        (6, None, "x"),
        (7, "! ?", "x"),
        (8, " ".join(words[8:17]), "x"),
        (10, " ".join(words[5:30]), "x"),
        (11, "é É", "x"),
        (None, "w1 w2", "x"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string, words string")


def oracle(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar)")
    con.sql("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    con.executemany("insert into benchmark values (?, ?)", [i for i in items if i[0] is not None])
    return sorted(con.sql(op.ORACLE).fetchall())


@pytest.mark.parametrize("broadcast_bytes", [op.BROADCAST_BYTES, 0])
def test_hits_are_those_of_sql(docs, items, broadcast_bytes):
    out = op.decontaminate(docs, items, broadcast_bytes=broadcast_bytes)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in out.collect())
    plain = [(r.doc_id, None if r.text is None else r.text.replace("\x00", " ")) for r in docs.collect()]  # NUL is a separator that DuckDB can't hold
    want = oracle(plain, [(r.item_id, r.text) for r in items.collect()])
    assert got == want
    assert sum(w[5] for w in want) > 12


@pytest.mark.parametrize(("window", "gram", "broadcast_bytes"), [(10, 5, 1 << 20), (10, 5, 0), (4, 2, 1 << 20), (3, 3, 1 << 20), (6, 1, 0)])
def test_repetitive_words_and_repeated_ids(spark, window, gram, broadcast_bytes):
    rng = random.Random(window)
    docs = [(k // 2, " ".join(rng.choice("aab") for _ in range(rng.randint(0, 30)))) for k in range(60)]
    docs += [(3, docs[6][1]), (90, "clean words only here"), (90, " ".join("ab" * 9))]
    items = [(k // 2, " ".join(rng.choice("aabc") for _ in range(rng.randint(0, 14)))) for k in range(12)]
    windows: dict[int, set] = {}
    for item, text in items:
        w = text.split()
        n = min(window, len(w))
        windows.setdefault(item, set()).update(tuple(w[a : a + n]) for a in range(len(w) - n + 1) if n)
    want = []
    for doc, text in docs:
        w, hit, met = text.split(), set(), set()
        for item, spans in windows.items():
            for span in spans:
                for a in range(len(w) - len(span) + 1):
                    if tuple(w[a : a + len(span)]) == span:
                        hit.update(range(a, a + len(span)))
                        met.add(str(item))
        want.append((doc, len(w), len(hit), sorted(met)))
    out = op.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, gram, broadcast_bytes)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in out.collect()) == sorted(want)


def test_a_clean_text_under_a_contaminated_id_stays_clean(spark, items, texts):
    docs = spark.createDataFrame([(7, texts[33]), (7, "a clean text of its own that recurs nowhere at all in any item")], "doc_id long, text string")
    assert sorted(r.contaminated for r in op.decontaminate(docs, items).collect()) == [False, True]


def test_plan_is_native(docs, items):
    plan = op.decontaminate(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_without_items_or_documents(spark, docs, no_docs, items, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert op.decontaminate(no_docs, items).count() == 0
    got = sorted((r.doc_id, r.n_words) for r in op.decontaminate(odd_docs, items).select("doc_id", "n_words").collect())
    assert got == [(1, 80), (1, 80), (2, 0), (3, 1), (3, 2)]


def test_query(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in op.query(spark, sf).collect()) == sorted(con.sql(op.ORACLE).fetchall())
