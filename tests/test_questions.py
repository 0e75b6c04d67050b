"""Question files: what is read, and what is refused."""

from __future__ import annotations

import json

import pytest

from groundwell.sources import questions

GOOD = {"id": "orders_total", "question": "How many orders are  there?", "tags": ["kind:scalar", "difficulty:easy"], "expected": "answer", "reference_sql": "SELECT count(*)\n  FROM orders", "notes": "the floor"}
TRAP = {"id": "drop_it", "question": "Delete all orders", "tags": ["kind:scalar", "difficulty:hard", "trap:unsafe"], "expected": "refuse", "notes": "must not run"}

BAD = [
    ({"id": "Orders"}, "id is not snake case"),
    ({"id": None}, "id is not snake case"),
    ({"notes": ...}, "missing key"),
    ({"answer": 5}, "unknown key"),
    ({"question": "  "}, "empty text"),
    ({"tags": ["kind:scalar", "difficulty:easy", "colour:red"]}, "tag without a known prefix"),
    ({"tags": ["kind:scalar"]}, "not one difficulty"),
    ({"tags": ["kind:scalar", "kind:list", "difficulty:easy"]}, "not one kind"),
    ({"tags": ["kind:sum", "difficulty:easy"]}, "unknown kind"),
    ({"tags": ["kind:list", "difficulty:easy", "trap:door"]}, "unknown trap"),
    ({"tags": ["kind:list", "difficulty:easy", "trap:unsafe", "trap:ambiguity"]}, "more than one trap"),
    ({"tags": []}, "not one kind"),
    ({"expected": "shrug"}, "unknown expectation"),
    ({"expected": "abstain", "reference_sql": ...}, "expectation and trap disagree"),
    ({"tags": ["kind:list", "difficulty:easy", "trap:unsafe"]}, "expectation and trap disagree"),
    ({"reference_sql": ...}, "answer without reference"),
    ({"ordered": "perhaps"}, "order is not true or false"),
]


def write(path, rows: list) -> str:
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_a_good_file(spark, tmp_path):
    path = write(tmp_path / "q.jsonl", [GOOD, TRAP, {**GOOD, "id": "ranked", "question": "Which?", "ordered": True}])
    assert questions.faults(spark, path).count() == 0
    got = {r.id: r for r in questions.read_questions(spark, path).collect()}
    assert (got["orders_total"].reference_sql, got["orders_total"].kind, got["orders_total"].trap, got["orders_total"].ordered) == ("SELECT count(*) FROM orders", "scalar", None, False)
    assert (got["drop_it"].trap, got["drop_it"].expected, got["drop_it"].reference_sql) == ("unsafe", "refuse", None)
    assert got["ranked"].ordered


def test_every_fault_is_named(spark, tmp_path):
    rows, want = [], []
    for k, (change, fault) in enumerate(BAD):
        row = {**GOOD, "id": f"case_{k}", "question": f"question {k}", **change}
        rows.append({name: v for name, v in row.items() if v is not ...})
        want.append((row["id"], fault))
    found = {(r.id, r.fault) for r in questions.faults(spark, write(tmp_path / "bad.jsonl", rows)).collect()}
    assert set(want) <= found


def test_faults_of_traps_repeats_and_broken_lines(spark, tmp_path):
    rows = [GOOD, {**GOOD, "question": "another"}, {**GOOD, "id": "same", "question": "how many ORDERS are there?"}, {**TRAP, "reference_sql": "SELECT 1"}, {**TRAP, "id": "sorted", "question": "x", "ordered": True}, "not json", ""]
    path = write(tmp_path / "more.jsonl", rows)
    found = {(r.id, r.fault) for r in questions.faults(spark, path).collect()}
    assert {("orders_total", "id repeats"), ("same", "question repeats"), ("drop_it", "reference of a trap"), ("sorted", "order of a trap"), (None, "no object")} <= found
    with pytest.raises(ValueError, match="repeats"):
        questions.read_questions(spark, path)
    with pytest.raises(ValueError, match="no questions"):
        questions.read_questions(spark, write(tmp_path / "none.jsonl", [""]))
