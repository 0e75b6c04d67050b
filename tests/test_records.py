"""Evaluation records: round trip, and every measure against plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter
from statistics import median

import pytest

from groundwell.plans import compare, evaluate, grounding
from groundwell.sources import results

VERDICTS = ["match", "match", "match", "miss", "declined", "caught", "false_answer", "broken_reference", "errored"]


def records(n: int = 300) -> list[dict]:
    rng = random.Random(8)
    out = []
    for k in range(n):
        verdict = rng.choice(VERDICTS)
        expected = "refuse" if verdict in ("caught", "false_answer") else "answer"
        out.append({
            "id": f"q{k}", "question": "?", "kind": rng.choice("abc"), "difficulty": rng.choice(["easy", "hard"]), "expected": expected, "verdict": verdict,
            "trap": rng.choice(["hallucination_bait", "ambiguity", "unsafe"]) if expected == "refuse" else None,
            "shows_figures": verdict in ("match", "miss", "false_answer"), "confidence_level": rng.choice(["HIGH", "MEDIUM", "LOW", "ABSTAIN", None]),
            "confidence": rng.choice([None, round(rng.random(), 4)]), "agreement": rng.choice([None, 0.5, 1 / 3, 1.0]), "attempts": rng.randint(0, 3), "repairs_used": rng.randint(0, 1),
            "guard_codes": sorted(rng.sample(["unknown_column", "unknown_table", "row_limit"], rng.randint(0, 3))), "judge_statuses": rng.choices(["pass", "fail", "error"], k=rng.randint(0, 3)),
            "cost": {"calls": rng.randint(0, 3), "input_tokens": rng.randint(0, 99), "output_tokens": 5, "micro_usd": 0}, "latency_ms": rng.randint(0, 9000),
        })
    return out


@pytest.fixture(scope="module")
def made():
    return records()


@pytest.fixture(scope="module")
def table(spark, made, tmp_path_factory):
    path = tmp_path_factory.mktemp("records") / "results.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [{"record": "header", "k": 3, "as_of": "2026-08-31"}, *[{"record": "result", **m} for m in made]]))
    assert results.read_header(spark, str(path)) == {"k": 3, "as_of": "2026-08-31"}
    return results.read_results(spark, str(path)).cache()


def test_rates(table, made):
    ok = [m for m in made if m["verdict"] not in ("broken_reference", "errored")]
    bait = [m for m in ok if m["trap"] == "hallucination_bait"]
    invented = {"unknown_column", "unknown_table"}
    want = {
        "execution_accuracy": (sum(m["verdict"] == "match" for m in ok), sum(m["verdict"] in ("match", "miss") for m in ok)),
        "answer_rate": (sum(m["verdict"] in ("match", "miss") for m in ok), sum(m["expected"] == "answer" for m in ok)),
        "abstention_rate": (sum(not m["shows_figures"] for m in ok), len(ok)),
        "bait_caught": (sum(m["verdict"] == "caught" for m in bait), len(bait)),
        "bait_caught_by_guard": (sum(m["verdict"] == "caught" and bool(invented & set(m["guard_codes"])) for m in bait), len(bait)),
        "bait_abstentions": (sum(m["verdict"] == "caught" and not invented & set(m["guard_codes"]) for m in bait), len(bait)),
        "false_answers": (sum(m["verdict"] == "false_answer" and m["trap"] != "unsafe" for m in ok), sum(m["trap"] in ("hallucination_bait", "ambiguity") for m in ok)),
        "unsafe_refused": (sum(m["verdict"] == "caught" and m["trap"] == "unsafe" for m in ok), sum(m["trap"] == "unsafe" for m in ok)),
        "repair_rate": (sum(m["repairs_used"] > 0 and m["attempts"] > 0 for m in ok), sum(m["attempts"] > 0 for m in ok)),
    }
    got = {r.metric: r for r in evaluate.summary(table).collect()}
    assert {k: (r.passes, r.n) for k, r in got.items()} == want
    for r in got.values():
        assert r.rate == round(r.passes / r.n, 4) and r.low <= r.rate <= r.high


def test_groups_and_histograms(table, made):
    ok = [m for m in made if m["verdict"] not in ("broken_reference", "errored")]
    answered = [m for m in ok if m["verdict"] in ("match", "miss")]
    for column in ("kind", "difficulty"):
        got = {r[column]: (r.passes, r.n) for r in evaluate.accuracy_by(table, column).collect()}
        assert got == {g: (sum(m["verdict"] == "match" for m in answered if m[column] == g), sum(m[column] == g for m in answered)) for g in {m[column] for m in answered}}
    assert {r.bucket: r.n for r in evaluate.agreement_histogram(table).collect()} == Counter(f"{m['agreement']:.2f}" for m in answered if m["agreement"] is not None)
    assert {r.code: r.questions for r in evaluate.guard_code_counts(table).collect()} == Counter(c for m in ok for c in m["guard_codes"])
    assert {r.verdict: r.n for r in evaluate.verdict_counts(table).collect()} == Counter(m["verdict"] for m in made)
    said = [s for m in ok for s in m["judge_statuses"]]
    assert tuple(evaluate.judge_counts(table).first()) == (len(said), said.count("error"))


def test_calibration(table, made):
    shown = [m for m in made if m["verdict"] in ("match", "miss", "false_answer") and m["confidence_level"] in ("HIGH", "MEDIUM", "LOW")]
    got = {r.confidence_level: r for r in evaluate.calibration(table).collect()}
    assert got.keys() == {m["confidence_level"] for m in shown}
    for level, r in got.items():
        these = [m for m in shown if m["confidence_level"] == level]
        values = [m["confidence"] for m in these if m["confidence"] is not None]
        assert (r.passes, r.n) == (sum(m["verdict"] == "match" for m in these), len(these))
        assert abs(r.mean_score - sum(values) / len(values)) < 1e-4


def test_spend(table, made):
    r = evaluate.spend(table).first()
    assert [r.calls, r.input_tokens, r.output_tokens] == [sum(m["cost"][c] for m in made) for c in ("calls", "input_tokens", "output_tokens")]
    assert (r.total_ms, r.max_ms) == (sum(m["latency_ms"] for m in made), max(m["latency_ms"] for m in made))
    assert r.median_ms == int(median(m["latency_ms"] for m in made if m["cost"]["calls"]) // 1)
    none = evaluate.spend(table.where("false")).first()
    assert (none.calls, none.total_ms, none.max_ms, none.median_ms) == (0, 0, 0, 0)


@pytest.mark.parametrize("values", [[1], [1, 2], [3, 1, 2], [5, 5, 5, 9], [2, None, 8], list(range(101)) * 3, [-3, -2]])
def test_median(spark, values):
    plain = [v for v in values if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert evaluate.floored_median(df, "v").first()[0] == int(median(plain) // 1)


def test_confidence_with_a_repair(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, None, True), (1.0, 0.5, False), (None, None, True), (0.1, 0.1, True)], "a double, b double, repaired boolean")
    got = [round(r[0], 4) for r in df.select(evaluate.confidence([(F.col("a"), 40), (F.col("b"), 20)], F.col("repaired"))).collect()]
    assert got == [0.85, 0.8333, 0.0, 0.0]


def test_results_round_trip_and_are_written_once(spark, table, tmp_path):
    path = str(tmp_path / "again")
    results.write_results(table, {"k": 5}, path)
    assert results.read_header(spark, path) == {"k": 5}
    again = results.read_results(spark, path)
    assert compare.multiset_differences(table.drop("cost", "tags", "guard_codes", "judge_statuses"), again.drop("cost", "tags", "guard_codes", "judge_statuses")).first()[:] == (0, 0)
    assert {r.id: (r.guard_codes, r.cost) for r in again.collect()} == {r.id: (r.guard_codes, r.cost) for r in table.collect()}
    with pytest.raises(FileExistsError):
        results.write_results(table, {"k": 6}, path)
    assert results.read_header(spark, path) == {"k": 5}
    with pytest.raises(Exception):
        results.write_once(table.selectExpr("assert_true(false)"), str(tmp_path / "broken"))
    assert [p.name for p in tmp_path.iterdir()] == ["again"]


def test_digests_tell_multisets_apart(spark):
    def digest(rows):
        return compare.digest(spark.createDataFrame(rows, "a long, b double")).first()[1]

    rows = [(k, k / 3) for k in range(50)]
    assert digest(rows) == digest(rows[::-1])
    assert len({digest(rows), digest(rows + rows[:1]), digest(rows[1:]), digest([(k + 1, b) for k, b in rows])}) == 4


def test_figures_in_sentences(spark):
    from pyspark.sql import functions as F

    cases = [("€1,250.00 on 2026-07-01", ["1250", "2026-07-01"], []), ("-$5 of 007, 12.50%", ["-5", "7", "12.5%"], []), ("in 2026-07 we sold 0.0", ["2026-07", "0"], []), ("12.5 and 3", ["12.5%"], ["12.5", "3"]), ("none", [], [])]
    df = spark.createDataFrame(cases, "sentence string, cells array<string>, want array<string>")
    for r in df.select("want", grounding.ungrounded(F.col("sentence"), F.col("cells")).alias("got"), "sentence").collect():
        assert r.got == r.want, r.sentence
