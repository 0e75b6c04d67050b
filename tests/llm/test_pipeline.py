from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import corpus_pipeline as pipeline
import public_tokenizers
import pytest

from groundwell.llm import op5_bpe, op6_decontaminate, op8_jaccard, op9_secrets

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs):
    where = tmp_path_factory.mktemp("data")
    secret = spark.createDataFrame([("a token = 'abcdef0123456789abcdef0123456789' here", 1, "c", 900, 1, "en", "s", 48, 1, 0)], docs.schema)
    leak = " ".join(f"leak{k}" for k in range(20))
    leaked = spark.createDataFrame([(f"before {leak} after", 1, "c", 901, 1, "en", "s", 50, 1, 0)], docs.schema)
    docs.union(secret).union(leaked).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def stage(spark, folder, name, docs):
    return dict(pipeline.STAGES)[name](spark, docs, folder)


def test_stages_one_by_one(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, _ in pipeline.STAGES:
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        path = str(tmp_path / name)
        stage(spark, folder, name, docs).write.parquet(path)
        after_df = spark.read.parquet(path)
        after = {r.doc_id: r.asDict() for r in after_df.collect()}
        if name != "tokens":
            assert after_df.columns == columns
        if name == "language":
            assert set(before) - set(after) == {d for d, r in before.items() if not any(c.isalpha() for c in r["text"] or "")}
        elif name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in op8_jaccard.near_duplicates(docs).collect()}
            assert set(after) == set(groups.values()) and len(after) < len(before)
        elif name == "decontamination":
            bad = {r.doc_id for r in op6_decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()}
            assert set(before) - set(after) == bad == {901}
        elif name == "secrets":
            assert set(after) == set(before)
            for d, r in after.items():
                assert r["text"] == op9_secrets.redact(before[d]["text"]) and r["n_chars"] == len(r["text"])
            assert "[secret]" in after[900]["text"]
        else:
            assert set(after) == set(before)
            path = public_tokenizers.path(op5_bpe.RANKS_FILE)
            assert all(op5_bpe.decode_ids(r["ids"], path).decode() == before[d]["text"] and r["n_tokens"] == len(r["ids"]) for d, r in after.items())
        if name in ("language", "near_duplicates", "decontamination"):
            assert all(r == before[d] for d, r in after.items())
        docs = after_df
    assert {r.doc_id for r in pipeline.run(spark, folder).select("doc_id").collect()} == set(after)


def test_stages_survive_an_empty_table_and_odd_ids(spark, folder, no_docs, odd_docs):
    for name, _ in pipeline.STAGES:
        assert stage(spark, folder, name, no_docs).count() == 0
        stage(spark, folder, name, odd_docs.selectExpr("doc_id", "text", "'en' AS lang")).count()


def test_the_entry_works_without_the_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(('groundwell.llm', 'corpus_pipeline')):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in names)
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
