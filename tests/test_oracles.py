"""Every query that SQL can express, against an independent SQL engine on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from groundwell.operators import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    yield con
    con.close()


def plain(value):
    """Values of both engines in one form: numbers by value, times as text."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, decimal.Decimal, float)):
        number = float(value)
        return "nan" if math.isnan(number) else round(number, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_the_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF_DIR)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(columns, found.fetchall())


def test_the_result_digest_is_that_of_its_rows(spark):
    from groundwell.plans import compare

    rows = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_custkey", "o_totalprice")
    n, value = QUERIES["result_digest"](spark, SF_DIR).first()
    assert n == rows.count() and len(value) == 16
    assert compare.digest(rows.repartition(7).orderBy("o_totalprice")).first()[1] == value
    assert compare.digest(rows.where("o_custkey <> 1")).first()[1] != value
    assert set(QUERIES) - set(ORACLES) == {"result_digest"}


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "groundwell", tmp_path / "groundwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q) > 100, any(n.startswith('op') and n[2].isdigit() for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "False"], done.stderr[-500:]
