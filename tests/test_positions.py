"""Positions of ordered results."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from groundwell.plans.compare import with_positions


def test_positions_are_those_of_the_sorted_rows(spark):
    rng = random.Random(15)
    rows = [(rng.choice([None, *range(40)]), k, str(k)) for k in range(3000)]
    rng.shuffle(rows)
    got = with_positions(spark.createDataFrame(rows, "a long, b int, c string").repartition(7), ["a", "b"])
    assert got.columns == ["a", "b", "c", "position"]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [tuple(r) for r in got.orderBy("position").collect()] == [(*r, k) for k, r in enumerate(want, 1)]
    assert with_positions(spark.createDataFrame([], "a long"), ["a"]).count() == 0


def test_no_task_numbers_all_rows(spark):
    got = with_positions(spark.range(20_000), ["id"])
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[1] for r in with_positions(spark.range(20_000), ["id"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert sum(sizes) == 20_000 and max(sizes) < 20_000
