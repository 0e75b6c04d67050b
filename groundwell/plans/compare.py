"""Comparing results by their rows: as multisets, as sequences, by digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(df: DataFrame, places: int = 2) -> DataFrame:
    """Columns by position (labels do not count) and doubles rounded."""
    out = []
    for k, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`") if len(set(df.columns)) == len(df.columns) else df[k]
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), places)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f"_{k}"))
    return df.select(*out)


def multiset_differences(left: DataFrame, right: DataFrame, places: int = 2) -> DataFrame:
    """``only_left`` and ``only_right`` row counts; both 0 when equal.

    One grouped count over the union of both sides: two partially aggregated
    shuffles less than a pair of EXCEPT ALLs.
    """
    a, b = canonical(left, places), canonical(right, places)
    if len(a.columns) != len(b.columns):
        raise ValueError("results differ in their number of columns")
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    balance = both.groupBy(*a.columns).agg(F.sum("_side").alias("balance"))
    return balance.agg(F.coalesce(F.sum(F.greatest("balance", F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-F.col("balance"), F.lit(0))), F.lit(0)).alias("only_right"))


def _ranged(df: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """Adds ``_range``, rising with the order columns, and ``_before``, the weight of all ranges before.

    The driver sees a bounded sample of the order columns and one sum of each range.
    """
    spark, keys = df.sparkSession, df.select(*order)
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = keys.sample(min(1.0, 20 * n_ranges / max(keys.count(), 1)), seed=1).orderBy(*order).collect()
    bounds = [tuple(sample[k * len(sample) // n_ranges]) for k in range(1, n_ranges)] if sample else []
    one = spark.createDataFrame([(bounds,)], T.StructType([T.StructField("_bounds", T.ArrayType(keys.schema))]))
    at = F.size(F.filter("_bounds", lambda bound: bound <= F.struct(*order)))
    ranged = df.crossJoin(F.broadcast(one)).withColumn("_range", at).drop("_bounds")  # one row
    rows, before = [], 0
    for k, n in sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.sum(weight)).collect()):
        rows.append((k, before))
        before += n
    offsets = spark.createDataFrame(rows, "_range int, _before long")
    return ranged.join(F.broadcast(offsets), "_range")  # a row for each range


def with_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``, from 1; ``df`` must give the same rows whenever it is read.

    Ranges of the order columns are numbered side by side, and each adds the
    rows of the ranges before it.
    """
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return _ranged(df, order, F.lit(1)).withColumn("position", F.col("_before") + within).drop("_range", "_before")


def middle_values(df: DataFrame, column: str) -> DataFrame:
    """One row with ``low`` and ``high``, the middle pair of the non-null values; null without any.

    Equal values are counted first, and ranges of values are summed side by side.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    upto = F.col("_before") + F.sum("n").over(Window.partitionBy("_range").orderBy("value"))
    ranked = _ranged(counts, ["value"], F.col("n")).withColumn("upto", upto).crossJoin(F.broadcast(total))  # one row
    at = [F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")]
    return ranked.agg(*[F.min(F.when(F.col("upto") >= k, F.col("value"))).alias(name) for k, name in zip(at, ("low", "high"), strict=True)])


def digest(df: DataFrame, places: int = 2) -> DataFrame:
    """One row that depends on the multiset of rows only: its size and two sums of independent 64-bit row hashes."""
    rows = canonical(df, places)
    hashes = [F.xxhash64(F.lit(seed), *rows.columns).cast("decimal(20,0)") for seed in (3, 7)]  # whole sums, no overflow
    sums = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(name) for h, name in zip(hashes, "ab", strict=True)])
    return sums.select("n", F.substring(F.sha2(F.concat_ws(":", "n", "a", "b"), 256), 1, 16).alias("digest"))
