"""Evaluation records as JSON lines, and tables that are written once.

A record file has one header (``record = "header"``: what was run, with which
settings) and a line of ``record = "result"`` for each question.  Reading gives
every result a row with declared types; a field that a line lacks is null.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a result; questions, what was expected of them, and what came of it.
RESULT = (
    "id string, question string, tags array<string>, kind string, difficulty string, trap string, expected string, ordered boolean, verdict string, correct boolean, "
    "answer_status string, shows_figures boolean, confidence_level string, confidence double, agreement double, k int, attempts int, repairs_used int, "
    "guard_codes array<string>, judge_statuses array<string>, candidate_sql string, candidate_result_digest string, candidate_row_count long, "
    "reference_sql string, reference_ok boolean, reference_result_digest string, reference_row_count long, "
    "cost struct<calls: long, input_tokens: long, output_tokens: long, micro_usd: long>, latency_ms long, error string"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of one file or a folder of them."""
    rows = spark.read.schema(f"record string, {RESULT}").json(path).where("record = 'result'")
    return rows.drop("record")


def read_header(spark: SparkSession, path: str) -> dict:
    """What was run; a file without exactly one header is refused."""
    lines = spark.read.text(path).where(F.get_json_object("value", "$.record") == "header").limit(2).collect()
    if len(lines) != 1:
        raise ValueError(f"{path} has {'no header' if not lines else 'more than one header'}")
    return {k: v for k, v in json.loads(lines[0].value).items() if k != "record"}


def write_results(results: DataFrame, header: dict, path: str) -> None:
    """A header and all results under ``path``, which must not exist."""
    spark = results.sparkSession
    fields = T.StructType.fromDDL(RESULT).fields
    columns = [(F.col(f.name) if f.name in results.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    lines = results.select(F.to_json(F.struct(F.lit("result").alias("record"), *columns)).alias("value"))
    head = spark.createDataFrame([(json.dumps({"record": "header", **header}, sort_keys=True),)], "value string")
    write_once(head.unionByName(lines), path, "text")


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Write a table that must not exist yet; readers see all of it or nothing.

    The rows go to a folder beside it, which is renamed when all are there.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, beside = hadoop(path), hadoop(f"{path.rstrip('/')}.{uuid.uuid4().hex}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        df.write.format(form).save(beside.toString())
        if fs.exists(target) or not fs.rename(beside, target):  # someone else was first
            raise FileExistsError(path)
    finally:
        if fs.exists(beside):
            fs.delete(beside, True)
