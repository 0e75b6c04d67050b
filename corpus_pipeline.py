"""A training-corpus pipeline over the documents table.

Five stages, each one operator of :mod:`groundwell.llm`; each works on all rows
that the one before kept:

1. ``language``: documents without an identifiable language go (no text or no
   letter); everything else stays, whatever its language.
2. ``near_duplicates``: one document, the least doc_id, of each group stays
   (five-word shingles, similarity 0.8 or more).
3. ``decontamination``: documents with a benchmark window go.
4. ``secrets``: secret spans are replaced by a mask, and n_chars follows.
5. ``tokens``: ids of every document.

Null texts go in stage 1.  Rows without a doc_id cannot be compared or reported
by id: they pass stages 2 and 3 and go in stage 5.  Columns beside ``doc_id`` and
``text`` pass through, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm import op4_language, op5_bpe, op6_decontaminate, op8_jaccard, op9_secrets
from groundwell.llm.learning import id_remainder
from groundwell.llm.storage import materialise, read_table, small_batches


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified."""
    small_batches(spark)
    model = op4_language.fit(docs.where(id_remainder(4) != 2))
    return op4_language.identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    small_batches(spark)
    groups = op8_jaccard.near_duplicates(docs)
    extra = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(extra.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no window with the benchmark."""
    found = op6_decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    same = (docs["doc_id"].cast("long") == hit["_id"]) & (F.xxhash64(docs["text"].cast("string")) == hit["_mark"])
    return docs.join(hit.hint("merge"), same, "left_anti").select(*docs.columns)


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [op9_secrets.redact(t) for t in batch.column("text").to_pylist()]
        columns = {"text": pa.array(texts, batch.schema.field("text").type)}
        if "n_chars" in batch.schema.names:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], schema=batch.schema)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked."""
    small_batches(spark)
    return docs.mapInArrow(_redacted, docs.schema)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row."""
    small_batches(spark)
    encoded = op5_bpe.encode(docs, public_tokenizers.path(op5_bpe.RANKS_FILE))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: Models, components and byte-pair merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
