"""Language identification with error-correcting output codes.

Every learned language has a codeword of bits.  One binary classifier a bit,
naive Bayes on hashed byte n-grams, predicts whether a text's codeword has that
bit.  Loss-weighted decoding takes the language whose codeword has the least
total loss under the classifiers' margins, each bit weighted by how well its
classifier did on the training sample; a small gap between the best two marks
the prediction as ambiguous.

It learns from about ``PER_LANGUAGE`` rows of each language, drawn by id hash,
among those that are not held out; scoring reads whole texts, all of them.

``und`` with score 0 if the text is null or has no letter, or if there was
nothing to learn from.  Of equally near codewords the first language by name wins.
A text of any length is read whole, in one piece.  Rows without a doc_id are left out; rows that repeat an
id are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .learning import id_remainder, sample_classes
from .storage import documents, materialise, read_table, small_batches

#: Rows of each language in the training sample, about.
PER_LANGUAGE = 1500
#: Hash buckets of byte trigrams.
BUCKETS = 1 << 15
#: Probability gap under which the two best languages count as ambiguous.
GAP = 0.2
#: Languages that can be learned: their counts (BUCKETS numbers each) meet on the driver.
MOST_LANGUAGES = 512

_SEED = 41
#: Bytes that take part: ASCII letters, lower-cased, and all of non-ASCII; others are blanks.
_FOLD = np.where(K.NOT_ALNUM, 0x20, K.LOWER).astype(np.uint8)
_FOLD[0x30:0x3A] = 0x20
_FOLD[0x41:0x5B] = K.LOWER[0x41:0x5B]


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 bits for each of ``n`` languages.

    Rows of a Hadamard matrix, any two of which differ in half of their bits;
    bits that are alike for all languages, or repeat another bit or its opposite, go.
    """
    matrix = np.ones((1, 1), np.int8)
    while len(matrix) <= n:
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    code = matrix[1 : n + 1]
    code = code * code[:1]  # the first language has every bit, so opposite bits are equal ones
    return np.unique(code, axis=1)[:, :-1] if n else code[:, :0]  # the last is alike for all


def gram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte trigram around each byte, and the documents' bounds in them.

    Documents are set apart by blanks, so none has a part in another's trigrams.
    """
    n_docs = len(offs) - 1
    where = np.arange(len(data)) + 2 * np.repeat(np.arange(n_docs), np.diff(offs)) + 1
    padded = np.full(len(data) + 2 * n_docs, 0x20, np.uint32)
    padded[where] = _FOLD[data]
    gram = (padded[where - 1] << 16) | (padded[where] << 8) | padded[where + 1]
    return (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15), offs


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  #: (BUCKETS, bits) log odds
    prior: np.ndarray  #: per bit
    trust: np.ndarray  #: per bit, for decoding
    scale: float  #: of margins

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean log odds of each document and bit."""
        bucket, bounds = gram_buckets(data, offs)
        total = np.zeros((len(offs) - 1, self.weights.shape[1]))
        if len(bucket):
            filled = np.flatnonzero(np.diff(bounds) > 0)
            total[filled] = np.add.reduceat(self.weights[bucket], bounds[filled], axis=0)
        return total / np.maximum(np.diff(bounds), 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability, and its lead over the second."""
        code = codewords(len(self.languages)).astype(float)
        if len(self.languages) == 1:
            one = np.ones(len(margins))
            return np.zeros(len(margins), np.int64), one, one
        loss = np.stack([(self.trust * np.logaddexp(0, -self.scale * margins * row)).sum(1) for row in code], axis=1)
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        top = np.sort(chance, axis=1)
        return best, top[:, -1], top[:, -1] - top[:, -2]


def _count_rows(languages: list[str]):
    """Trigram counts of each language in one partition of the sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: k for k, x in enumerate(languages)}
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            label = np.array([at[x] for x in batch.column("lang").to_pylist()])
            for low, high in K.doc_blocks(offs):
                bucket, bounds = gram_buckets(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low])
                owner = np.repeat(label[low:high], np.diff(bounds))
                total += np.bincount(owner * BUCKETS + bucket[: len(owner)], minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array([x.tobytes() for x in total], pa.binary())], ["lang", "counts"])

    return rows


def _margin_rows(model: LanguageModel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            parts = [model.margins(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in K.doc_blocks(offs)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([x.tobytes() for x in np.concatenate(parts)], pa.binary())], ["lang", "margins"])

    return rows


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learn from ``text`` and ``lang``; None if no row has both."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sample = materialise(sample_classes(rows, "lang", per_language, _SEED).select("lang", "text"), "op4-sample").repartition(12)
    languages = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; MOST_LANGUAGES is {MOST_LANGUAGES}")
    counts = np.zeros((len(languages), BUCKETS))
    for r in sample.mapInArrow(_count_rows(languages), "lang string, counts binary").collect():
        counts[languages.index(r[0])] += np.frombuffer(r[1], np.int64)
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)  # languages count alike
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]))
    smooth = 1.0 / BUCKETS / 50
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        weights[:, b] = np.log((yes + smooth) / (no + smooth))
    model = LanguageModel(languages, weights.astype(np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]), 1.0)
    if len(languages) > 1:
        seen = sample.mapInArrow(_margin_rows(model), "lang string, margins binary").collect()
        truth = np.array([languages.index(r[0]) for r in seen])
        margins = np.array([np.frombuffer(r[1]) for r in seen])
        right = (np.sign(margins) == code[truth]).mean(0)
        model.trust = np.clip(2 * right - 1, 0.05, 1.0)
        best = None
        for scale in (0.5, 1, 2, 4, 8, 16, 32):  # the scale of least log loss
            model.scale = scale
            loss = np.stack([(model.trust * np.logaddexp(0, -scale * margins * row)).sum(1) for row in code.astype(float)], axis=1)
            cost = (loss[np.arange(len(truth)), truth] + np.log(np.exp(-loss).sum(1) + 1e-300)).mean()
            if best is None or cost < best[0]:
                best = (cost, scale)
        model.scale = best[1]
    return model


def _predict_rows(model: LanguageModel, gap: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            letters = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
            for low, high in K.doc_blocks(offs):
                best, chance, lead = model.decode(model.margins(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low]))
                ok = letters[low:high]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array([model.languages[k] if y else "und" for k, y in zip(best.tolist(), ok.tolist(), strict=True)], pa.string()),
                        pa.array(np.where(ok, chance, 0.0)),
                        pa.array(~ok | (lead < gap)),
                    ],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return rows


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: LanguageModel | None, gap: float = GAP) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every whole text."""
    docs = documents(docs)
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    return docs.withColumn("has_letter", has_letter()).mapInArrow(_predict_rows(model, gap), "doc_id long, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs``, all columns, whose prediction is not ``und``.

    Without a model nothing can be rejected but texts without a letter.
    """
    lettered = docs.where(has_letter())
    if model is None:
        return lettered

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            for low, high in K.doc_blocks(offs):
                best, _, _ = model.decode(model.margins(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low]))
                named = np.array([model.languages[k] != "und" for k in best.tolist()])
                yield batch.slice(low, high - low).filter(pa.array(named))

    return lettered.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(id_remainder(4) != 2))
    return predict(docs, model).select("doc_id", (id_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
