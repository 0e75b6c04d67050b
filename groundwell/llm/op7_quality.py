"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, and only the bag has a
label.  Every passage is encoded (character classes, word shapes, hashed words,
then one learned layer); gated attention (Ilse et al., 2018) learns from the
document labels how much each passage counts, and a logistic layer scores the
attention-weighted passage representation.

It learns from about ``PER_LABEL`` labelled rows of each label, drawn by id hash
among those not held out; learning and scoring encode every passage.  The
driver keeps the sample's passages in a file and learns from blocks of about
``BLOCK`` passages, whose gradients are summed at each step.  A null or wordless
text is one empty passage.  Without labels of both kinds every score is the share of
label 1 (0.5 without any).  Of labels that repeat an id the greatest counts.  A text of
any length is scored whole, and equal texts have equal scores.  Rows without a doc_id are left out; rows that repeat
an id are scored each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .learning import Adam, id_remainder, sample_classes, sigmoid
from .storage import documents, read_table, small_batches

PER_LABEL = 1500
PASSAGE = 64
BLOCK = 1 << 15
HIDDEN = 24
GATES = 12
EPOCHS = 220

_SEED = 71
_HASHED = 48
_KINDS = 16
_EXTRA = 4
FEATURES = 3 * _KINDS + _EXTRA + _HASHED

#: The kind of every byte.
_KIND = np.full(256, 15, np.uint8)
for _k, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!?", ";:", "|", "#$%&*@^~", "'\"`", "()[]{}<>", "-_=+/\\"]):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[0x80:] = 0  # letters beyond ASCII, mostly


def passage_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and how many each document has."""
    words = K.split_words(data, offs)
    n_words = np.diff(words.first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    rank = np.arange(len(words.doc)) - words.first[words.doc]
    of_word = base[words.doc] + rank // PASSAGE
    begin = np.zeros(total + 1, np.int64)
    begin[-1] = len(data)
    begin[base] = offs[:-1]
    later = (rank % PASSAGE == 0) & (rank > 0)
    begin[of_word[later]] = words.start[later]
    of_byte = np.repeat(np.arange(total), np.diff(begin))
    kind = _KIND[data]

    def shares(owner: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
        count = np.bincount(owner * width + column, minlength=total * width).reshape(total, width)
        return count / np.maximum(count.sum(1, keepdims=True), 1)

    length = words.end - words.start
    words_in = np.maximum(np.bincount(of_word, minlength=total), 1)
    hashed = np.bincount(of_word * _HASHED + (words.hash % K.U64(_HASHED)).astype(np.int64), minlength=total * _HASHED).reshape(total, _HASHED)
    more = np.stack(
        [
            np.log1p(np.diff(begin)),
            np.bincount(of_word, weights=length, minlength=total) / words_in,
            np.bincount(of_word, weights=length.astype(float) ** 2, minlength=total) / words_in,
            hashed.max(1) / words_in,
        ],
        axis=1,
    )
    rows = np.concatenate([shares(of_byte, kind, _KINDS), shares(of_word, kind[words.start], _KINDS), shares(of_word, kind[words.end - 1], _KINDS), more, np.sqrt(hashed / words_in[:, None])], axis=1)
    return rows.astype(np.float32), n_pass


@dataclass
class QualityModel:
    params: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def forward(self, rows: np.ndarray, n_pass: np.ndarray) -> dict[str, np.ndarray]:
        """``rows`` are standardised passages of bags of ``n_pass``."""
        p = self.params
        first = np.cumsum(n_pass) - n_pass
        h = np.tanh(rows @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        top = np.maximum.reduceat(e, first)
        weight = np.exp(e - np.repeat(top, n_pass))
        weight /= np.repeat(np.add.reduceat(weight, first), n_pass)
        z = np.add.reduceat(weight[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "logit": z @ p["c"] + p["b"][0], "first": first}

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        rows, n_pass = passage_features(data, offs)
        return sigmoid(self.forward(((rows - self.mean) / self.spread).astype(np.float32), n_pass)["logit"])


def _blocks(n_pass: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Whole bags of about ``BLOCK`` passages, and their rows."""
    ends = np.cumsum(n_pass)
    low = 0
    while low < len(ends):
        begin = int(ends[low] - n_pass[low])
        high = max(low + 1, int(np.searchsorted(ends, begin + BLOCK, "right")))
        yield slice(low, high), slice(begin, int(ends[high - 1]))
        low = high


def train(rows: np.ndarray, n_pass: np.ndarray, label: np.ndarray, share: float, epochs: int = EPOCHS, rate: float = 0.01, shrink: float = 1e-4) -> QualityModel:
    """Fit on bags; ``share`` is label 1's share among all labels, to which the sample is weighted."""
    rng = np.random.default_rng(_SEED)
    blocks = list(_blocks(n_pass))
    mean = (sum(rows[of].sum(0, dtype=np.float64) for _, of in blocks) / len(rows)).astype(np.float32)
    spread = (np.sqrt(sum(((rows[of] - mean) ** 2).sum(0, dtype=np.float64) for _, of in blocks) / len(rows)) + 1e-3).astype(np.float32)

    def start(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    params = {"w": start(rows.shape[1], HIDDEN), "wb": np.zeros(HIDDEN, np.float32), "v": start(HIDDEN, GATES), "u": start(HIDDEN, GATES), "a": start(GATES), "c": start(HIDDEN), "b": np.array([np.log(share / (1 - share))], np.float32)}
    model, adam = QualityModel(params, mean, spread), Adam(params, rate)
    y = label.astype(np.float32)
    importance = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
    def gradients(bags: slice, of: slice) -> dict[str, np.ndarray]:
        x, n = ((rows[of] - mean) / spread).astype(np.float32), n_pass[bags]
        f = model.forward(x, n)
        d_logit = (importance[bags] * (sigmoid(f["logit"]) - y[bags])).astype(np.float32)
        d_z = d_logit[:, None] * params["c"]
        per = np.repeat(d_z, n, axis=0)
        d_weight = (per * f["h"]).sum(1)
        inner = np.repeat(np.add.reduceat(f["weight"] * d_weight, f["first"]), n)
        d_e = f["weight"] * (d_weight - inner)
        d_t, d_g = d_e[:, None] * params["a"] * f["g"] * (1 - f["t"] ** 2), d_e[:, None] * params["a"] * f["t"] * f["g"] * (1 - f["g"])
        d_h = f["weight"][:, None] * per + d_t @ params["v"].T + d_g @ params["u"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return {"w": x.T @ d_in, "wb": d_in.sum(0), "v": f["h"].T @ d_t, "u": f["h"].T @ d_g, "a": (f["t"] * f["g"]).T @ d_e, "c": f["z"].T @ d_logit, "b": np.array([d_logit.sum()])}

    for _ in range(epochs):
        grads = {k: shrink * p * (k != "b") for k, p in params.items()}
        for bags, of in blocks:
            for k, g in gradients(bags, of).items():
                grads[k] = grads[k] + g
        adam.step(grads)
    return model


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = K.text_bytes(batch.column("text"))
        for low, high in K.doc_blocks(offs):
            feats, n = passage_features(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low])
            bags = [part.tobytes() for part in np.split(feats, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(low, high - low), pa.array(bags, pa.binary())], ["quality", "bag"])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> QualityModel | float:
    """Learn from the ``quality`` labels of ``docs``; a constant score if they are of one kind."""
    docs = documents(docs)
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    marked = docs.select("doc_id").join(marks, "doc_id")
    total, good = marked.agg(F.count("*"), F.sum("quality")).first()
    if not total:
        return 0.5
    if good in (0, total):
        return good / total
    ids = sample_classes(marked, "quality", per_label, _SEED).select("doc_id", "quality")
    sample = docs.join(F.broadcast(ids), "doc_id").select("quality", "text").repartition(48)  # ids: of bounded size
    got = sample.mapInArrow(_bag_rows, "quality int, bag binary").toLocalIterator(prefetchPartitions=True)
    with tempfile.TemporaryFile() as arrived, tempfile.TemporaryFile() as ordered:
        found, at = [], 0
        for label, bag in got:
            arrived.write(bag)
            found.append((hashlib.sha256(bag).digest(), label, at, len(bag)))
            at += len(bag)
        found.sort()  # the same order at every run
        for _, _, at, size in found:
            arrived.seek(at)
            ordered.write(arrived.read(size))
        ordered.flush()
        rows = np.memmap(ordered, np.float32, "r").reshape(-1, FEATURES)
        return train(rows, np.array([f[3] // (4 * FEATURES) for f in found]), np.array([f[1] for f in found]), good / total)


def _score_rows(model: QualityModel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            for low, high in K.doc_blocks(offs):
                score = model.scores(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low]).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(score)], ["doc_id", "score"])

    return rows


def score(docs: DataFrame, model: QualityModel | float) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    docs = documents(docs)
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    return docs.mapInArrow(_score_rows(model), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(id_remainder(3) != 1), read_table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
