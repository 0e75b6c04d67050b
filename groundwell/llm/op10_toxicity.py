"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic rows are positives; everything else, labelled or not, is
unlabelled text that holds toxic rows at the class prior.  A linear classifier on
words and word beginnings that tell the two apart minimises the class-prior-corrected risk

    prior * E_P[loss(f, +)] + max(0, E_X[loss(f, -)] - prior * E_P[loss(f, -)])

(Kiryo et al., 2017): when the second part turns negative the step undoes it.
E_X, the mean over all text, is that over the unlabelled rows and the known
positives, each at its share.

The sample is about ``POSITIVES`` confirmed and ``UNLABELLED`` other rows, drawn
by id hash among those not held out; the prior is the toxic share of all their
labels.  Scoring reads whole texts, all of them.  A null or wordless text has
the score of the bias alone; without any positive every score is 0.  Of labels
that repeat an id the greatest counts.  A text of any length is scored whole, and
equal texts have equal scores; of equally clear terms the lesser hash is taken.  Rows
without a doc_id are left out; rows that repeat an id are scored each; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .learning import Adam, id_remainder, sample_classes, sigmoid
from .storage import documents, materialise, read_table, small_batches

POSITIVES = 1500
UNLABELLED = 4500
#: Byte lengths of word beginnings that are terms beside the whole word.
PREFIXES = (5, 6, 7, 8, 10)
#: A term is a feature at one, two and three or more occurrences.
LEVELS = 3
#: Features differ between positives and others by so many standard errors, ...
MIN_Z = 6.0
#: ... occur in so many sampled rows, and are so many at most, the clearest first.
MIN_ROWS = 8
FEATURES = 3000
EPOCHS = 300
THRESHOLD = 0.3

_SEED = 101


def term_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all words of a block, lower-cased, and of their beginnings."""
    words = K.split_words(data, offs, K.NOT_ALNUM, lower=True)
    total, down = K.prefix_sums(K.LOWER[data])
    docs, hashes = [words.doc], [words.hash]
    length = words.end - words.start
    for n in PREFIXES:
        longer = length > n
        start = words.start[longer]
        with np.errstate(over="ignore"):
            hashes.append(K.mix((total[start + n] - total[start]) * down[start] + K.U64(7919 * n)))
        docs.append(words.doc[longer])
    return np.concatenate(docs), np.concatenate(hashes)


def _counted(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, value) and how often each occurs, up to LEVELS."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.minimum(np.diff(np.append(at, len(doc))), LEVELS)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and term, how many rows (positive, all) have it once, twice, thrice."""
    for batch in batches:
        data, offs = K.text_bytes(batch.column("text"))
        mark = batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)
        for low, high in K.doc_blocks(offs):
            doc, value, count = _counted(*term_hashes(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low]))
            term, inverse = np.unique(value, return_inverse=True)
            columns = [pa.array(K.signed(term))]
            for level in range(1, LEVELS + 1):
                has = count >= level
                columns.append(pa.array(np.bincount(inverse[has & mark[low + doc]], minlength=len(term))))
                columns.append(pa.array(np.bincount(inverse[has], minlength=len(term))))
            yield pa.RecordBatch.from_arrays(columns, ["term", *[f"{x}{k}" for k in range(1, LEVELS + 1) for x in "pa"]])


def select_features(sample: DataFrame, n_positive: int, n_all: int) -> list[tuple[int, int]]:
    """(term, level) of the features that tell positives from other rows."""
    names = [f"{x}{k}" for k in range(1, LEVELS + 1) for x in "pa"]
    counts = sample.mapInArrow(_term_rows, "term long, " + ", ".join(f"{c} long" for c in names))
    counts = counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    levels = counts.select("term", F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"p{k}").alias("p"), F.col(f"a{k}").alias("a")) for k in range(1, LEVELS + 1)])))
    n_other = max(n_all - n_positive, 1)
    share = F.col("a") / n_all
    z = (F.col("p") / max(n_positive, 1) - (F.col("a") - F.col("p")) / n_other) / F.sqrt(share * (1 - share) * (1 / max(n_positive, 1) + 1 / n_other))
    told = levels.where(f"a >= {MIN_ROWS} and a < {n_all}").withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z)
    return [(r[0], r[1]) for r in told.orderBy(F.desc("z"), "term", "level").limit(FEATURES).select("term", "level").collect()]


class ToxicityModel:
    """Sorted terms with a weight at each level, and a bias."""

    _BITS = 18

    def __init__(self, features: list[tuple[int, int]]) -> None:
        at = np.array([t for t, _ in features], np.int64).view(K.U64)
        self.terms = np.unique(at)
        self.rows = np.searchsorted(self.terms, at)
        self.levels = np.array([k - 1 for _, k in features], np.int64)
        self.weights = np.zeros((len(self.terms), LEVELS))
        self.bias = 0.0
        self.maybe = np.zeros(1 << self._BITS, dtype=bool)
        self.maybe[(self.terms >> K.U64(64 - self._BITS)).astype(np.int64)] = True

    def terms_of(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term index, occurrences) of the model's terms in a block."""
        doc, value = term_hashes(data, offs)
        hit = np.flatnonzero(self.maybe[(value >> K.U64(64 - self._BITS)).astype(np.int64)])
        doc, value = doc[hit], value[hit]
        at = np.minimum(np.searchsorted(self.terms, value), max(len(self.terms) - 1, 0))
        same = self.terms[at] == value if len(self.terms) else np.zeros(len(value), bool)
        return _counted(doc[same], at[same])

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        doc, term, count = self.terms_of(data, offs)
        reach = np.cumsum(self.weights, axis=1)
        value = reach[term, count - 1] if len(term) else np.zeros(0)
        return np.bincount(doc, weights=value, minlength=len(offs) - 1) + self.bias


def train(bags: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, known: float, epochs: int = EPOCHS, rate: float = 0.03, shrink: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias from bags of feature indexes; rows that are not positive are unlabelled.

    ``known``: the share of known positives among all rows.
    """
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    feature = np.concatenate([*bags, np.zeros(0, np.int64)]).astype(np.int64)
    p, u = positive.astype(float), (~positive).astype(float)
    p, u = p / max(p.sum(), 1), u / max(u.sum(), 1)
    params = {"w": np.zeros(n_features), "b": np.array([np.log(prior / (1 - prior))])}
    adam = Adam(params, rate)
    for _ in range(epochs):
        f = np.bincount(owner, weights=params["w"][feature], minlength=len(bags)) + params["b"][0]
        s = sigmoid(f)
        as_negative = np.logaddexp(0, f)  # loss(f, -) = log(1 + e^f), loss(f, +) = loss(-f, -)
        part = (1 - known) * u - (prior - known) * p
        negative_risk = (part * as_negative).sum()
        slope = part * s
        slope = slope + prior * p * (s - 1) if negative_risk >= 0 else -slope
        adam.step({"w": np.bincount(feature, weights=slope[owner], minlength=n_features) + shrink * params["w"], "b": np.array([slope.sum()])})
    return params["w"], float(params["b"][0])


def _bag_rows(model: ToxicityModel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full((len(model.terms), LEVELS), -1)
        index[model.rows, model.levels] = np.arange(len(model.rows))
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            for low, high in K.doc_blocks(offs):
                doc, term, count = model.terms_of(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low])
                owner = np.repeat(doc, count)
                level = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                feature = index[np.repeat(term, count), level]
                owner, feature = owner[feature >= 0], feature[feature >= 0]
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(low, high - low), K.list_column(np.bincount(owner, minlength=high - low), pa.array(feature.astype(np.int32)))], ["positive", "features"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel | None:
    """Learn from the ``toxic`` labels of ``docs``; None without any positive."""
    docs = documents(docs)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id").join(marks, "doc_id", "left").withColumn("positive", F.coalesce(F.col("toxic") == 1, F.lit(False)))
    every, total, toxic = rows.agg(F.count("*"), F.count("toxic"), F.sum(F.col("positive").cast("long"))).first()
    if not toxic:
        return None
    prior = min(max(toxic / total, 1e-3), 0.9)
    ids = sample_classes(rows.where("positive"), "positive", positives, _SEED).union(sample_classes(rows.where("not positive"), "positive", unlabelled, _SEED + 1))
    sample = docs.join(F.broadcast(ids.select("doc_id", "positive")), "doc_id").select("positive", "text")  # ids: of bounded size
    sample = materialise(sample, "op10-sample").repartition(12)
    n_positive, n_all = sample.agg(F.sum(F.col("positive").cast("long")), F.count("*")).first()
    features = select_features(sample, n_positive or 0, n_all)
    model = ToxicityModel(features)
    bags, positive = [], []
    for r in sample.mapInArrow(_bag_rows(model), "positive boolean, features array<int>").toArrow().to_batches():
        bags.extend(np.array(x, np.int64) for x in r.column("features").to_pylist())
        positive.extend(r.column("positive").to_pylist())
    order = sorted(range(len(bags)), key=lambda k: (positive[k], bags[k].tobytes()))  # the same order at every run
    weights, model.bias = train([bags[k] for k in order], np.array([positive[k] for k in order], bool), len(features), prior, min(toxic / every, prior))
    model.weights[model.rows, model.levels] = weights
    return model


def _score_rows(model: ToxicityModel):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = K.text_bytes(batch.column("text"))
            for low, high in K.doc_blocks(offs):
                score = sigmoid(model.logits(data[offs[low] : offs[high]], offs[low : high + 1] - offs[low]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(score)], ["doc_id", "score"])

    return rows


def score(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    docs = documents(docs)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    return docs.mapInArrow(_score_rows(model), "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(id_remainder(4) != 2), read_table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
