"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII
characters.  An item's windows are its ``WINDOW`` consecutive words; an item of
fewer words, but not none, is one window.  A document word inside any occurrence
of a window is hit.

1. A window's fingerprint is the least hash of its ``GRAM``-word grams.  Equal
   windows have equal fingerprints, so every shared span of a window's length
   or more is found; neighbouring windows mostly share theirs, so a document
   keeps few.
2. Document and item fingerprints are joined; this leaves few documents, whose
   texts are read again for the positions of the fingerprints that met.
3. From each such position, paired with each position of that gram in an item,
   the span of equal words is extended to both sides as far as a window can
   reach.  A span of a window's length or more is hit, word by word, so neither
   hashes nor ties between them decide anything.

The benchmark side is broadcast only while it takes ``BROADCAST_BYTES`` at most,
as counted; beyond that both joins shuffle, with documents dealt over ``SALTS``
salts, so a passage that many documents hold stays in no single task.

Inside, a row's name is its doc_id and its ``mark``, a hash of its text: rows
that repeat an id with another text are documents of their own, and copies have
the same hits.  Items that repeat an id count once.  A text may have any length.
A null text has no words.  Rows without a doc_id (or item_id) are left out.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import documents, materialise, read_table

WINDOW = 10
GRAM = 5
#: Bytes of the benchmark's grams and their surroundings that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Parts that a fingerprint's documents are dealt into where the benchmark is not broadcast.
SALTS = 64

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """The words, with A-Z lower-cased (``lower`` would change other letters too)."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _positions(n: Column, length: int) -> Column:
    """Starts of windows of ``length`` words among ``n``; none if there are fewer."""
    return F.when(n >= length, F.sequence(F.lit(0), F.greatest(n - length, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _with_fingerprints(df: DataFrame, length: int, gram: int, to: str) -> DataFrame:
    """Adds ``to``: the fingerprint of every window of ``length`` words, from ``hashes``."""
    gram = min(gram, length)
    grams = f"{to}_grams"
    n = F.size("hashes")
    h, g = F.col("hashes"), F.col(grams)
    df = df.withColumn(grams, F.transform(_positions(n, gram), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(gram)])))
    span = length - gram + 1
    least = (lambda i: F.least(*[F.get(g, i + k) for k in range(span)])) if span > 1 else (lambda i: F.get(g, i))
    return df.withColumn(to, F.transform(_positions(n, length), least))


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _runs_once(values: Column) -> Column:
    """Without repeats of the value before."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.get(values, i - 1)))


def _grams_met(size: int, reach: int, met: Column) -> Column:
    """Positions of grams of ``size`` words whose hash is in ``met``, with up to ``reach`` words on both sides, nearest first."""
    words, h = F.col("words"), F.col("hashes")
    grams = F.transform(_positions(F.size(words), size), lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get(h, i + k) for k in range(size)]).alias("fingerprint")))
    found = F.filter(grams, lambda g: F.array_contains(met, g["fingerprint"]))

    def around(g: Column) -> Column:
        before = F.least(g["at"], F.lit(reach))
        left = F.reverse(F.slice(words, g["at"] - before + 1, before))
        right = F.slice(words, g["at"] + size + 1, reach)
        return F.struct(g["at"].alias("at"), F.lit(size).alias("size"), g["fingerprint"].alias("fingerprint"), F.slice(words, g["at"] + 1, size).alias("gram"), left.alias("left"), right.alias("right"))

    return F.transform(found, around)


def item_grams(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(item_id, length, size, fingerprint, gram, left, right)``: of every item, the
    grams that are some window's fingerprint, with the words beside them that a window can reach."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text").cast("string")).alias("words"))
    words = materialise(words.where(F.size("words") > 0), "op6-items")
    lengths = [r[0] for r in words.where(F.size("words") < window).select(F.size("words")).distinct().collect()]  # less than a window's
    out = None
    for length in [window, *sorted(lengths)]:
        size = min(gram, length)
        these = words.where(F.size("words") >= window) if length == window else words.where(F.size("words") == length)
        these = _with_fingerprints(_hashed(these), length, gram, "marks")
        part = these.select("item_id", F.lit(length).alias("length"), F.inline(_grams_met(size, length - size, F.array_distinct("marks")))).drop("at").distinct()
        out = part if out is None else out.unionByName(part)
    return out


def _equal_ahead(one: str, two: str, reach: int) -> Column:
    """How many leading words of two arrays are equal."""
    if reach == 0:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(reach - 1)), F.lit(0), lambda n, k: F.when((n == k) & (F.get(one, k) == F.get(two, k)), n + 1).otherwise(n))


def _joined(left: DataFrame, items: DataFrame, by: list[str], small: bool, how: str = "inner") -> DataFrame:
    """``left`` beside the items: broadcast, or shuffled by key and salt."""
    if small:
        return left.join(F.broadcast(items), by, how)
    left = left.withColumn("salt", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SALTS)).cast("int"))
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(items, [*by, "salt"], how).drop("salt")


def window_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, n_words)`` of all rows, and ``(doc_id, mark, start, end, item_id)``
    of spans that together cover every occurrence of an item's window."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    docs = documents(docs).withColumn("mark", F.xxhash64("text"))
    grams = materialise(item_grams(items, window, gram), "op6-grams")
    n_bytes = grams.agg(F.sum(F.octet_length(F.concat_ws(" ", "gram", "left", "right")) + 16 * 2 * window + 64)).first()[0] or 0
    small = n_bytes <= broadcast_bytes
    sizes = [tuple(r) for r in grams.select("length", "size").distinct().collect()] or [(window, gram)]
    lengths = sorted(length for length, _ in sizes)

    marks = _hashed(docs.select("doc_id", "mark", "text").withColumn("words", _words(F.col("text"))))
    for k in lengths:
        marks = _with_fingerprints(marks, k, gram, f"m{k}")
    kept = F.array_distinct(F.concat(*[_runs_once(F.col(f"m{k}")) for k in lengths])) if len(lengths) > 1 else _runs_once(F.col(f"m{lengths[0]}"))
    marks = materialise(marks.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), kept.alias("marks")), "op6-marks")

    met = _joined(marks.select("doc_id", "mark", F.explode("marks").alias("fingerprint")), grams.select("fingerprint").distinct(), ["fingerprint"], small, "left_semi")
    met = met.groupBy("doc_id", "mark").agg(F.collect_set("fingerprint").alias("met"))

    near = _hashed(docs.join(met, ["doc_id", "mark"]).withColumn("words", _words(F.col("text"))))
    reach = {size: max(length - size for length, s in sizes if s == size) for _, size in sizes}
    places = [_grams_met(size, most, F.col("met")) for size, most in sorted(reach.items())]
    places = near.select("doc_id", "mark", F.inline(F.concat(*places) if len(places) > 1 else places[0]))
    theirs = grams.select("item_id", "length", "size", "fingerprint", F.col("gram").alias("item_gram"), F.col("left").alias("item_left"), F.col("right").alias("item_right"))
    pairs = _joined(places, theirs, ["fingerprint", "size"], small).where("gram = item_gram")
    most = max(reach.values())
    spans = pairs.withColumn("back", _equal_ahead("left", "item_left", most)).withColumn("ahead", _equal_ahead("right", "item_right", most))
    spans = spans.where(F.col("back") + F.col("size") + F.col("ahead") >= F.col("length"))
    hits = spans.select("doc_id", "mark", (F.col("at") - F.col("back")).alias("start"), (F.col("at") + F.col("size") + F.col("ahead")).alias("end"), "item_id")
    return marks.select("doc_id", "mark", "n_words"), hits


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, mark, n_words, n_hit, n_items, items, contaminated)``, one row a document row.

    ``items`` lists the items with occurring windows, sorted as strings; ``mark``
    is :func:`xxhash64` of the text.
    """
    sizes, hits = window_hits(docs, items, window, gram, broadcast_bytes)
    hits = materialise(hits, "op6-hits")
    row = ["doc_id", "mark"]
    before = F.coalesce(F.max("end").over(Window.partitionBy(*row).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.col("before")))
    covered = hits.select(*row, "start", "end").distinct().withColumn("before", before).groupBy(*row).agg(F.sum(fresh).alias("n_hit"))
    named = hits.groupBy(*row).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = sizes.join(covered, row, "left").join(named, row, "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*row, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS span
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, p.n AS n, item_id FROM place p JOIN win USING (n, span)),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)
"""
