"""Evaluation measures over result records.

The data directory has no result records, so these run the same arithmetic over
stand-ins: labels (quality as pass or fail), documents, conversations, events.
The jobs over real records are in :mod:`groundwell.plans.evaluate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compat
from ..plans import compare, evaluate, grounding
from .registry import Tables, query


def _labelled(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query(
    "numeric_tokens_documents",
    f"""
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n, array_to_string(tokens, ' ') AS tokens,
       array_to_string(list_transform(tokens, lambda x: CASE
         WHEN regexp_full_match(x, '{grounding.ISO_DATE}') THEN x
         ELSE concat(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[$€£¥,%]', '', 'g'), '^(-?)0+([0-9])', '\\1\\2'), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''),
                     CASE WHEN ends_with(x, '%') THEN '%' ELSE '' END) END), ' ') AS normal
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{grounding.NUMERIC_TOKEN}') AS tokens FROM documents) d
""",
)
def numeric_tokens_documents(t: Tables) -> DataFrame:
    tokens = grounding.numeric_tokens(F.coalesce("text", F.lit("")))
    rows = t.documents.select("doc_id", tokens.alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"), F.array_join(F.transform("tokens", grounding.normal_form), " ").alias("normal"))


@query(
    "wilson_by_group",
    "SELECT lang, p, n, round((p/n+1.9208/n-1.96*sqrt((p/n)*(1-p/n)/n+0.9604/(n*n)))/(1+3.8416/n),6) AS low, round((p/n+1.9208/n+1.96*sqrt((p/n)*(1-p/n)/n+0.9604/(n*n)))/(1+3.8416/n),6) AS high FROM (SELECT lang, CAST(sum(quality) AS DOUBLE) p, CAST(count(*) AS DOUBLE) n FROM labels l JOIN documents d ON d.doc_id=l.doc_id GROUP BY lang) g",
)
def wilson_by_group(t: Tables) -> DataFrame:
    counts = _labelled(t).groupBy("lang").agg(F.sum("quality").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    low, high = compat.wilson(F.col("p"), F.col("n"))
    return counts.select("lang", "p", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("metric_accuracy", "SELECT CAST(sum(quality) AS BIGINT) AS passes, count(*) AS n, round(avg(quality), 6) AS rate FROM labels")
def metric_accuracy(t: Tables) -> DataFrame:
    return evaluate.rate(t.labels, F.col("quality") == 1, F.lit(True))


@query("metric_answer_rate", "SELECT CAST(count(l.doc_id) AS BIGINT) AS passes, count(*) AS n, round(count(l.doc_id) / count(*), 6) AS rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metric_answer_rate(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return evaluate.rate(joined, F.col("quality").isNotNull(), F.lit(True))


@query("metric_accuracy_by_group", "SELECT source AS grp, CAST(sum(quality) AS BIGINT) AS passes, count(*) AS n, round(avg(quality), 6) AS rate FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY source")
def metric_accuracy_by_group(t: Tables) -> DataFrame:
    return evaluate.rate(_labelled(t).withColumnRenamed("source", "grp"), F.col("quality") == 1, F.lit(True), "grp")


@query("metric_agreement_hist", "SELECT printf('%.2f', a) AS bucket, count(*) AS n FROM (SELECT avg(CASE WHEN role = 'user' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a FROM conversations GROUP BY conv_id) x GROUP BY 1")
def metric_agreement_hist(t: Tables) -> DataFrame:
    per = t.conversations.groupBy("conv_id").agg(F.avg(F.when(F.col("role") == "user", 1.0).otherwise(0.0)).alias("a"))
    return per.groupBy(F.format_string("%.2f", "a").alias("bucket")).agg(F.count("*").alias("n"))


@query("calibration_table", "SELECT CASE WHEN n_chars >= 2000 THEN 'HIGH' WHEN n_chars >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS level, CAST(sum(quality) AS BIGINT) AS passes, count(*) AS n, round(avg(n_chars), 6) AS mean_score FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1")
def calibration_table(t: Tables) -> DataFrame:
    level = F.when(F.col("n_chars") >= 2000, "HIGH").when(F.col("n_chars") >= 500, "MEDIUM").otherwise("LOW")
    return _labelled(t).groupBy(level.alias("level")).agg(F.sum("quality").alias("passes"), F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_score"))


@query("metric_median_floor", "SELECT CAST(floor(quantile_cont(value_ms, 0.5)) AS BIGINT) AS median_ms FROM (SELECT CAST(value * 1000 AS BIGINT) AS value_ms FROM events) x")
def metric_median_floor(t: Tables) -> DataFrame:
    return evaluate.floored_median(t.events.select((F.col("value") * 1000).cast("decimal(20,0)").cast("long").alias("ms")), "ms").withColumnRenamed("median", "median_ms")


@query("agreement_by_group", "SELECT conv_id, round(avg(CASE WHEN role = 'user' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS agreement FROM conversations GROUP BY conv_id")
def agreement_by_group(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.round(F.avg(F.when(F.col("role") == "user", 1.0).otherwise(0.0)), 6).alias("agreement"))


@query("cost_ceil_pricing", "SELECT doc_id, (n_chars * 37 + 999) // 1000 AS micro_usd FROM documents")
def cost_ceil_pricing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", compat.priced(F.col("n_chars"), 37).alias("micro_usd"))


@query("format_money_column", "SELECT o_orderkey, concat('€', format('{:,.2f}', o_totalprice)) AS rendered FROM orders")
def format_money_column(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", compat.money(compat.to_cents(F.col("o_totalprice"))).alias("rendered"))


@query(
    "verdict_classification",
    "SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN expected = 'answer' AND NOT answered THEN 'declined' WHEN expected = 'answer' AND quality = 1 THEN 'match' WHEN expected = 'answer' THEN 'miss' WHEN answered THEN 'false_answer' ELSE 'caught' END AS verdict FROM (SELECT CASE WHEN d.doc_id % 5 = 0 THEN 'refuse' ELSE 'answer' END AS expected, l.doc_id IS NOT NULL AS answered, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) a) b GROUP BY verdict",
)
def verdict_classification(t: Tables) -> DataFrame:
    """Stand-in: labelled documents are the answered ones, quality says whether they match."""
    joined = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    expected = F.when(F.col("doc_id") % 5 == 0, "refuse").otherwise("answer")
    verdict = evaluate.verdict(expected, F.col("quality").isNotNull(), F.col("quality") == 1)
    return joined.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "confidence_batch",
    "SELECT doc_id, round(CASE WHEN w = 0 THEN 0 ELSE s / w END, 4) AS confidence, CASE WHEN w = 0 OR s / w < 0.40 THEN 'ABSTAIN' WHEN s / w >= 0.75 THEN 'HIGH' WHEN s / w >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT d.doc_id AS doc_id, CAST(coalesce(quality * 40, 0) + coalesce((1 - toxic) * 30, 0) + 20 * least(n_chars, 2000) / 2000.0 AS DOUBLE) AS s, CAST(CASE WHEN quality IS NULL THEN 0 ELSE 40 END + CASE WHEN toxic IS NULL THEN 0 ELSE 30 END + 20 AS DOUBLE) AS w FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x",
)
def confidence_batch(t: Tables) -> DataFrame:
    """Stand-in factors; those that are null drop out of both halves of the mean."""
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    factors = [(F.col("quality").cast("double"), 40), ((1 - F.col("toxic")).cast("double"), 30), (F.least("n_chars", F.lit(2000)) / 2000.0, 20)]
    score = evaluate.confidence(factors)
    return joined.select("doc_id", F.round(score, 4).alias("confidence"), evaluate.level(score).alias("level"))


@query("result_digest", None)
def result_digest(t: Tables) -> DataFrame:
    """An order-free digest of rows; its hash is Spark's own, so SQL elsewhere can't repeat it."""
    return compare.digest(t.orders.select("o_custkey", "o_totalprice"))


@query("multiset_balance", "SELECT CAST(count(*) FILTER (WHERE o_totalprice <= 100000) AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right FROM orders")
def multiset_balance(t: Tables) -> DataFrame:
    left = t.orders.select("o_orderkey", "o_totalprice")
    return compare.multiset_differences(left, left.where("o_totalprice > 100000"))
