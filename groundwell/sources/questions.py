"""Question files, one JSON object a line, and what can be wrong with them.

Every rule is a predicate over the lines, so a file of any size is checked in one
pass, with two grouped counts for repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys of a question and the words that its tags and its expectation are made of.
REQUIRED = ("id", "question", "tags", "expected", "notes")
OPTIONAL = ("reference_sql", "ordered")
TAGS = {
    "kind": ("scalar", "list", "grouped", "top_n", "time_window", "join", "negation"),
    "difficulty": ("easy", "medium", "hard"),
    "trap": ("hallucination_bait", "ambiguity", "unsafe"),
}
EXPECTED = ("answer", "abstain", "refuse")
#: What is expected of each trap; of no trap, an answer.
OF_TRAP = {"hallucination_bait": "abstain", "ambiguity": "abstain", "unsafe": "refuse"}
_SCHEMA = "id string, question string, tags array<string>, expected string, notes string, reference_sql string, ordered string"


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def _of(prefix: str) -> Column:
    """The words of the tags with a prefix."""
    return F.transform(F.filter("tags", lambda t: t.startswith(f"{prefix}:")), lambda t: F.substring(t, F.lit(len(prefix) + 2), F.length(t)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.json_object_keys("value").alias("keys"), F.from_json("value", _SCHEMA).alias("q"))
    rows = parsed.select("keys", "q.*").withColumn("tags", F.transform("tags", F.trim)).withColumn("id", F.trim("id"))
    for name in TAGS:
        rows = rows.withColumn(f"{name}s", F.coalesce(_of(name), F.array().cast("array<string>")))
    return rows.withColumn("asked", F.lower(F.regexp_replace(F.trim("question"), r"\s+", " ")))


def _not_in(known: tuple[str, ...]):
    return lambda word: ~word.isin(*known)


def _rules() -> dict[str, Column]:
    """What is wrong with a line, by the name of the fault."""
    trap = F.get("traps", F.lit(0))
    wanted = F.coalesce(F.create_map(*[F.lit(x) for pair in OF_TRAP.items() for x in pair])[trap], F.lit("answer"))
    answers = F.col("expected") == "answer"
    rules = {
        "no object": F.col("keys").isNull(),
        "id is not snake case": ~F.coalesce(F.col("id").rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), F.lit(False)),
        "missing key": F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), "keys")) > 0,
        "unknown key": F.size(F.array_except("keys", F.array(*map(F.lit, REQUIRED + OPTIONAL)))) > 0,
        "empty text": _blank("question") | _blank("notes"),
        "tag without a known prefix": F.exists("tags", lambda t: ~F.coalesce(t.rlike(f"^({'|'.join(TAGS)}):"), F.lit(False))),
        "more than one trap": F.size("traps") > 1,
        "unknown expectation": ~F.coalesce(F.col("expected").isin(*EXPECTED), F.lit(False)),
        "expectation and trap disagree": F.col("expected") != wanted,
        "answer without reference": answers & _blank("reference_sql"),
        "reference of a trap": ~answers & F.col("reference_sql").isNotNull(),
        "order is not true or false": F.col("ordered").isNotNull() & ~F.col("ordered").isin("true", "false"),
        "order of a trap": ~answers & (F.col("ordered") == "true"),
    }
    for name in ("kind", "difficulty"):
        rules[f"not one {name}"] = F.size(f"{name}s") != 1
    for name, known in TAGS.items():
        rules[f"unknown {name}"] = F.exists(f"{name}s", _not_in(known))
    return rules


def faults(spark: SparkSession, path: str) -> DataFrame:
    """``(id, fault)`` of everything that is wrong with a question file."""
    rows = _lines(spark, path)
    named = F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(name)) for name, wrong in _rules().items()])
    found = rows.select("id", F.explode(F.array_compact(named)).alias("fault"))
    for column, name in (("id", "id repeats"), ("asked", "question repeats")):
        again = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.max("id").alias("last")).where("n > 1")
        found = found.unionByName(again.select(F.col("last").alias("id"), F.lit(name).alias("fault")))
    return found


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``(id, question, tags, kind, difficulty, trap, expected, reference_sql, ordered, notes)``; a file with any fault, or without a question, is refused."""
    wrong = faults(spark, path).orderBy("id", "fault").limit(5).collect()  # a few for the message
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(f"{r.id}: {r.fault}" for r in wrong))
    rows = _lines(spark, path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no questions")
    words = [F.get(f"{name}s", F.lit(0)).alias(name) for name in TAGS]
    sql = F.regexp_replace(F.trim("reference_sql"), r"\s+", " ").alias("reference_sql")
    return rows.select("id", F.trim("question").alias("question"), "tags", *words, "expected", sql, F.coalesce(F.col("ordered") == "true", F.lit(False)).alias("ordered"), F.trim("notes").alias("notes"))
