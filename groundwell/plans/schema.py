"""Schema profiles, and the tables that a question names.

Profiles read every column of a table: one pass counts nulls, one grouped count
of (column, value) pairs gives exact distinct counts, combined before the
shuffle and with no expansion per column.  Term search scores all questions of a
table at once against a small vocabulary made from declared names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ForeignKey

#: Which columns show sample values, how many, and how long.
MAX_SAMPLES, MAX_DISTINCT, MAX_CHARS, TRUNCATED = 5, 20, 40, "…"
#: What a match is worth, and the most words of a column name.
TABLE_SCORE, COLUMN_SCORE, COLUMN_WORDS = 3, 1, 4
#: Texts of more characters are told apart by their digest.
LONG_VALUE = 64


def _value(field: T.StructField) -> Column:
    """A value as text that is equal for equal values only."""
    text = F.col(field.name).cast("string")
    if isinstance(field.dataType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
        return F.when(F.length(text) > LONG_VALUE, F.concat(F.lit("\\0"), F.sha2(text, 256))).otherwise(text)
    return text


def null_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_rows, n_null)`` of every column."""
    row = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{k}") for k, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col("n_rows"), F.col(f"_{k}").alias("n_null")) for k, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*pairs)))


def distinct_counts(df: DataFrame) -> DataFrame:
    """``(column_name, n_distinct)`` of every column; nulls do not count."""
    pairs = [F.struct(F.lit(f.name).alias("column_name"), _value(f).alias("value")) for f in df.schema.fields]
    named = df.sparkSession.createDataFrame([(c, None) for c in df.columns], "column_name string, value string")  # so that empty tables have rows
    values = df.select(F.inline(F.array(*pairs))).unionByName(named).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return values.groupBy("column_name").agg(F.count("value").alias("n_distinct"))


def sample_values(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``(column_name, sample_value)``: of columns with few distinct values and no part
    in the key, the first ones in their order, cut to a length.

    The counts decide first; then only sets of ``MAX_DISTINCT`` values at most are gathered.
    """
    counts = {r.column_name: r.n_distinct for r in distinct_counts(df).collect()}  # a row for each column
    few = [f for f in df.schema.fields if f.name not in key and 0 < counts.get(f.name, 0) <= MAX_DISTINCT and isinstance(f.dataType, T.AtomicType)]
    if not few:
        return df.sparkSession.createDataFrame([], "column_name string, sample_value string")

    def cut(v: Column) -> Column:
        text = v.cast("string")
        return F.when(F.length(text) > MAX_CHARS, F.concat(F.substring(text, 1, MAX_CHARS - len(TRUNCATED)), F.lit(TRUNCATED))).otherwise(text)

    row = df.agg(*[F.transform(F.slice(F.array_sort(F.collect_set(f.name)), 1, MAX_SAMPLES), cut).alias(f.name) for f in few])
    pairs = [F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("values")) for f in few]
    return row.select(F.inline(F.array(*pairs))).select("column_name", F.explode("values").alias("sample_value"))


def structure(columns: list[str], key: tuple[str, ...], edges: list[ForeignKey]) -> str:
    """A table's shape in one line: columns in their order, key, foreign keys."""
    named = [f"{e.column}>{e.to_table}.{e.to_column}:{'null' if e.nullable else 'not null'}" for e in sorted(edges, key=lambda e: e.column)]
    return ";".join([",".join(columns), ",".join(key), ",".join(named)])


def words(text: Column) -> Column:
    """The words of a text in order, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def folded(word: Column) -> Column:
    """A word without one trailing s, if more than three characters long."""
    return F.when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def _fold(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def vocabulary(columns: dict[str, tuple[str, ...]], synonyms: dict[str, str]) -> list[tuple[str, str, int, bool]]:
    """``(term, table, score, folded)``: table names and synonyms by folded words, columns by joined words."""
    unknown = set(synonyms.values()) - set(columns)
    if unknown:
        raise ValueError(f"synonyms for tables that are not there: {sorted(unknown)}")
    terms = {(_fold(name.lower()), name, TABLE_SCORE, True) for name in columns}
    terms |= {(_fold(word.lower()), name, TABLE_SCORE, True) for word, name in synonyms.items()}
    for name, cs in columns.items():
        for c in cs:
            terms |= {(c.lower().replace("_", ""), name, COLUMN_SCORE, f) for f in (False, True)}
    return sorted(terms)


def scores(questions: DataFrame, key: list[str], text: str, terms: list[tuple[str, str, int, bool]]) -> DataFrame:
    """``(*key, table_name, score, first_position)``: the evidence of each question for each table it names.

    At one place a table counts once, by its best match.
    """
    known = questions.sparkSession.createDataFrame(terms, "term string, table_name string, weight int, folded boolean")
    spans = F.transform(F.sequence(F.lit(1), F.lit(COLUMN_WORDS)), lambda n: F.when(F.col("at") + n <= F.size("words"), F.array_join(F.slice("words", F.col("at") + 1, n), "")))
    placed = questions.select(*key, words(F.col(text)).alias("words")).select(*key, "words", F.posexplode("words").alias("at", "word"))
    plain = F.transform(spans, lambda s: F.struct(s.alias("term"), F.lit(False).alias("folded")))
    both = F.concat(plain, F.array(F.struct(folded(F.col("word")).alias("term"), F.lit(True).alias("folded"))))
    found = placed.select(*key, "at", F.inline(both)).where("term is not null").join(F.broadcast(known), ["term", "folded"])  # declared names only
    best = found.groupBy(*key, "table_name", "at").agg(F.max("weight").alias("weight"))
    return best.groupBy(*key, "table_name").agg(F.sum("weight").alias("score"), F.min("at").cast("long").alias("first_position"))


def _edges(df: DataFrame, keys: tuple[ForeignKey, ...]) -> DataFrame:
    both: dict[tuple[str, str], bool] = {}
    for k in keys:
        for pair in ((k.table, k.to_table), (k.to_table, k.table)):
            both[pair] = both.get(pair, False) or not k.nullable
    return df.sparkSession.createDataFrame([(a, b, int(n)) for (a, b), n in sorted(both.items())], "seed string, table_name string, not_null int")


def seeds(scored: DataFrame, key: list[str], most: int) -> DataFrame:
    """Adds ``place``, from 1: tables by score, then first mention, then name; ``most`` of each question."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "first_position", "table_name")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def bridges(chosen: DataFrame, key: list[str], keys: tuple[ForeignKey, ...]) -> DataFrame:
    """``(*key, table_name, links, not_null_edges)``: tables beside two or more chosen ones, and not chosen."""
    near = chosen.select(*key, F.col("table_name").alias("seed")).join(F.broadcast(_edges(chosen, keys)), "seed")  # declared keys only
    linked = near.groupBy(*key, "table_name").agg(F.count("*").alias("links"), F.sum("not_null").alias("not_null_edges"))
    return linked.join(chosen.select(*key, "table_name"), [*key, "table_name"], "left_anti")


def sliced(scored: DataFrame, key: list[str], keys: tuple[ForeignKey, ...], most: int) -> DataFrame:
    """``(*key, place, tier, table_name)``: chosen tables, then bridges, then neighbours, ``most`` of each question.

    Bridges come by links, then edges that drop no rows, then name; neighbours by name.
    """
    chosen = seeds(scored, key, most)
    near = bridges(chosen, key, keys)
    tier = F.when(F.col("links") >= 2, F.lit("bridge")).otherwise(F.lit("neighbour"))
    near = near.select(*key, "table_name", tier.alias("tier"), F.when(F.col("links") >= 2, -F.col("links")).otherwise(F.lit(0)).alias("a"), F.when(F.col("links") >= 2, -F.col("not_null_edges")).otherwise(F.lit(0)).alias("b"))
    top = chosen.select(*key, "table_name", F.lit("a seed").alias("tier"), F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    order = Window.partitionBy(*key).orderBy("tier", "a", "b", "table_name")  # a seed, bridge, neighbour
    placed = top.unionByName(near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.select(*key, F.col("place").cast("long").alias("place"), F.when(F.col("tier") == "a seed", "seed").otherwise(F.col("tier")).alias("tier"), "table_name")
