"""Schema profiling and integrity jobs, and term search over the declared keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import schema
from ..sources.tables import COLUMNS, FOREIGN_KEYS, PRIMARY_KEYS, TABLES, ForeignKey
from .registry import Tables, query


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _values(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows."""
    return t.spark.createDataFrame(rows, schema)


def row_counts(t: Tables, names: tuple[str, ...]) -> DataFrame:
    """One job; each branch reads no columns, only parquet row counts."""
    return _union([getattr(t, n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names])


@query("card_row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES))
def card_row_counts(t: Tables) -> DataFrame:
    return row_counts(t, TABLES)


_NAMES = "(" + ", ".join(f"'{n}'" for n in TABLES) + ")"


@query("card_tables", f"SELECT table_name, CAST(count(DISTINCT column_name) AS INTEGER) AS n_columns FROM information_schema.columns WHERE table_name IN {_NAMES} GROUP BY table_name")
def card_tables(t: Tables) -> DataFrame:
    """The catalog listing, from the tables' own schemas."""
    return _values(t, [(n, len(getattr(t, n).columns)) for n in sorted(TABLES)], "table_name string, n_columns int")


def _each(t: Tables, profile) -> DataFrame:
    """A profile of every table, beside the table's name."""
    return _union([profile(getattr(t, n)).withColumn("table_name", F.lit(n)) for n in TABLES])


_ALL_COLUMNS = [(n, c) for n, cs in COLUMNS.items() for c in cs]


@query("card_distinct_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM {n}" for n, c in _ALL_COLUMNS))
def card_distinct_counts(t: Tables) -> DataFrame:
    return _each(t, schema.distinct_counts)


@query("card_null_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM {n}" for n, c in _ALL_COLUMNS))
def card_null_counts(t: Tables) -> DataFrame:
    return _each(t, schema.null_counts)


def _samples_sql(n: str, c: str) -> str:
    text = "CAST(v AS VARCHAR)"
    cut = f"CASE WHEN length({text}) > {schema.MAX_CHARS} THEN concat(substring({text}, 1, {schema.MAX_CHARS - len(schema.TRUNCATED)}), '{schema.TRUNCATED}') ELSE {text} END"
    few = f"(SELECT count(DISTINCT {c}) FROM {n}) BETWEEN 1 AND {schema.MAX_DISTINCT}"
    return f"SELECT '{n}' AS table_name, '{c}' AS column_name, {cut} AS sample_value FROM (SELECT DISTINCT {c} AS v FROM {n} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT {schema.MAX_SAMPLES}) x WHERE {few}"


@query("card_sample_values", " UNION ALL ".join(_samples_sql(n, c) for n, c in _ALL_COLUMNS if c not in PRIMARY_KEYS.get(n, ()) and c != "embedding"))
def card_sample_values(t: Tables) -> DataFrame:
    return _union([schema.sample_values(getattr(t, n), PRIMARY_KEYS.get(n, ())).withColumn("table_name", F.lit(n)) for n in TABLES])


def _edges_of(n: str) -> list[ForeignKey]:
    return [k for k in FOREIGN_KEYS if k.table == n]


@query(
    "card_structure_digest",
    "SELECT c.table_name AS table_name, sha256(concat(string_agg(c.column_name, ',' ORDER BY c.ordinal_position), any_value(v.rest))) AS digest FROM (SELECT DISTINCT table_name, column_name, ordinal_position FROM information_schema.columns) c JOIN (VALUES "
    + ", ".join(f"('{n}', '{schema.structure([], PRIMARY_KEYS.get(n, ()), _edges_of(n))}')" for n in TABLES)
    + ") v(table_name, rest) ON v.table_name = c.table_name GROUP BY c.table_name",
)
def card_structure_digest(t: Tables) -> DataFrame:
    """A digest of each table's columns, key and foreign keys; rows do not move it."""
    shapes = [(n, schema.structure(getattr(t, n).columns, PRIMARY_KEYS.get(n, ()), _edges_of(n))) for n in TABLES]
    return _values(t, shapes, "table_name string, shape string").select("table_name", F.sha2("shape", 256).alias("digest"))


def orphans(t: Tables, key: ForeignKey) -> DataFrame:
    """Rows of a foreign key whose target is missing; a null is no orphan."""
    child = getattr(t, key.table).select(F.col(key.column).alias("k")).where("k is not null")
    parent = getattr(t, key.to_table).select(F.col(key.to_column).alias("k"))
    return child.join(parent, "k", "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(f"{key.table}.{key.column}").alias("fk"), "orphans")


@query(
    "fk_orphans",
    " UNION ALL ".join(f"SELECT '{k.table}.{k.column}' AS fk, count(*) AS orphans FROM {k.table} c LEFT JOIN {k.to_table} p ON c.{k.column} = p.{k.to_column} WHERE p.{k.to_column} IS NULL AND c.{k.column} IS NOT NULL" for k in FOREIGN_KEYS),
)
def fk_orphans(t: Tables) -> DataFrame:
    return _union([orphans(t, k) for k in FOREIGN_KEYS])


@query("pk_duplicates", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS repeated FROM (SELECT 1 FROM {n} GROUP BY {', '.join(k)} HAVING count(*) > 1) x" for n, k in PRIMARY_KEYS.items()))
def pk_duplicates(t: Tables) -> DataFrame:
    return _union([getattr(t, n).groupBy(*k).count().where("count > 1").agg(F.count("*").alias("repeated")).select(F.lit(n).alias("table_name"), "repeated") for n, k in PRIMARY_KEYS.items()])


@query("no_ship_before_order", "SELECT count(*) AS lines, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS early FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def no_ship_before_order(t: Tables) -> DataFrame:
    joined = t.lineitem.select("l_orderkey", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.agg(F.count("*").alias("lines"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"))


@query(
    "tokenise_documents",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM documents),
     p AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
     f AS (SELECT doc_id, pos, CASE WHEN length(word) > 3 AND ends_with(word, 's') THEN substring(word, 1, length(word) - 1) ELSE word END AS token FROM p)
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs, CAST(min(pos) AS BIGINT) AS first_position FROM f GROUP BY token""",
)
def tokenise_documents(t: Tables) -> DataFrame:
    """The folded words of all documents: how often, in how many, and how early in any."""
    placed = t.documents.select("doc_id", F.posexplode(schema.words(F.col("text"))).alias("at", "word"))
    own = placed.groupBy(schema.folded(F.col("word")).alias("token"), "doc_id").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return own.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min("at").cast("long").alias("first_position"))


#: Stand-in synonyms: the texts are invented, so common short words name the tables.
SYNONYMS = {"the": "region", "of": "nation", "and": "part", "was": "orders", "der": "customer", "que": "supplier", "under": "lineitem", "for": "documents"}
_TERMS = schema.vocabulary(COLUMNS, SYNONYMS)
_TERMS_SQL = "(VALUES " + ", ".join(f"('{term}', '{name}', {score}, {folded})" for term, name, score, folded in _TERMS) + ") v(term, table_name, weight, folded)"
#: Tables of one slice.
MAX_TABLES = 4
_KEY = ["conv_id", "turn"]
_SCORES_SQL = rf"""
w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS words FROM conversations),
p AS (SELECT conv_id, turn, words, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
c AS (SELECT conv_id, turn, pos, array_to_string(words[pos + 1 : pos + n], '') AS term, false AS folded FROM p, range(1, {schema.COLUMN_WORDS + 1}) r(n) WHERE pos + n <= len(words)
      UNION ALL SELECT conv_id, turn, pos, CASE WHEN length(word) > 3 AND ends_with(word, 's') THEN substring(word, 1, length(word) - 1) ELSE word END, true FROM p),
b AS (SELECT conv_id, turn, table_name, pos, max(weight) AS weight FROM c JOIN {_TERMS_SQL} USING (term, folded) GROUP BY ALL),
scored AS (SELECT conv_id, turn, table_name, CAST(sum(weight) AS BIGINT) AS score, CAST(min(pos) AS BIGINT) AS first_position FROM b GROUP BY ALL)"""


def _scored(t: Tables) -> DataFrame:
    return schema.scores(t.conversations, _KEY, "text", _TERMS)


@query("term_overlap_scores", f"WITH {_SCORES_SQL} SELECT * FROM scored")
def term_overlap_scores(t: Tables) -> DataFrame:
    """Tables that questions name, scored over all questions at once."""
    return _scored(t)


_EDGES = {}
for _k in FOREIGN_KEYS:
    for _pair in ((_k.table, _k.to_table), (_k.to_table, _k.table)):
        _EDGES[_pair] = max(_EDGES.get(_pair, 0), int(not _k.nullable))
_EDGES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {n})" for (a, b), n in sorted(_EDGES.items())) + ") e(seed, table_name, not_null)"
_NEAR_SQL = f"""{_SCORES_SQL},
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, first_position, table_name) AS place FROM scored) x WHERE place <= {MAX_TABLES}),
near AS (SELECT conv_id, turn, e.table_name AS table_name, count(*) AS links, CAST(sum(not_null) AS BIGINT) AS not_null_edges FROM chosen s JOIN {_EDGES_SQL} ON e.seed = s.table_name
         WHERE NOT EXISTS (SELECT 1 FROM chosen o WHERE o.conv_id = s.conv_id AND o.turn = s.turn AND o.table_name = e.table_name) GROUP BY ALL)"""


@query("fk_bridges", f"WITH {_NEAR_SQL} SELECT conv_id, turn, table_name AS bridge, links, not_null_edges FROM near WHERE links >= 2")
def fk_bridges(t: Tables) -> DataFrame:
    """Tables next to two or more of those a question names, and not among them."""
    near = schema.bridges(schema.seeds(_scored(t), _KEY, MAX_TABLES), _KEY, FOREIGN_KEYS)
    return near.where("links >= 2").withColumnRenamed("table_name", "bridge")


@query("fk_neighbours", f"WITH {_NEAR_SQL} SELECT conv_id, turn, table_name AS neighbour FROM near")
def fk_neighbours(t: Tables) -> DataFrame:
    near = schema.bridges(schema.seeds(_scored(t), _KEY, MAX_TABLES), _KEY, FOREIGN_KEYS)
    return near.select(*_KEY, F.col("table_name").alias("neighbour"))


@query(
    "schema_slice",
    f"""WITH {_NEAR_SQL},
pool AS (SELECT conv_id, turn, table_name, 0 AS t, 'seed' AS tier, place AS a, 0 AS b FROM chosen
         UNION ALL SELECT conv_id, turn, table_name, CASE WHEN links >= 2 THEN 1 ELSE 2 END, CASE WHEN links >= 2 THEN 'bridge' ELSE 'neighbour' END, CASE WHEN links >= 2 THEN -links ELSE 0 END, CASE WHEN links >= 2 THEN -not_null_edges ELSE 0 END FROM near)
SELECT conv_id, turn, place, tier, table_name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY t, a, b, table_name) AS place FROM pool) x WHERE place <= {MAX_TABLES}""",
)
def schema_slice(t: Tables) -> DataFrame:
    """The tables for each question: those it names, those that join them, then their neighbours."""
    return schema.sliced(_scored(t), _KEY, FOREIGN_KEYS, MAX_TABLES)
