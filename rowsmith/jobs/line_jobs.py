"""Queries over lines, tokens and values, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as c
from ..functions.lattice import RELATION
from ..operators import lines as ln
from ..operators import profiles as pr
from ..sources.documents import explode_lines, table

SQL_LINES = r"SELECT {key}, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT {key}, string_split_regex(text, '\r\n|\r|\n') AS l FROM {table} WHERE text IS NOT NULL)"
DOC_LINES = SQL_LINES.format(key="doc_id", table="documents")
SPACE_SQL = r"[ \t\n\x0b\f\r]"


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(table(spark, sf_dir, "documents"))


LINE_EXPLODE_SQL = f"SELECT doc_id, line_no::BIGINT AS line_no, line FROM ({DOC_LINES})"


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = d.select("lang", F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))
    n = lambda x: F.sum(x.cast("long"))
    x = F.col("line")
    return lines.groupBy("lang").agg(
        F.count("*").alias("n_lines"), n(ln.is_empty(x)).alias("n_empty"), n(ln.is_word(x)).alias("n_words"), n(ln.has_no_letter(x)).alias("n_no_letter"), n(ln.is_symbols(x)).alias("n_symbols"),
        n(ln.is_clock_or_address(x)).alias("n_clock"), F.sum(F.length(ln.leading(x))).alias("leading"), F.sum(F.length(ln.trailing(x))).alias("trailing"),
    )


LINE_KINDS_SQL = rf"""
WITH l AS (SELECT lang, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, regexp_replace(line, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') AS x FROM l)
SELECT lang, count(*) AS n_lines, count(*) FILTER (WHERE x = '') AS n_empty,
  count(*) FILTER (WHERE regexp_full_match(x, '[A-Za-z][A-Za-z0-9_]*')) AS n_words,
  count(*) FILTER (WHERE regexp_full_match(x, '[^a-zA-Z0-9]+')) AS n_no_letter,
  count(*) FILTER (WHERE regexp_full_match(line, ' *{c.PUNCT}+( +{c.PUNCT}+)* *')) AS n_symbols,
  count(*) FILTER (WHERE regexp_matches(line, '[0-9]+(:[0-9]+)+') OR regexp_matches(line, '^([0-9a-fA-F]{{2}}([:-][0-9a-fA-F]{{2}}){{5}}|[0-9a-fA-F]{{1,4}}(:[0-9a-fA-F]{{1,4}}){{7}})')
    OR regexp_full_match(line, '([0-9a-fA-F]{{1,4}}:)*:([0-9a-fA-F]{{1,4}}(:[0-9a-fA-F]{{1,4}})*)?') OR starts_with(line, '::') OR ends_with(line, '::')) AS n_clock,
  sum(length(regexp_extract(line, '^{SPACE_SQL}*')))::BIGINT AS leading,
  sum(CASE WHEN x = '' THEN 0 ELSE length(regexp_extract(line, '{SPACE_SQL}*$')) END)::BIGINT AS trailing
FROM s GROUP BY lang
"""


def signatures(lines: DataFrame) -> DataFrame:
    """signature, n, example: how often each line template occurs, and its least line."""
    return lines.groupBy(ln.signature(F.col("line")).alias("signature")).agg(F.count("*").alias("n"), F.min("line").alias("example"))


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "conversations").select("text"))
    return texts.select(F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))


def line_signatures_topk(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    """The k most frequent line templates of documents and conversations."""
    return signatures(_all_lines(spark, sf_dir)).orderBy(F.desc("n"), "signature").limit(k)


LINE_SIGNATURES_SQL = rf"""
WITH l AS (SELECT unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) WHERE text IS NOT NULL)
SELECT {ln.signature_sql('line')} AS signature, count(*) AS n, min(line) AS example FROM l GROUP BY 1 ORDER BY n DESC, signature LIMIT 100
"""


def token_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", r"[ \t\n\x0b\f\r]+")).alias("value")).where("value <> ''")
    # Each distinct token is matched once.
    counts = tokens.groupBy("lang", "value").agg(F.count("*").alias("n"))
    return pr.classified(counts).groupBy("lang", "class").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


TOKEN_CLASS_SQL = rf"""
WITH t AS (SELECT lang, unnest(string_split_regex(text, '{SPACE_SQL}+')) AS value FROM documents),
d AS (SELECT lang, value, count(*) AS n FROM t WHERE value <> '' GROUP BY ALL),
m AS (SELECT *, {c.mask_sql('value')} AS m FROM d)
SELECT lang, {c.first_sql('m', 0)} AS class, sum(n)::BIGINT AS n, count(*) AS n_distinct FROM m GROUP BY 1, 2
"""

#: Columns of the relational tables as text: (table, name, Spark expression, DuckDB expression)
COLUMNS = [
    ("part", "p_partkey", "cast(p_partkey as string)", "p_partkey::VARCHAR"), ("part", "p_name", "p_name", "p_name"), ("part", "p_brand", "p_brand", "p_brand"), ("part", "p_type", "p_type", "p_type"), ("part", "p_size", "cast(p_size as string)", "p_size::VARCHAR"),
    ("orders", "o_orderstatus", "o_orderstatus", "o_orderstatus"), ("orders", "o_orderdate", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"), ("orders", "o_orderpriority", "o_orderpriority", "o_orderpriority"),
    ("customer", "c_name", "c_name", "c_name"), ("customer", "c_mktsegment", "c_mktsegment", "c_mktsegment"), ("events", "event_type", "event_type", "event_type"), ("events", "props", "props", "props"),
    ("documents", "lang", "lang", "lang"), ("documents", "source", "source", "source"), ("pages", "url", "url", "url"),
]
_PER_TABLE = {t: [(n, s, q) for t2, n, s, q in COLUMNS if t2 == t] for t in dict.fromkeys(x[0] for x in COLUMNS)}


def column_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """column, value of all COLUMNS; one scan a table."""
    out = None
    for t, own in _PER_TABLE.items():
        pairs = ", ".join(f"'{n}', {s}" for n, s, _ in own)
        rows = table(spark, sf_dir, t).selectExpr(f"stack({len(own)}, {pairs}) AS (column_name, value)")
        out = rows if out is None else out.union(rows)
    return out


VALUES_SQL = " UNION ALL ".join(f"SELECT '{n}' AS column_name, {q} AS value FROM {t}" for t, n, _, q in COLUMNS)


def column_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each column from all its values, with its wider names and its snippet."""
    p = pr.with_names(pr.class_of_sets(column_values(spark, sf_dir), ["column_name"]))
    return p.select("column_name", "n", "n_empty", "or_empty", "class", "actual", "lessen", "root", pr.snippet(F.col("actual"), F.col("column_name"), F.col("or_empty")).alias("snippet"))


_DIMENSION_SQL = "(VALUES " + ", ".join(f"('{a}', '{le}', '{r}')" for a, _, le, r, _ in c.DIMENSION) + ") AS dim(actual, lessen, root)"
PROFILE_SQL = f"""
SELECT column_name, count(*) AS n, count(*) FILTER (WHERE coalesce(value, '') = '') AS n_empty, bit_and(CASE WHEN coalesce(value, '') <> '' THEN {c.mask_sql('value')} END) AS m
FROM ({VALUES_SQL}) GROUP BY column_name"""
COLUMN_CLASS_SQL = f"""
WITH p AS (SELECT column_name, n, n_empty, n_empty > 0 AS or_empty, {c.first_sql('m', 0)} AS class, {c.first_sql('m', 1)} AS actual FROM ({PROFILE_SQL}))
SELECT column_name, n, n_empty, or_empty, class, p.actual, lessen, root, p.actual || '(var_' || column_name || CASE WHEN or_empty THEN ', or_empty' ELSE '' END || ')' AS snippet
FROM p LEFT JOIN {_DIMENSION_SQL} ON dim.actual = p.actual
"""


def class_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every two columns the relation of their classes and the class recommended for both."""
    # A row for each column: the pairs do not grow with the data.
    p = pr.class_of_sets(column_values(spark, sf_dir), ["column_name"]).select("column_name", "class")
    one = p.select(F.collect_list(F.struct("column_name", "class")).alias("all"))
    pairs = one.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).select(F.col("x.column_name").alias("column_a"), F.col("y.column_name").alias("column_b"), F.col("x.class").alias("a"), F.col("y.class").alias("b"))
    return pr.recommended_for(pairs)


_RELATION_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {str(s).lower()}, {str(p).lower()}, {repr(r) if r else 'NULL'})" for a, b, s, p, r in RELATION) + ") AS rel(a, b, is_subset, is_superset, recommended)"
CLASS_RECOMMEND_SQL = f"""
WITH p AS (SELECT column_name, {c.first_sql('m', 0)} AS class FROM ({PROFILE_SQL}))
SELECT rel.a, rel.b, x.column_name AS column_a, y.column_name AS column_b, is_subset, is_superset, recommended
FROM p x, p y, {_RELATION_SQL} WHERE rel.a = x.class AND rel.b = y.class
"""


def slot_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each column a value of one token, one of several, and what kinds of characters it holds."""
    top = column_values(spark, sf_dir).where("value IS NOT NULL").groupBy("column_name").agg(
        F.array_compact(F.array(F.min("value"), F.min(F.when(F.trim("value").contains(" "), F.col("value"))))).alias("v"),
        F.bool_and(F.col("value").rlike(r"\A\p{N}+\z")).alias("numeric"), F.bool_and(F.col("value").rlike(r"\A\p{L}+\z")).alias("alphabetic"), F.bool_or(F.trim("value").rlike("[^ ] +[^ ]")).alias("is_group"), F.bool_or(F.trim("value").rlike("[^ ]  +[^ ]")).alias("is_wide_group"),
    )
    return top.select("column_name", pr.singular(F.col("v")).alias("singular"), pr.plural(F.col("v")).alias("plural"), "numeric", "alphabetic", "is_group", "is_wide_group")


SLOT_SAMPLES_SQL = rf"""
WITH v AS ({VALUES_SQL}),
s AS (
  SELECT column_name, min(value) AS a, min(value) FILTER (WHERE contains(trim(value), ' ')) AS b, bool_and(regexp_full_match(value, '\p{{N}}+')) AS numeric, bool_and(regexp_full_match(value, '\p{{L}}+')) AS alphabetic,
    bool_or(regexp_matches(trim(value), '[^ ] +[^ ]')) AS is_group, bool_or(regexp_matches(trim(value), '[^ ]  +[^ ]')) AS is_wide_group
  FROM v WHERE value IS NOT NULL GROUP BY column_name),
t AS (SELECT *, regexp_extract(trim(a), '^[^ ]*') AS singular FROM s)
SELECT column_name, singular, coalesce(b, singular || ' ' || singular) AS plural, numeric, alphabetic, is_group, is_wide_group FROM t
"""

START, END = "--regex the|des", "--wildcard [[:digit:]]"


def marker_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document from the first with a start marker to before the first with a digit."""
    return ln.between(table(spark, sf_dir, "documents"), START, END)


MARKER_SLICE_SQL = f"""
WITH l AS ({DOC_LINES}),
m AS (SELECT doc_id, min(line_no) FILTER (WHERE regexp_matches(line, '(?i)the|des')) AS a, min(line_no) FILTER (WHERE regexp_matches(line, '[0-9]')) AS b FROM l GROUP BY doc_id)
SELECT doc_id, line_no::BIGINT AS line_no, line FROM l JOIN m USING (doc_id) WHERE line_no >= coalesce(a, 0) AND (b IS NULL OR line_no < b)
"""


def category_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines without the start line, as key and value blocks are cut."""
    return ln.between(table(spark, sf_dir, "documents"), START, END, inclusive=False)


CATEGORY_SLICE_SQL = f"""
WITH l AS ({DOC_LINES}),
m AS (SELECT doc_id, min(line_no) FILTER (WHERE regexp_matches(line, '(?i)the|des')) AS a, min(line_no) FILTER (WHERE regexp_matches(line, '[0-9]')) AS b FROM l GROUP BY doc_id)
SELECT doc_id, line_no::BIGINT AS line_no, line FROM l JOIN m USING (doc_id)
WHERE line_no >= coalesce(a + 1, 0) AND (b IS NULL OR (a > 0 AND b > 0 AND a >= b) OR line_no < b)
"""

QUERIES = {
    "line_explode": line_explode, "line_kinds": line_kinds, "line_signatures_topk": line_signatures_topk, "token_class_counts": token_class_counts, "column_class": column_class,
    "class_recommend": class_recommend, "slot_samples": slot_samples, "marker_slice": marker_slice, "category_slice": category_slice,
}
ORACLES = {
    "line_explode": LINE_EXPLODE_SQL, "line_kinds": LINE_KINDS_SQL, "line_signatures_topk": LINE_SIGNATURES_SQL, "token_class_counts": TOKEN_CLASS_SQL, "column_class": COLUMN_CLASS_SQL,
    "class_recommend": CLASS_RECOMMEND_SQL, "slot_samples": SLOT_SAMPLES_SQL, "marker_slice": MARKER_SLICE_SQL, "category_slice": CATEGORY_SLICE_SQL,
}
