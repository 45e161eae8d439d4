"""Queries over blocks between markers, headers, marked rows and files.

Texts are rendered from columns, and read back by what is inferred from the texts alone; the oracles
select the original columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as c
from ..operators import category, lines, profiles, tabular, templates, tokens
from ..sources.documents import read_texts, table, write_records
from .line_jobs import DOC_LINES, VALUES_SQL, column_values


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each customer: a table of orders between markers, with empty cells inside and at the end."""
    k = F.col("o_orderkey")
    line = F.concat(F.rpad(k.cast("string"), 14, " "), F.rpad(F.when(k % 4 == 0, "").otherwise(F.col("o_orderstatus")), 9, " "), F.rpad(F.when(k % 7 == 0, "").otherwise(F.floor("o_totalprice").cast("string")), 12, " "), F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.rtrim(line).alias("line")))).alias("a"))
    head = F.concat(F.lit("intro text\norders of customer "), F.col("o_custkey").cast("string"), F.lit("\norder         status   total       priority\n------------  -------  ----------  ---------------\n"))
    return o.select("o_custkey", F.concat(head, F.array_join(F.transform("a", lambda s: s["line"]), "\n"), F.lit("\nend of orders\n7  X  8  trailing text")).alias("text"))


REPORT_COLUMNS = ["order_no", "status", "total", "priority"]


def table_block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet of the tables in all reports, inferred, compiled and applied to the reports."""
    d = _reports(spark, sf_dir)
    snippet = tabular.block_snippet(d, REPORT_COLUMNS, "orders of", "end of", key="o_custkey", rule=True)
    return templates.parse(d, templates.compile_snippet(snippet), key="o_custkey").drop("record_no", "error")


TABLE_BLOCK_SQL = """
SELECT o_custkey, o_orderkey::VARCHAR AS order_no, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS total, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders
"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of pairs for each customer, between markers, with a line of another separator and a literal one."""
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("ignored: yes\ncard no "), k.cast("string"), F.lit("\nname: "), "c_name", F.lit("  segment: "), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.lit("\nnation = "), F.col("c_nationkey").cast("string"),
        F.lit("\nplain words\nopened: 10:30:00\nnote:"), F.when(k % 2 == 0, "").otherwise(F.lit(" paid late")), F.lit("\nend of card\nname: not this one"),
    )
    # A small file comes in few pieces, and each text costs much more than its bytes.
    return table(spark, sf_dir, "customer").repartition("c_custkey").select("c_custkey", text.alias("text"))


CARD_COLUMNS = ["name", "segment", "nation", "opened", "note"]


def category_block_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each block, with options for one of its lines."""
    return category.block_records(category.block_pairs(_cards(spark, sf_dir), "card no", "end of card", {1: (1, "=")}, 2, key="c_custkey"), CARD_COLUMNS, key="c_custkey")


CATEGORY_BLOCK_SQL = """
SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, c_nationkey::VARCHAR AS nation, '10:30:00' AS opened,
  CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'paid late' END AS note, true AS is_category FROM customer
"""


def category_block_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snippet of all blocks, inferred, compiled and applied to them."""
    d = _cards(spark, sf_dir)
    blocks = category.block_pairs(d, "card no", "end of card", None, 2, key="c_custkey")
    return templates.parse(d, templates.compile_snippet(category.block_template(blocks)), key="c_custkey").drop("record_no", "error")


CATEGORY_ROUNDTRIP_SQL = f"SELECT c_custkey, name, segment, opened, note FROM ({CATEGORY_BLOCK_SQL})"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each turn of the conversations: a pair, and a free line which is that text's own."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL")
    own = F.translate(F.md5("text"), "0123456789", "ghijklmnop")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return t.select(key.alias("note"), F.concat(F.lit("note begins\nrole: "), "role", F.lit("\nsaid "), own, F.lit("\nturn: "), F.col("turn").cast("string"), F.lit("\nnote ends here\n"), own).alias("text"))


def block_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of how many forms of lines 60 rules of each kind are made, and how many lines have them."""
    return category.block_coverage(category.block_pairs(_notes(spark, sf_dir), "note begins", "note ends", key="note"), most=60)


BLOCK_COVERAGE_SQL = """
WITH t AS (SELECT translate(md5(text), '0123456789', 'ghijklmnop') AS form FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL),
f AS (SELECT form, count(*) AS n FROM t GROUP BY form), k AS (SELECT n FROM f ORDER BY n DESC, form LIMIT 60), a AS (SELECT count(*)::BIGINT AS n FROM t)
SELECT 'free' AS kind, (SELECT count(*) FROM f) AS n_forms, n AS n_lines, (SELECT count(*) FROM k) AS forms_kept, (SELECT sum(n)::BIGINT FROM k) AS lines_kept FROM a
UNION ALL SELECT 'pairs', 2, 2 * n, 2, 2 * n FROM a UNION ALL SELECT 'start', 1, n, 1, n FROM a UNION ALL SELECT 'end', 1, n, 1, n FROM a
"""


def bounded_block_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of blocks by a template of 60 rules of each kind at most."""
    d = _notes(spark, sf_dir)
    snippet = category.block_template(category.block_pairs(d, "note begins", "note ends", key="note"), most=60)
    return templates.parse(d, templates.compile_snippet(snippet), key="note").drop("record_no", "error")


BOUNDED_BLOCK_SQL = "SELECT conv_id || '-' || turn AS note, role, turn::VARCHAR AS turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL"


def column_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names from stacked headers, one of which is blank and one repeats."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Order      Last-Change  "), F.rpad("o_orderpriority", 17, " "), F.lit("           Order\n"), F.lit("No. 1      (date)       "), F.rpad(F.lit(""), 17, " "), F.lit("           no\n=========  ===========  ===============  =========  =====\n"), k, F.lit("  x"))
    return tabular.column_names(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), 5, rule=True, key="o_orderkey").select("o_orderkey", F.array_join("names", ",").alias("names"))


COLUMN_HEADERS_SQL = """
SELECT o_orderkey, 'order_no,last_change_date,' || lower(regexp_replace(regexp_replace(o_orderpriority, '[0-9 -]+', '_', 'g'), '^_|_$', '', 'g')) || ',col3,order_no4' AS names FROM orders
"""


def marked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose first cell stands on a line before, and rows whose last cell goes on in further lines."""
    k = F.col("o_orderkey")
    own = F.concat(F.lit("         "), F.rpad("o_orderstatus", 8, " "), F.lit("at home"))
    rows = F.when(k % 3 == 0, F.concat(F.lit("<user-marker-one-line>long name "), k.cast("string"), F.lit("\n"), own)).when(k % 3 == 1, F.concat(F.lit("<user_marker_multi_line>"), F.rpad(F.concat(F.lit("n"), (k % 100).cast("string")), 9, " "), F.rpad("o_orderstatus", 8, " "), F.lit("at home\n                 "), "o_orderpriority", F.lit("\n                  more")))
    rows = rows.otherwise(F.concat(F.rpad(F.concat(F.lit("n"), (k % 100).cast("string")), 9, " "), F.rpad("o_orderstatus", 8, " "), F.lit("at home")))
    text = F.concat(F.lit("name     status  place\n-------- ------- -------------\n"), rows, F.lit("\nlast     Z       there"))
    got = tabular.marked_rows(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), 3, rule=True, key="o_orderkey")
    return got.select("o_orderkey", "row_no", F.array_join("cells", "|").alias("cells"), F.array_join("tails", "|").alias("tails"))


MARKED_ROWS_SQL = """
SELECT o_orderkey, 0::BIGINT AS row_no, CASE WHEN o_orderkey % 3 = 0 THEN 'long name ' || o_orderkey ELSE 'n' || (o_orderkey % 100) END || '|' || o_orderstatus || '|at home' AS cells, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority || '|more' ELSE '' END AS tails FROM orders
UNION ALL SELECT o_orderkey, 1::BIGINT, 'last|Z|there', '' FROM orders
"""


def _ledgers(spark: SparkSession, sf_dir: str, which: list[int]) -> DataFrame:
    """A table for each customer: rows whose first cell has a line of its own, rows whose last cell goes on, and others; marked."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("<user-marker-one-line>special order "), k.cast("string"), F.lit("\n"), F.rpad(F.lit(""), 10, " "))).otherwise(F.concat(F.when(k % 4 == 1, "<user.marker.multi.line>").otherwise(""), F.rpad(k.cast("string"), 10, " ")))
    line = F.concat(name, F.rpad(F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")), 8, " "), "o_orderpriority", F.when(k % 4 == 1, F.concat(F.lit("\n                   clerk "), (k % 10).cast("string"), F.when(k % 8 == 1, "\n                    in person").otherwise(""))).otherwise(""))
    o = table(spark, sf_dir, "orders").where((k % 4).isin(which)).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("a"))
    return o.select("o_custkey", F.concat(F.lit("order     state   notes\n--------- ------- -----\n"), F.array_join(F.transform("a", lambda s: s["line"]), "\n")).alias("text"))


def _read_back(spark: SparkSession, sf_dir: str, which: list[int]) -> DataFrame:
    d = _ledgers(spark, sf_dir, which)
    snippet = tabular.marked_snippet(d, ["order_no", "state", "notes"], key="o_custkey", rule=True)
    # Lines up to the reference row are no rows.
    plain = d.select("o_custkey", F.regexp_replace(tabular.unmarked(F.col("text")), r"\A[^\n]*\n[^\n]*\n", "").alias("text"))
    return templates.parse(plain, templates.compile_snippet(snippet), key="o_custkey")


def marked_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for rows of several lines, inferred from marked tables and applied to the same tables without marks."""
    return _read_back(spark, sf_dir, [0, 1, 2, 3]).select("o_custkey", "order_no", "state", F.array_join("notes", "|").alias("notes"))


MARKED_ROUNDTRIP_SQL = """
SELECT o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'special order ' ELSE '' END || o_orderkey AS order_no, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS state,
  o_orderpriority || CASE WHEN o_orderkey % 4 = 1 THEN '|clerk ' || o_orderkey % 10 || CASE WHEN o_orderkey % 8 = 1 THEN '|in person' ELSE '' END ELSE '' END AS notes
FROM orders
"""


def marked_heads_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for tables of which only first cells stand alone: no lists."""
    return _read_back(spark, sf_dir, [0, 2]).select("o_custkey", "order_no", "state", "notes")


MARKED_HEADS_SQL = f"SELECT * FROM ({MARKED_ROUNDTRIP_SQL.replace('FROM orders', 'FROM orders WHERE o_orderkey % 2 = 0')})"


def picked_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the first line, and those with a word."""
    got = tabular.pick_headers(table(spark, sf_dir, "documents"), [0, "the "])
    return got.select("doc_id", F.size("headers").cast("long").alias("n"), F.md5(F.array_join("headers", "\n")).alias("digest"))


PICKED_HEADERS_SQL = f"""
WITH l AS ({DOC_LINES})
SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM l WHERE line_no = 0 OR contains(line, 'the ') GROUP BY doc_id
"""


def divider_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether most rendered lines start, and end, with a divider."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(F.concat(F.when(k % 3 > 0, " | ").otherwise(""), "p_name", F.lit(" | "), "p_brand", F.when(k % 3 == 0, " |").otherwise("")).alias("line"))
    return tabular.divider_edges(d, "|")


DIVIDER_SIDES_SQL = "SELECT avg((p_partkey % 3 > 0)::INT) > 0.5 AS starts, avg((p_partkey % 3 = 0)::INT) > 0.5 AS ends FROM part"


def files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as text files, one for each nation; the files read whole, parsed, and their records written by
    nation and read again. Files go to the session's shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"
    line = F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"), F.lit(" supplier "), F.col("s_suppkey").cast("string"), F.lit(" "), "s_name")
    own = table(spark, sf_dir, "supplier").select("s_nationkey", line.alias("value"))
    own.repartition("s_nationkey").write.partitionBy("s_nationkey").text(f"{path}/texts")
    docs = read_texts(spark, f"{path}/texts/*")
    t = templates.compile_snippet("nation digits(var_nation) supplier digits(var_supplier) mixed_word(var_name) end() -> Record")
    write_records(templates.parse(docs, t, key="path").select("nation", "supplier", "name"), f"{path}/records", "nation")
    return spark.read.schema("supplier string, name string, nation string").parquet(f"{path}/records")


FILES_SQL = "SELECT s_suppkey::VARCHAR AS supplier, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier"


def line_signature_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signature of the last line but one of each document, or the error that it has none."""
    return lines.signature_at(table(spark, sf_dir, "documents"), -2)


LINE_SIGNATURE_AT_SQL = f"""
WITH l AS ({DOC_LINES}), n AS (SELECT doc_id, max(line_no) - 1 AS at FROM l GROUP BY doc_id),
x AS (SELECT documents.doc_id, line FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN l ON l.doc_id = documents.doc_id AND l.line_no = n.at)
SELECT doc_id, CASE WHEN line IS NOT NULL THEN {lines.signature_sql('line')} END AS signature, CASE WHEN line IS NULL THEN 'line -2 is not there' END AS error FROM x
"""


def slot_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the values of each column have one token or several, and letters alone or none such; and the
    pattern of its slot at its widest."""
    v = column_values(spark, sf_dir).where("value IS NOT NULL")
    several, letters = F.trim("value").rlike("[^ ] +[^ ]"), F.col("value").rlike(r"\A\p{L}+\z")
    # Each different value of a column is looked at once, and the tables are read once. Patterns stand in keys: inside of an
    # aggregate they would be one function, too long for Java to compile.
    kinds = v.select("column_name", "value").distinct().select("column_name", several.alias("several"), F.trim("value").rlike(r"\A[^ ]+\z").alias("one"), letters.alias("letters"), F.when(F.col("value") != "", c.mask(F.col("value"))).alias("mask")).distinct()
    shapes = kinds.groupBy("column_name").agg(F.bool_and("several").alias("is_plural"), F.bool_and("one").alias("is_singular"), F.bool_and(~F.col("letters")).alias("is_not_alphabet"), F.bit_and("mask").alias("mask")).withColumn("actual", c.actual_of(F.col("mask")))
    regexes = {level: profiles.regex(F.col("actual"), F.col("column_name"), level) for level in ("lessen", "root")}
    return shapes.select("column_name", "is_plural", "is_singular", (~F.col("is_plural") & ~F.col("is_singular")).alias("is_mixing"), "is_not_alphabet", regexes["lessen"].alias("lessen"), regexes["root"].alias("root"))


_PATTERNS_SQL = "(VALUES " + ", ".join(f"('{a}', '{c.PATTERN[le]}', '{c.PATTERN[r]}')" for a, _, le, r, _ in c.DIMENSION) + ") AS pat(actual, lessen, root)"
SLOT_SHAPES_SQL = rf"""
WITH v AS (SELECT * FROM ({VALUES_SQL}) WHERE value IS NOT NULL),
s AS (SELECT column_name, bool_and(regexp_matches(trim(value), '[^ ] +[^ ]')) AS is_plural, bool_and(regexp_full_match(trim(value), '[^ ]+')) AS is_singular, bool_and(NOT regexp_full_match(value, '\p{{L}}+')) AS is_not_alphabet, bit_and({c.mask_sql('value')}) AS m FROM v GROUP BY 1)
SELECT column_name, is_plural, is_singular, NOT is_plural AND NOT is_singular AS is_mixing, is_not_alphabet, '(?P<' || column_name || '>' || pat.lessen || ')' AS lessen, '(?P<' || column_name || '>' || pat.root || ')' AS root
FROM s JOIN {_PATTERNS_SQL} ON pat.actual = {c.first_sql('m', 1)}
"""


def token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and picks of tokens as one token, classified anew."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name", F.lit("  "), "p_size", F.lit(" "), "p_brand").alias("line"))
    n = F.size(tokens.tokens_of(F.col("line")))
    both = d.where(n >= 4).select("p_partkey", tokens.joined(F.col("line"), [0, 1]).alias("a"), tokens.joined(F.col("line"), [0, 2, 3], "1").alias("b"))
    return both.select("p_partkey", F.col("a.id").alias("id_a"), F.col("a.class").alias("class_a"), F.col("a.text").alias("text_a"), F.col("b.id").alias("id_b"), F.col("b.class").alias("class_b"), F.col("b.text").alias("text_b"))


TOKEN_JOIN_SQL = f"""
WITH l AS (SELECT p_partkey, p_name || '  ' || p_size || ' ' || p_brand AS line FROM part),
t AS (SELECT p_partkey, regexp_extract_all(line, '[^ ]+ *') AS t FROM l),
j AS (SELECT p_partkey, rtrim(t[1] || t[2]) AS text_a, rtrim(t[1] || t[3] || t[4]) AS text_b FROM t WHERE len(t) >= 4),
m AS (SELECT *, {c.mask_sql('text_a')} AS ma, {c.mask_sql('text_b')} AS mb FROM j)
SELECT p_partkey, 'v0' AS id_a, {c.first_sql('ma', 1)} AS class_a, text_a, 'v10' AS id_b, {c.first_sql('mb', 1)} AS class_b, text_b FROM m
"""


def token_optional_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured tokens that some lines lack."""
    k = F.col("o_orderkey")
    line = F.concat(F.lit("order "), k.cast("string"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("  "), "o_orderstatus")), F.lit(" is"), F.when(k % 4 == 0, "").otherwise(F.lit(" late")))
    d = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return tokens.captured(d, [("=order", None), ("digits", "order_no"), ("letter", "status"), ("=is", None), ("letters", "how")], or_empty=True).drop("line")


TOKEN_OPTIONAL_SQL = "SELECT o_orderkey, o_orderkey::VARCHAR AS order_no, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'late' END AS how FROM orders"

QUERIES = {
    "table_block_roundtrip": table_block_roundtrip, "category_block_records": category_block_records, "category_block_roundtrip": category_block_roundtrip, "column_headers": column_headers, "marked_rows": marked_rows, "block_coverage": block_coverage, "bounded_block_records": bounded_block_records, "marked_roundtrip": marked_roundtrip, "marked_heads_roundtrip": marked_heads_roundtrip,
    "picked_headers": picked_headers, "divider_sides": divider_sides, "files_roundtrip": files_roundtrip, "line_signature_at": line_signature_at, "slot_shapes": slot_shapes, "token_join": token_join, "token_optional_capture": token_optional_capture,
}
ORACLES = {
    "table_block_roundtrip": TABLE_BLOCK_SQL, "category_block_records": CATEGORY_BLOCK_SQL, "category_block_roundtrip": CATEGORY_ROUNDTRIP_SQL, "column_headers": COLUMN_HEADERS_SQL, "marked_rows": MARKED_ROWS_SQL, "block_coverage": BLOCK_COVERAGE_SQL, "bounded_block_records": BOUNDED_BLOCK_SQL, "marked_roundtrip": MARKED_ROUNDTRIP_SQL, "marked_heads_roundtrip": MARKED_HEADS_SQL,
    "picked_headers": PICKED_HEADERS_SQL, "divider_sides": DIVIDER_SIDES_SQL, "files_roundtrip": FILES_SQL, "line_signature_at": LINE_SIGNATURE_AT_SQL, "slot_shapes": SLOT_SHAPES_SQL, "token_join": TOKEN_JOIN_SQL, "token_optional_capture": TOKEN_OPTIONAL_SQL,
}
