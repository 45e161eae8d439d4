"""Edit scripts over lines of several kinds.

The sample line of each script is one of the lines themselves, so scripts come from the data; the
oracle selects the columns that the lines were rendered from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits
from ..sources.documents import table

#: Directives by kind of line.
DIRECTIVES = {
    "order": "capture(1,8,12,5,15) keep(4) action(2-split, 3-split-,= 6-split-_left_parenthesis__right_parenthesis_)",
    "part": "capture(1,5 11) keep() action(1:2-join, 8-split-#)",
    "supplier": "capture(7,4) keep() action(1-split-#)",
    "customer": "capture(1,3,6 or_empty) keep() action()",
    "lost": "capture(99) keep() action()",
}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, line: four kinds of lines, mixed."""
    cst, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    kinds = {
        "order": (o, text("order ", F.col("o_orderkey"), " [", F.col("o_orderstatus"), "] for=", F.col("o_custkey"), ", on ", F.date_format("o_orderdate", "yyyy-MM-dd"), " (", F.translate("o_orderpriority", " ", "_"), ")")),
        "part": (table(spark, sf_dir, "part"), text("part ", F.col("p_name"), " has size ", F.col("p_size"), " and brand ", F.col("p_brand"))),
        "supplier": (table(spark, sf_dir, "supplier"), text("supplier ", F.col("s_name"), " of nation ", F.col("s_nationkey"))),
        "customer": (cst, text("customer ", F.col("c_custkey"), " in", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" "), "c_mktsegment")), " segment nation ", F.col("c_nationkey"))),
    }
    return reduce(DataFrame.union, [d.select(F.lit(kind).alias("kind"), line.alias("line")) for kind, (d, line) in kinds.items()])


def _scripts(lines: DataFrame) -> DataFrame:
    """name, spec: the directives of each kind before its longest line; one asks for a token that is not there."""
    spec = reduce(lambda out, kind: F.when(F.col("kind") == kind, F.lit(DIRECTIVES[kind])).otherwise(out), DIRECTIVES, F.lit(None).cast("string"))
    longest = lines.groupBy("kind").agg(F.max_by("line", F.struct(F.length("line"), "line")).alias("line"))
    both = longest.union(longest.where("kind = 'part'").select(F.lit("lost"), "line"))
    return both.select(F.col("kind").alias("name"), F.concat(spec, F.lit(": "), "line").alias("spec"))


def edit_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line's script captures: kind, name of the script, captured texts in order, and how many lines say so."""
    lines = _lines(spark, sf_dir)
    got = edits.captured(lines, edits.compile_scripts(_scripts(lines)))
    return got.select("kind", "name", F.array_join(F.map_values("captured"), "|").alias("captured")).groupBy("kind", "name", "captured").agg(F.count("*").alias("n"))


EDIT_SCRIPTS_SQL = """
WITH c AS (
  SELECT 'order' AS kind, concat_ws('|', o_orderkey, o_orderstatus, o_custkey, strftime(o_orderdate, '%Y-%m-%d'), replace(o_orderpriority, ' ', '_')) AS captured FROM orders
  UNION ALL SELECT 'part', concat_ws('|', p_name, p_size, split_part(p_brand, '#', 2)) FROM part
  UNION ALL SELECT 'supplier', concat_ws('|', split_part(s_name, '#', 2), s_nationkey) FROM supplier
  UNION ALL SELECT 'customer', concat_ws('|', c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, c_nationkey) FROM customer)
SELECT kind, kind AS name, captured, count(*) AS n FROM c GROUP BY ALL
"""


def edit_script_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, snippet, error of every script, and how many lines its kind has."""
    lines = _lines(spark, sf_dir)
    n = lines.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    return edits.compile_scripts(_scripts(lines)).join(F.broadcast(n), "name", "left").select("name", "snippet", "error", "n")


EDIT_SCRIPT_ERRORS_SQL = """
SELECT 'order' AS name, 'order ' || CASE WHEN max(o_orderkey) > 9 THEN 'digits' ELSE 'digit' END || '(var_v1) [letter(var_v8)] for=digits(var_v12), letters() mixed_number(var_v5) (mixed_word(var_v15))' AS snippet, NULL::VARCHAR AS error, count(*) AS n FROM orders
UNION ALL SELECT 'part', 'part phrase(var_v1) has size digits(var_v5) and brand Brand#digits(var_v11)', NULL, count(*) FROM part
UNION ALL SELECT 'supplier', 'supplier Supplier#digits(var_v7) of nation digits(var_v4)', NULL, count(*) FROM supplier
UNION ALL SELECT 'customer', 'customer digits(var_v1, or_empty)zero_or_spaces()in letters(var_v3, or_empty)zero_or_spaces()segment nation digits(var_v6, or_empty)', NULL, count(*) FROM customer
UNION ALL SELECT 'lost', NULL, 'no token v99', NULL
"""

QUERIES = {"edit_scripts": edit_scripts, "edit_script_errors": edit_script_errors}
ORACLES = {"edit_scripts": EDIT_SCRIPTS_SQL, "edit_script_errors": EDIT_SCRIPT_ERRORS_SQL}
