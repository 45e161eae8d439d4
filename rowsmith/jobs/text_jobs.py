"""Queries that render known columns to text and parse them back, and jobs over the results.

The oracles select the original columns, so that they do not depend on the parsers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as c
from ..operators import category, clusters, mining, profiles, registry, tabular, templates, tokens, verify
from ..sources.documents import table


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))


def kv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pairs on a line; values hold blanks and may be empty."""
    p = _part(spark, sf_dir).select("p_partkey", F.concat(F.lit("part name: "), "p_name", F.lit("  brand: "), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")), F.lit("   size(cm): "), "p_size").alias("line"))
    return category.wide_pairs(p, ["part_name", "brand", "size_cm"], 3).drop("line")


KV_ROUNDTRIP_SQL = "SELECT p_partkey, p_name AS part_name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS brand, p_size::VARCHAR AS size_cm FROM part"


def kv_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of the values of every key that the lines hold."""
    p = _part(spark, sf_dir).select("p_partkey", F.concat(F.lit("name: "), "p_name", F.lit("  type: "), "p_type", F.lit("  size: "), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_size"))).alias("line"))
    return profiles.class_of_sets(category.pairs(p, ["p_partkey"], 3).select("variable", "value"), ["variable"])


KV_KEY_PROFILE_SQL = f"""
WITH v AS (SELECT 'name' AS variable, p_name AS value FROM part UNION ALL SELECT 'type', p_type FROM part UNION ALL SELECT 'size', CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size::VARCHAR END FROM part),
m AS (SELECT variable, count(*) AS n, count(*) FILTER (WHERE value = '') AS n_empty, bit_and(CASE WHEN value <> '' THEN {c.mask_sql('value')} END) AS m FROM v GROUP BY variable)
SELECT variable, n, n_empty, n_empty > 0 AS or_empty, {c.first_sql('m', 0)} AS class, {c.first_sql('m', 1)} AS actual FROM m
"""


def _order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat(F.lit("order report\norder id: "), F.col("o_orderkey").cast("string"), F.lit("\nstatus:"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("   "), "o_orderstatus")), F.lit("\r\nsent at 10:20:30\npriority level: "), "o_orderpriority").alias("text"))


def category_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a document from its lines of one pair each."""
    return category.records(_order_texts(spark, sf_dir), ["order_id", "status", "priority_level"], "o_orderkey")


CATEGORY_RECORDS_SQL = "SELECT o_orderkey, o_orderkey::VARCHAR AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status, o_orderpriority AS priority_level, true AS is_category FROM orders"


def _tables(spark: SparkSession, sf_dir: str, line, head: str) -> DataFrame:
    """A document for each order: a heading, and a line for each of its items."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))
    all_ = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line")))
    return i.groupBy("l_orderkey").agg(all_.alias("a")).select("l_orderkey", F.concat(F.lit(head), F.array_join(F.transform("a", lambda s: s["line"]), "\n")).alias("text"))


def _cell(name: str, width: int):
    return F.rpad(F.col(name).cast("string"), width, " ")


_NAMES = ["line_no", "part", "flag", "supplier"]
_ROW_SQL = """SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey{more}) - 1)::BIGINT AS row_no,
  l_linenumber::VARCHAR AS line_no, l_partkey::VARCHAR AS part, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END AS flag, l_suppkey::VARCHAR AS supplier FROM lineitem"""
TABLE_SQL = _ROW_SQL.format(more=", CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END")


def _flag():
    return F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_returnflag"))


def fixed_width_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(_cell("l_linenumber", 8), _cell("l_partkey", 10), F.rpad(_flag(), 5, " "), F.col("l_suppkey").cast("string"))
    d = _tables(spark, sf_dir, line, "line no part      flag supplier\n")
    return tabular.named(tabular.rows(d, 4, widths=[8, 10, 5, None], key="l_orderkey"), _NAMES)


def pipe_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(_cell("l_linenumber", 7), F.lit("| "), _cell("l_partkey", 8), F.lit("| "), F.rpad(_flag(), 4, " "), F.lit(" | "), F.col("l_suppkey").cast("string"))
    d = _tables(spark, sf_dir, line, "a title\nline no| part    | flag | supplier\n-------+---------+------+---------\n")
    return tabular.named(tabular.rows(d, 4, divider="|", key="l_orderkey"), _NAMES)


def rule_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(_cell("l_linenumber", 8), _cell("l_partkey", 10), F.rpad(_flag(), 5, " "), F.col("l_suppkey").cast("string"))
    d = _tables(spark, sf_dir, line, "line no part      flag supplier\n======= ========= ==== ========\n")
    return tabular.named(tabular.rows(d, 4, rule=True, key="l_orderkey"), _NAMES)


def gap_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(_cell("l_linenumber", 9), _cell("l_partkey", 10), F.rpad(_flag(), 6, " "), F.col("l_suppkey").cast("string"))
    d = _tables(spark, sf_dir, line, "line no  part      flag  supplier\n")
    return tabular.named(tabular.rows(d, 4, gap=2, key="l_orderkey"), _NAMES)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(_cell("l_linenumber", 8), _cell("l_partkey", 10), F.rpad(_flag(), 5, " "), F.col("l_suppkey").cast("string"))
    return tabular.rows(_tables(spark, sf_dir, line, "line no part      flag supplier\n"), 4, widths=[8, 10, 5, None], key="l_orderkey")


def column_width_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.column_profile(_rows(spark, sf_dir))


COLUMN_WIDTH_SQL = f"""
WITH r AS ({TABLE_SQL}),
v AS (SELECT 0 AS column_no, line_no AS cell FROM r UNION ALL SELECT 1, part FROM r UNION ALL SELECT 2, flag FROM r UNION ALL SELECT 3, supplier FROM r),
m AS (SELECT column_no::BIGINT AS column_no, count(*) AS n, count(*) FILTER (WHERE cell = '') AS n_empty, min(length(cell)) AS least_width, max(length(cell)) AS most_width,
  max(CASE WHEN cell = '' THEN 0 ELSE len(string_split(cell, ' ')) END)::BIGINT AS most_items, bit_and(CASE WHEN cell <> '' THEN {c.mask_sql('cell')} END) AS m FROM v GROUP BY 1)
SELECT column_no, n, n_empty, least_width, most_width, most_items, {c.first_sql('m', 0)} AS class, {c.first_sql('m', 1)} AS actual FROM m
"""


def row_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.layouts(_rows(spark, sf_dir))


ROW_LAYOUTS_SQL = f"""
WITH r AS (SELECT CASE WHEN flag = '' THEN '1101' ELSE '1111' END AS layout FROM ({TABLE_SQL})),
g AS (SELECT layout, count(*) AS n FROM r GROUP BY layout)
SELECT layout, n, row_number() OVER (ORDER BY layout DESC) AS rank FROM g
"""

FILLDOWN = """Order digits(var_order_id, meta_data_filldown) letter(var_status, meta_data_filldown)
  item digits(var_part, meta_data_required) from digits(var_supplier) -> Record
"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("  item "), F.col("l_partkey").cast("string"), F.lit(" from "), F.col("l_suppkey").cast("string")).alias("line"))
    items = i.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("line")).alias("a"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(items, "o_orderkey")
    return o.select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus", F.lit("\nsome remark\n"), F.array_join("a", "\n")).alias("text"))


def template_parse_filldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading a document whose values fill down to the records of its items."""
    got = templates.parse(_reports(spark, sf_dir), templates.compile_snippet(FILLDOWN), "o_orderkey")
    return got.select("o_orderkey", "record_no", "order_id", "status", "part", "supplier")


TEMPLATE_FILLDOWN_SQL = """
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY '  item ' || l_partkey || ' from ' || l_suppkey) - 1)::BIGINT AS record_no,
  o_orderkey::VARCHAR AS order_id, o_orderstatus AS status, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supplier
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
"""

def template_parse_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that continue a record are gathered in a list."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit("\n"), F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("  - "), w)), "\n")).alias("text"))
    t = templates.compile_snippet("part digits(var_part_id)\n  - words(var_words, meta_data_list)\n")
    return templates.parse(p, t, "p_partkey").select("p_partkey", "record_no", "part_id", F.array_join("words", "/").alias("words"))


TEMPLATE_CONTINUATION_SQL = "SELECT p_partkey, 0::BIGINT AS record_no, p_partkey::VARCHAR AS part_id, replace(p_name, ' ', '/') AS words FROM part"


def continued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents grouped under the line before that starts with a capital of the plain alphabet."""
    from ..sources.documents import explode_lines

    x = explode_lines(table(spark, sf_dir, "documents"))
    g = tabular.continued(x, ["doc_id"], F.col("line").rlike(r"\A *[A-Z]"))
    return g.select("doc_id", "group_no", "first", F.size("tails").cast("long").alias("n_tails"), F.array_join("tails", "|").alias("tails"))


CONTINUED_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents WHERE text IS NOT NULL)),
g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^ *[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS group_no FROM l),
a AS (SELECT doc_id, group_no::BIGINT AS group_no, list(trim(line) ORDER BY line_no) AS a FROM g WHERE group_no > 0 GROUP BY ALL)
SELECT doc_id, group_no, a[1] AS first, len(a) - 1 AS n_tails, coalesce(array_to_string(a[2:], '|'), '') AS tails FROM a
"""

ITEM = "line digits(var_number) part digits(var_part) end() -> Record\nfree text letters(var_word) end() -> Record\n"


def _item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return i.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 11 == 0, F.concat(F.lit("free text "), "l_returnflag")).otherwise(F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string"))).alias("line"))


def template_parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native path: rules in order over single lines."""
    lines_ = _item_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("line").alias("text"))
    return templates.parse_lines(lines_, templates.compile_snippet(ITEM), "text").select("l_orderkey", "l_linenumber", "text", "number", "part", "word")


PARSE_LINES_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN 'free text ' || l_returnflag ELSE 'line ' || l_linenumber || ' part ' || l_partkey END AS text,
  CASE WHEN l_partkey % 11 = 0 THEN '' ELSE l_linenumber::VARCHAR END AS number, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE l_partkey::VARCHAR END AS part, CASE WHEN l_partkey % 11 = 0 THEN l_returnflag ELSE '' END AS word
FROM lineitem
"""

SNIPPETS = {
    "plain": "lit('name: mixed_words(var_name) end() -> Record')", "pair": "concat('brand ', p_brand, ' size digits(var_size)  type letters(var_type, or_empty) -> Next.Record Start')",
    "none": "lit('just text')", "unknown": "lit('strange(var_x)')",
}


def snippet_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of every part compiled to template text, or to an error."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_brand")
    s = p.select(F.explode(F.array(*(F.struct(F.concat(F.lit(f"{n}-"), "k").alias("name"), F.expr(x if not x.startswith("lit(") else f"concat({x[4:-1]}, '')").alias("snippet")) for n, x in SNIPPETS.items()))).alias("s")).select("s.name", "s.snippet")
    return templates.compile_all(s)


_L = c.PATTERN["letters"]
SNIPPET_COMPILE_SQL = f"""
SELECT 'plain-' || p_partkey AS name, 'Value name ({c.PATTERN["mixed_words"]})' || chr(10) || chr(10) || 'Start' || chr(10) || '  ^name: ${{name}}$$ -> Record' AS template, NULL::VARCHAR AS error FROM part
UNION ALL SELECT 'pair-' || p_partkey, 'Value size ([0-9]+)' || chr(10) || 'Value type (({_L}|))' || chr(10) || chr(10) || 'Start' || chr(10) || '  ^brand ' || p_brand || ' size ${{size}} +type ${{type}} -> Record Start', NULL FROM part
UNION ALL SELECT 'none-' || p_partkey, NULL, 'the snippet has no variable' FROM part
UNION ALL SELECT 'unknown-' || p_partkey, NULL, 'unknown class strange' FROM part
"""


def _defective(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parsed items with planted defects, and the expected ones."""
    want = template_parse_lines(spark, sf_dir).select("l_orderkey", "text", "part").groupBy("l_orderkey", "text").agg(F.max("part").alias("part"))
    got = want.where((F.col("l_orderkey") % 17 != 0) | (F.col("part") == "")).withColumn("part", F.when(F.col("l_orderkey") % 13 == 0, F.concat(F.lit("x"), "part")).otherwise(F.concat(F.lit(" "), "part")))
    return got, want


def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, want = _defective(spark, sf_dir)
    return verify.verify_counts(got, want, "l_orderkey")


_WANT_SQL = f"SELECT l_orderkey, text, max(part) AS part FROM ({PARSE_LINES_SQL}) GROUP BY 1, 2"
VERIFY_COUNTS_SQL = f"""
SELECT l_orderkey, count(*) FILTER (WHERE l_orderkey % 17 <> 0 OR part = '') AS n_parsed, count(*) AS n_expected, count(*) FILTER (WHERE l_orderkey % 17 <> 0 OR part = '') = count(*) AS ok
FROM ({_WANT_SQL}) GROUP BY l_orderkey
"""


def verify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, want = _defective(spark, sf_dir)
    return verify.verify_content(got, want, ["l_orderkey", "text"], ["part"])


VERIFY_CONTENT_SQL = f"""
SELECT l_orderkey, text, l_orderkey % 17 = 0 AND part <> '' AS missing, false AS unexpected, NOT (l_orderkey % 17 = 0 AND part <> '') AS different
FROM ({_WANT_SQL}) WHERE (l_orderkey % 17 = 0 AND part <> '') OR l_orderkey % 13 = 0
"""


def verify_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, want = _defective(spark, sf_dir)
    return verify.verdicts(verify.verify_counts(got, want, "l_orderkey"), verify.verify_content(got, want, ["l_orderkey", "text"], ["part"]), "l_orderkey")


VERDICTS_SQL = f"""
WITH v AS (SELECT l_orderkey, n_parsed, n_expected FROM ({VERIFY_COUNTS_SQL}))
SELECT l_orderkey, n_parsed > 0 AND n_parsed = n_expected AND l_orderkey % 13 <> 0 AS ok,
  CASE WHEN n_parsed = 0 THEN 'no record' WHEN n_parsed <> n_expected THEN 'expected ' || n_expected || ' records, got ' || n_parsed WHEN l_orderkey % 13 = 0 THEN 'content differs' ELSE 'ok' END AS message FROM v
"""

_COVER = ["phrase", "words", "digits", "mixed_phrase"]


def coverage_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that none of some line patterns matches as a whole, by language."""
    d = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\r\n|\r|\n")).alias("line"))
    own = {s[1]: s[2] for s in c.SUBS}
    ok = verify.covered(F.col("line"), [own[n] for n in _COVER])
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum((~ok).cast("long")).alias("n_unmatched"), F.min(F.when(~ok, F.col("line"))).alias("example"), F.bool_and(ok).alias("covered"))


COVERAGE_SQL = r"""
WITH l AS (SELECT lang, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line FROM documents),
m AS (SELECT *, """ + " OR ".join(f"regexp_full_match(line, '{c.PATTERN[n]}')" for n in _COVER) + """ AS ok FROM l)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS n_unmatched, min(line) FILTER (WHERE NOT ok) AS example, bool_and(ok) AS covered FROM m GROUP BY lang
"""


def _registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A registry of the parts, and incoming templates that replace, rename, add and are refused."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    s = lambda x: F.concat(*(F.lit(y) if isinstance(y, str) else y.cast("string") for y in x))
    k = F.col("k")
    old = p.where("k % 2 = 0").select(s(["part.", k]).alias("name"), s(["Value x (", k, ") "]).alias("template"))
    new = p.where("k % 3 = 0").select(
        F.when(k % 4 == 0, s(["part.", k])).otherwise(s(["new-", k])).alias("name"),
        F.when(k % 12 == 0, s(["Value x (", k + 2, ")"])).when(k % 3 == 0, s(["Value x (", F.when(k % 2 == 0, k).otherwise(-k), ")"])).alias("template"),
    )
    return old, new


_REGISTRY_SQL = """
old AS (SELECT 'part.' || p_partkey AS name, 'Value x (' || p_partkey || ') ' AS template, p_partkey AS k FROM part WHERE p_partkey % 2 = 0),
new AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'part.' || p_partkey ELSE 'new-' || p_partkey END AS name,
  'Value x (' || CASE WHEN p_partkey % 12 = 0 THEN p_partkey + 2 WHEN p_partkey % 2 = 0 THEN p_partkey ELSE -p_partkey END || ')' AS template FROM part WHERE p_partkey % 3 = 0)"""


def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.upsert(*_registries(spark, sf_dir))


REGISTRY_UPSERT_SQL = f"""
WITH {_REGISTRY_SQL},
j AS (SELECT n.name, n.template, o.name AS same, h.name AS holder FROM new n LEFT JOIN old o ON o.name = n.name LEFT JOIN old h ON trim(h.template) = trim(n.template)),
s AS (SELECT *, CASE WHEN same IS NOT NULL THEN CASE WHEN holder IS NOT NULL AND holder <> name THEN 'refused' ELSE 'replaced' END WHEN holder IS NOT NULL THEN 'renamed' ELSE 'added' END AS status FROM j)
SELECT name, template, status FROM s WHERE status <> 'refused'
UNION ALL
SELECT o.name, o.template, coalesce((SELECT 'refused' FROM s WHERE s.name = o.name AND s.status = 'refused'), 'kept') FROM old o
WHERE o.name NOT IN (SELECT name FROM s WHERE status = 'replaced') AND o.name NOT IN (SELECT holder FROM s WHERE status = 'renamed')
"""


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = _registries(spark, sf_dir)
    k = F.col("p_partkey").cast("string")
    wanted = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Part "), k)).otherwise(F.concat(F.lit("part."), k)).alias("name"))
    return registry.lookup(wanted, old)


REGISTRY_LOOKUP_SQL = f"""
WITH {_REGISTRY_SQL}, w AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'Part ' || p_partkey ELSE 'part.' || p_partkey END AS name FROM part)
SELECT w.name, o.template, CASE WHEN NOT regexp_full_match(w.name, '[a-z0-9]+([+._-][a-z0-9]+)*') THEN 'INVALID-TEMPLATE-NAME-FORMAT' WHEN o.name IS NOT NULL THEN 'FOUND' ELSE 'NOT_FOUND' END AS status
FROM w LEFT JOIN old o ON o.name = w.name
"""


def _spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(""), F.replace("p_name", F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, "\t").otherwise("  ")), F.lit(" ")).alias("line"))


def whitespace_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.spacing_variants(_spaced(spark, sf_dir))


WHITESPACE_SQL = r"""
WITH l AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE '' END || replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN chr(9) ELSE '  ' END) || ' ' AS line FROM part)
SELECT regexp_replace(line, '[ \t\n\x0b\f\r]+', '', 'g') AS content, count(*) AS n, count(DISTINCT line) AS variants,
  CASE WHEN bool_and(regexp_matches(line, '^[ \t]')) THEN 'always' WHEN bool_or(regexp_matches(line, '^[ \t]')) THEN 'sometimes' ELSE 'never' END AS leading,
  'always' AS trailing, bool_or(regexp_matches(line, '[\t\x0b\f]')) AS tabs
FROM l GROUP BY 1
"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_type", F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string"), F.when(F.col("event_id") % 3 == 0, " again").otherwise(""), F.lit(" with "), "props").alias("line"))


def mined_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed places of the lines of a log, from all its lines."""
    return mining.slots(_logs(spark, sf_dir))


MINED_SLOTS_SQL = f"""
WITH l AS (SELECT event_type || ' by user ' || user_id || CASE WHEN event_id % 3 = 0 THEN ' again' ELSE '' END || ' with ' || props AS line FROM events),
t AS (SELECT string_split(line, ' ') AS t FROM l),
p AS (SELECT t[1] AS cluster, len(t) AS n_tokens, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM t),
g AS (SELECT cluster, n_tokens, pos, count(*) AS n, count(DISTINCT token) AS v, min(token) AS least, bit_and({c.mask_sql('token')}) AS m FROM p GROUP BY 1, 2, 3)
SELECT cluster, n_tokens, pos, n, CASE WHEN v = 1 THEN least END AS literal, CASE WHEN v > 1 THEN {c.first_sql('m', 0)} END AS class, CASE WHEN v > 1 THEN {c.first_sql('m', 1)} END AS actual FROM g
"""


def mined_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.templates(_logs(spark, sf_dir))


MINED_TEMPLATES_SQL = f"""
WITH s AS ({MINED_SLOTS_SQL})
SELECT cluster, n_tokens, max(n) AS n, string_agg(coalesce(literal, actual || '(var_v' || pos || ')'), ' ' ORDER BY pos) AS template FROM s GROUP BY 1, 2
"""


def diff_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets with optional slots from pairs of differing lines, and how many lines of their cluster match."""
    log = _logs(spark, sf_dir)
    found = clusters.patterns(log, "event_type").drop("n")
    # A pattern for each cluster; all lines of the cluster are tested against it.
    tested = log.join(found, "event_type")
    ok = F.coalesce(F.expr("rlike(line, concat('^(?:', regexp_replace(pattern, '[(][?]P<[A-Za-z0-9]+>', '('), ')$'))"), F.lit(False))
    return tested.groupBy("event_type", "snippet", "error").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_matched"))


# The lines are rendered from columns, so the class of each slot is that of its column; users and the word
# behind some of them differ side by side, so they are one slot.
DIFF_TEMPLATES_SQL = f"""
WITH v AS (SELECT event_type, user_id || CASE WHEN event_id % 3 = 0 THEN ' again' ELSE '' END AS u, string_split(props, ' ') AS p FROM events),
w AS (SELECT event_type, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS t FROM v),
k AS (SELECT event_type, i, count(DISTINCT t) AS different, min(t) AS least, bit_and({c.mask_sql('t')}) AS m FROM w GROUP BY 1, 2),
slots AS (SELECT event_type, i, CASE WHEN different = 1 THEN least ELSE {c.first_sql('m', 1)} || '(var_v' || (sum((different > 1)::INT) OVER (PARTITION BY event_type ORDER BY i)) || ')' END AS part FROM k),
props AS (SELECT event_type, string_agg(part, ' ' ORDER BY i) AS props FROM slots GROUP BY 1),
u AS (SELECT event_type, count(*) AS n, bit_and({c.mask_sql('u')}) AS m FROM v GROUP BY 1)
SELECT event_type, 'start() ' || event_type || ' by user ' || {c.first_sql('m', 1)} || '(var_v0) with ' || props || ' end()' AS snippet, NULL::VARCHAR AS error, n, n AS n_matched
FROM u JOIN props USING (event_type)
"""


def token_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of customer lines with their names and classes."""
    cst = table(spark, sf_dir, "customer").repartition("c_custkey").select("c_custkey", F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("line"))
    t = cst.select("c_custkey", F.posexplode(tokens.symbolised(F.col("line"))).alias("pos", "t"))
    return t.select("c_custkey", F.col("pos").cast("long").alias("pos"), "t.id", "t.class", "t.text")


TOKEN_SYMBOLS_SQL = f"""
WITH t AS (SELECT c_custkey, unnest(range(0, 3)) AS pos, unnest([c_name, 'of', c_mktsegment]) AS text FROM customer)
SELECT c_custkey, pos, 'v' || pos AS id, {c.first_sql(c.mask_sql('text'), 1)} AS class, text FROM (SELECT * FROM t)
""".replace(c.first_sql(c.mask_sql('text'), 1), c.first_sql('m', 1)).replace("(SELECT * FROM t)", f"(SELECT *, {c.mask_sql('text')} AS m FROM t)")


def token_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`Customer#000000001` cut at its separator, the parts classified anew."""
    t = table(spark, sf_dir, "customer").select("c_custkey", tokens.split_token(F.col("c_name"), "#").alias("t"))
    return t.select("c_custkey", F.col("t")[0].alias("kind"), F.col("t")[1].alias("separator"), F.col("t")[2].alias("number"), c.actual_of(c.mask(F.col("t")[2])).alias("class"))


TOKEN_SPLIT_SQL = "SELECT c_custkey, split_part(c_name, '#', 1) AS kind, '#' AS separator, split_part(c_name, '#', 2) AS number, 'digits' AS class FROM customer"


def token_join_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured tokens of all log lines that match an edited line, and a run of tokens joined."""
    log = _logs(spark, sf_dir).select("line")
    got = tokens.captured(log, [("letters", "event"), ("=by", None), ("=user", None), ("digits", "user"), ("=with", None), ("mixed_word", "first"), ("mixed_word", "second")])
    return got.select("event", "user", "first", "second", tokens.join_tokens(F.col("line"), 1, 3).alias("joined")).groupBy("event", "user", "first", "second", "joined").agg(F.count("*").alias("n"))


TOKEN_CAPTURE_SQL = """
SELECT event_type AS event, user_id::VARCHAR AS user, split_part(props, ' ', 1) AS first, split_part(props, ' ', 2) AS second, 'by user ' || user_id AS joined, count(*) AS n
FROM events WHERE event_id % 3 <> 0 AND regexp_full_match(event_type, '[a-zA-Z]+') GROUP BY ALL
"""

def kv_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snippet for the lines of pairs, from the classes of all their values."""
    p = _part(spark, sf_dir).select("p_partkey", F.concat(F.lit("name: "), "p_name", F.lit("  type: "), "p_type", F.lit("  size: "), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_size"))).alias("line"))
    return category.block_snippet(category.pairs(p, ["p_partkey"], 3))


KV_SNIPPET_SQL = f"""
SELECT string_agg(variable || ': ' || actual || '(var_' || variable || CASE WHEN or_empty THEN ', or_empty' ELSE '' END || ')', '  ' ORDER BY list_position(['name', 'type', 'size'], variable)) AS snippet FROM ({KV_KEY_PROFILE_SQL})
"""


def column_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment and width of columns: one to the left, one to the right, one in between, the last open."""
    line = F.concat(_cell("l_linenumber", 6), F.lpad(F.col("l_partkey").cast("string"), 8, " "), F.lit("   "), F.rpad(F.concat(F.repeat(F.lit(" "), F.col("l_linenumber") % 3), F.col("l_returnflag")), 6, " "), F.col("l_suppkey").cast("string"))
    d = _tables(spark, sf_dir, line, "line  part       flag  supplier\n")
    return tabular.column_alignment(tabular.rows(d, 4, widths=[6, 11, 6, None], key="l_orderkey"))


COLUMN_ALIGNMENT_SQL = """
WITH i AS (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
c AS (
  SELECT 0 AS column_no, 0 AS l, length(l_linenumber::VARCHAR) AS w, place FROM i UNION ALL SELECT 1, 14 - length(l_partkey::VARCHAR), length(l_partkey::VARCHAR), place FROM i
  UNION ALL SELECT 2, 17 + l_linenumber % 3, length(l_returnflag), place FROM i UNION ALL SELECT 3, 23, length(l_suppkey::VARCHAR), place FROM i),
n AS (SELECT column_no, w, count(*) AS n, min(place) AS first FROM c GROUP BY ALL),
o AS (SELECT column_no, w AS mode FROM n QUALIFY row_number() OVER (PARTITION BY column_no ORDER BY n DESC, first) = 1),
k AS (SELECT column_no, max(w) AS most, count(*) AS kinds, ceil(sum(w * n) / sum(n)) AS mean FROM n GROUP BY column_no),
m AS (SELECT * FROM k JOIN o USING (column_no)),
e AS (SELECT column_no, count(DISTINCT l) = 1 AS one_left, count(DISTINCT l + w) = 1 AS one_right FROM c GROUP BY column_no)
SELECT column_no::BIGINT AS column_no, CASE WHEN one_left THEN 'left' WHEN one_right THEN 'right' ELSE 'center' END AS alignment,
  (CASE WHEN kinds = 1 OR (NOT one_left AND one_right) OR (one_left AND mode = most) THEN most ELSE mean END)::BIGINT AS width
FROM m JOIN e USING (column_no)
"""


def table_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line rule for each layout of the rows."""
    return tabular.table_snippets(_rows(spark, sf_dir), _NAMES)


# Where the flag is missing, part ends at 8 and its length, and supplier starts at 23; one blank on either
# side of the stretch is text.
TABLE_SNIPPET_SQL = f"""
WITH p AS (SELECT max(actual) FILTER (WHERE column_no = 0) AS a, max(actual) FILTER (WHERE column_no = 1) AS b, max(actual) FILTER (WHERE column_no = 2) AS c, max(actual) FILTER (WHERE column_no = 3) AS d FROM ({COLUMN_WIDTH_SQL})),
w AS (SELECT 13 - max(length(part)) AS least, 13 - min(length(part)) AS most FROM ({TABLE_SQL}) WHERE flag = '')
SELECT layout, rank, 'start() ' || a || '(var_line_no)  ' || b || '(var_part)' || CASE WHEN layout = '1111' THEN '  ' || c || '(var_flag)  ' ELSE ' space(repetition_' || least || '_' || most || ') ' END || d || '(var_supplier) end() -> Record' AS snippet
FROM ({ROW_LAYOUTS_SQL}), p, w
"""

QUERIES = {
    "kv_snippet": kv_snippet, "column_alignment": column_alignment, "table_snippet": table_snippet,
    "kv_roundtrip": kv_roundtrip, "kv_key_profile": kv_key_profile, "category_records": category_records, "fixed_width_roundtrip": fixed_width_roundtrip, "pipe_table_roundtrip": pipe_table_roundtrip,
    "rule_table_roundtrip": rule_table_roundtrip, "gap_table_roundtrip": gap_table_roundtrip, "column_width_profile": column_width_profile, "row_layouts": row_layouts,
    "template_parse_filldown": template_parse_filldown, "template_parse_continuation": template_parse_continuation, "continued_lines": continued_lines, "template_parse_lines": template_parse_lines, "snippet_compile": snippet_compile,
    "verify_counts": verify_counts, "verify_content": verify_content, "verify_verdicts": verify_verdicts, "coverage_unmatched": coverage_unmatched, "registry_upsert": registry_upsert, "registry_lookup": registry_lookup,
    "whitespace_variants": whitespace_variants, "mined_slots": mined_slots, "mined_templates": mined_templates, "diff_templates": diff_templates, "token_symbols": token_symbols, "token_split": token_split, "token_join_capture": token_join_capture,
}
ORACLES = {
    "kv_snippet": KV_SNIPPET_SQL, "column_alignment": COLUMN_ALIGNMENT_SQL, "table_snippet": TABLE_SNIPPET_SQL,
    "kv_roundtrip": KV_ROUNDTRIP_SQL, "kv_key_profile": KV_KEY_PROFILE_SQL, "category_records": CATEGORY_RECORDS_SQL, "fixed_width_roundtrip": TABLE_SQL, "pipe_table_roundtrip": TABLE_SQL,
    "rule_table_roundtrip": TABLE_SQL, "gap_table_roundtrip": TABLE_SQL, "column_width_profile": COLUMN_WIDTH_SQL, "row_layouts": ROW_LAYOUTS_SQL,
    "template_parse_filldown": TEMPLATE_FILLDOWN_SQL, "template_parse_continuation": TEMPLATE_CONTINUATION_SQL, "continued_lines": CONTINUED_SQL, "template_parse_lines": PARSE_LINES_SQL, "snippet_compile": SNIPPET_COMPILE_SQL,
    "verify_counts": VERIFY_COUNTS_SQL, "verify_content": VERIFY_CONTENT_SQL, "verify_verdicts": VERDICTS_SQL, "coverage_unmatched": COVERAGE_SQL, "registry_upsert": REGISTRY_UPSERT_SQL, "registry_lookup": REGISTRY_LOOKUP_SQL,
    "whitespace_variants": WHITESPACE_SQL, "mined_slots": MINED_SLOTS_SQL, "mined_templates": MINED_TEMPLATES_SQL, "diff_templates": DIFF_TEMPLATES_SQL, "token_symbols": TOKEN_SYMBOLS_SQL, "token_split": TOKEN_SPLIT_SQL, "token_join_capture": TOKEN_CAPTURE_SQL,
}
