"""Comparisons of bags, classes recommended from data, predicates over sets of values, tables in every mode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as c
from ..operators import category, profiles, tabular, verify
from ..sources.documents import explode_lines, table
from .line_jobs import _RELATION_SQL, DOC_LINES, SPACE_SQL


def content_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents, some of them lost and some twice, against what they should be, as bags by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    want = d.select("doc_id", "lang", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "line"))
    n = F.when((F.col("doc_id") + F.col("i")) % 11 == 0, 0).when((F.col("doc_id") + F.col("i")) % 7 == 0, 2).otherwise(1)
    got = want.select("lang", "line", F.explode(F.array_repeat(F.lit(1), n))).select("lang", F.concat("line", F.lit(" ")).alias("line"))
    bad = verify.verify_bag(got, want.select("lang", F.trim("line").alias("line")), ["lang"], ["line"])
    return bad.select("lang", F.md5("line").alias("line"), "surplus")


CONTENT_BAG_SQL = f"""
WITH l AS (SELECT lang, trim(line) AS line, (doc_id + line_no) AS k FROM ({DOC_LINES}) JOIN documents USING (doc_id)),
got AS (SELECT lang, line FROM l WHERE k % 11 <> 0 UNION ALL SELECT lang, line FROM l WHERE k % 11 <> 0 AND k % 7 = 0),
want AS (SELECT lang, line FROM l),
more AS (SELECT * FROM got EXCEPT ALL SELECT * FROM want), less AS (SELECT * FROM want EXCEPT ALL SELECT * FROM got)
SELECT lang, md5(line) AS line, count(*)::BIGINT AS surplus FROM more GROUP BY ALL UNION ALL SELECT lang, md5(line), -count(*)::BIGINT FROM less GROUP BY ALL
"""


def recommend_from_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class recommended for the first and the last token of each line, and how often it fits both."""
    lines = explode_lines(table(spark, sf_dir, "documents")).select(F.filter(F.split("line", SPACE_SQL + "+"), lambda t: t != "").alias("t")).where(F.size("t") > 1)
    # Each different pair is classified once.
    pairs = lines.select(F.col("t")[0].alias("a"), F.element_at("t", -1).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return profiles.recommendations(pairs).groupBy("class_a", "class_b", "recommended", "translated").agg(F.sum("n").alias("n"))


RECOMMEND_DATA_SQL = f"""
WITH l AS (SELECT list_filter(string_split_regex(line, '{SPACE_SQL}+'), lambda x: x <> '') AS t FROM ({DOC_LINES})),
p AS (SELECT t[1] AS a, t[-1] AS b, count(*) AS n FROM l WHERE len(t) > 1 GROUP BY ALL),
m AS (SELECT n, {c.mask_sql('a')} AS ma, {c.mask_sql('b')} AS mb FROM p),
k AS (SELECT n, ma & mb AS common, {c.first_sql('ma', 0)} AS class_a, {c.first_sql('mb', 0)} AS class_b FROM m),
r AS (SELECT k.*, rel.recommended FROM k LEFT JOIN {_RELATION_SQL} ON rel.a = class_a AND rel.b = class_b)
SELECT class_a, class_b, recommended, coalesce(CASE recommended {' '.join(f"WHEN '{own}' THEN (common & {sum(1 << k for k, s in enumerate(c.SUBS) if s[0] == own)}) <> 0" for own in c.NAMES)} END, false) AS translated, sum(n)::BIGINT AS n
FROM r GROUP BY ALL
"""

PREDICATES = {
    "group": profiles.is_group, "wide_group": profiles.is_group_with_multi_spaces, "plural": profiles.is_plural, "singular": profiles.is_singular, "mixing": profiles.is_mixing,
    "numeric": profiles.is_numeric, "alphabet": profiles.is_alphabet, "not_alphabet": profiles.is_not_alphabet, "printable": profiles.is_printable, "punctuation": profiles.is_punctuation,
}


def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language, of how many lines the values between commas are plural, numeric and so on."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\r\n|\r|\n")).alias("line")).select("lang", F.filter(F.split("line", ", |,$"), lambda v: v != "").alias("v")).where(F.size("v") > 0)
    return lines.groupBy("lang").agg(F.count("*").alias("n"), *(F.sum(p(F.col("v")).cast("long")).alias(name) for name, p in PREDICATES.items()))


_ALL = lambda p, no="NOT ": f"len(list_filter(v, lambda x: {no}{p})) = 0"
_TOKENS = "regexp_matches(trim(x), '[^ ] +[^ ]')"
_SINGLE = "regexp_full_match(trim(x), '[^ ]+')"
_PRINTABLE = r"(regexp_matches(x, '[\p{C}\p{Zl}\p{Zp}]') OR regexp_matches(replace(x, ' ', ''), '\p{Zs}'))"
VALUE_PREDICATES_SQL = f"""
WITH l AS (SELECT lang, list_filter(string_split_regex(line, ', |,$'), lambda x: x <> '') AS v FROM ({DOC_LINES}) JOIN documents USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT ({_ALL(_TOKENS, '')})) AS "group", count(*) FILTER (WHERE NOT ({_ALL("regexp_matches(trim(x), '[^ ]  +[^ ]')", '')})) AS wide_group, count(*) FILTER (WHERE {_ALL(_TOKENS)}) AS plural, count(*) FILTER (WHERE {_ALL(_SINGLE)}) AS singular,
  count(*) FILTER (WHERE NOT ({_ALL(_SINGLE)}) AND NOT ({_ALL(_TOKENS)})) AS mixing, count(*) FILTER (WHERE {_ALL("regexp_full_match(x, '\\p{N}+')")}) AS numeric, count(*) FILTER (WHERE {_ALL("regexp_full_match(x, '\\p{L}+')")}) AS alphabet, count(*) FILTER (WHERE {_ALL("regexp_full_match(x, '\\p{L}+')", '')}) AS not_alphabet,
  count(*) FILTER (WHERE {_ALL(_PRINTABLE, '')}) AS printable, count(*) FILTER (WHERE {_ALL(_PRINTABLE, '')} AND {_ALL("regexp_full_match(x, '[^\\p{L}\\p{N}]+')")}) AS punctuation
FROM l WHERE len(v) > 0 GROUP BY lang
"""

#: Arguments of parsed() for each mode, the heading that it needs, and how its cells are written side by side.
MODES = {
    "divider": ({"divider": "|"}, "name  | role     | n", "| "), "gaps": ({"divider": "   "}, "name    role       n", "  "), "rule": ({"divider": ""}, "------  ---------  ---", "  "),
    "widths": ({"widths": [8, 11, None]}, "name    role       n", "  "), "reference": ({"divider": "  ", "reference": "------  ---------  ---"}, None, "  "),
}


def parsed_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each conversation, written and read back in each of the modes; cells may be empty."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    out = []
    for mode, (how, head, bar) in MODES.items():
        role = F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("role"))
        width = 8 - len(bar)
        line = F.concat(F.rpad(F.concat(F.lit("t"), F.col("turn").cast("string")), width, " "), F.lit(bar), F.rpad(role, 11 - len(bar), " "), F.lit(bar), (F.col("conv_id") % 7).cast("string"))
        rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("a")).select("conv_id", F.concat(F.lit(head + "\n" if head else ""), F.array_join(F.transform("a", lambda s: s["x"]), "\n")).alias("text"))
        got = tabular.parsed(rows, 3, key="conv_id", **how)
        out.append(got.select(F.lit(mode).alias("mode"), "conv_id", "row_no", F.array_join("cells", "|").alias("cells"), "layout"))
    return reduce(DataFrame.union, out)


PARSED_MODES_SQL = """
SELECT m.mode, conv_id, (row_number() OVER (PARTITION BY m.mode, conv_id ORDER BY turn) - 1)::BIGINT AS row_no, 't' || turn || '|' || CASE WHEN turn % 3 = 2 THEN '' ELSE role END || '|' || conv_id % 7 AS cells, CASE WHEN turn % 3 = 2 THEN '101' ELSE '111' END AS layout
FROM conversations, (VALUES ('divider'), ('gaps'), ('rule'), ('widths'), ('reference')) AS m(mode) WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
"""

def category_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts hold pairs at all, with their values; every third has only words, a time and an address."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    turn = F.col("turn").cast("string")
    pairs = F.concat(F.lit("some words\nspoken by: "), "role", F.lit("\nat 10:20:30 and ::1\nturn(s): "), turn, F.lit("\nturn(s): 99"))
    text = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("words of turn "), turn, F.lit("\nat 10:20:30\n2001:db8::7\n: nothing before"))).otherwise(pairs)
    d = t.select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn).alias("note"), text.alias("text"))
    return category.records(d, ["spoken_by", "turn_s"], key="note")


CATEGORY_FLAGS_SQL = """
SELECT conv_id || '-' || turn AS note, CASE WHEN turn % 3 = 1 THEN '' ELSE role END AS spoken_by, CASE WHEN turn % 3 = 1 THEN '' ELSE turn::VARCHAR END AS turn_s, turn % 3 <> 1 AS is_category
FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
"""

QUERIES = {"category_flags": category_flags, "content_bag": content_bag, "recommend_from_data": recommend_from_data, "value_predicates": value_predicates, "parsed_modes": parsed_modes}
ORACLES = {"category_flags": CATEGORY_FLAGS_SQL, "content_bag": CONTENT_BAG_SQL, "recommend_from_data": RECOMMEND_DATA_SQL, "value_predicates": VALUE_PREDICATES_SQL, "parsed_modes": PARSED_MODES_SQL}
