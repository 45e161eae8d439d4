"""Documents of many kinds, parsed by a registry of templates for 400 forms; templates for as many clusters of lines as there are conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as c
from ..operators import clusters, dispatch, templates
from ..sources.documents import explode_lines, table
from .line_jobs import DOC_LINES, SPACE_SQL

FORMS = 400


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, form, text: a report of each conversation in the words of its form."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    form = (F.col("conv_id") % FORMS).cast("string")
    line = F.concat(F.lit("step"), form, F.lit("s "), F.col("turn").cast("string"), F.lit(" by "), "role")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("a"))
    text = F.concat(F.lit("summary of kind "), F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.concat(F.lit("form"), form, F.lit("x"))), F.lit("\nnumber "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join(F.transform("a", lambda s: s["x"]), "\n"), F.lit("\nthe end"))
    return g.select(F.col("conv_id").alias("doc"), form.alias("form"), text.alias("text"))


def _registry(docs: DataFrame) -> DataFrame:
    """name, template: compiled from a snippet for each form that occurs, and one that cannot be read."""
    forms = docs.select("form").distinct()
    snippet = F.concat(F.lit("number digits(var_id, meta_data_filldown) end()\nstep"), "form", F.lit("s digits(var_turn, meta_data_required) by word(var_role) end() -> Record"))
    compiled = templates.compile_all(forms.select(F.concat(F.lit("form-"), "form").alias("name"), snippet.alias("snippet"))).select("name", "template")
    return compiled.union(forms.limit(1).select(F.lit("broken"), F.lit("Value x (")))


def registry_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template that fits each document best; all templates need the word `number`, and a word of their own."""
    docs = _documents(spark, sf_dir)
    return dispatch.best_fit(docs, _registry(docs), key="doc").drop("n_tried")


REGISTRY_BEST_FIT_SQL = f"""
SELECT conv_id AS doc, 'form-' || conv_id % {FORMS} AS name, count(*) AS n_records, count(*) * 3 AS n_values FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL GROUP BY conv_id
"""


def registry_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each document by the template that it names; every fifth names none of the registry."""
    docs = _documents(spark, sf_dir)
    named = docs.withColumn("name", F.concat(F.when(F.col("doc") % 5 == 0, "lost-").otherwise("form-"), "form"))
    got = dispatch.parse_by_name(named, _registry(docs), key="doc")
    return got.select("doc", "name", "record_no", "error", F.col("values")["id"].alias("id"), F.col("values")["turn"].alias("turn"), F.col("values")["role"].alias("role"))


REGISTRY_RECORDS_SQL = f"""
WITH c AS (SELECT conv_id AS doc, conv_id % {FORMS} AS form, turn, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL)
SELECT doc, 'form-' || form AS name, (row_number() OVER (PARTITION BY doc ORDER BY turn) - 1)::BIGINT AS record_no, NULL::VARCHAR AS error, doc::VARCHAR AS id, turn::VARCHAR AS turn, role FROM c WHERE doc % 5 <> 0
UNION ALL SELECT DISTINCT doc, 'lost-' || form, 0::BIGINT, 'no template ''lost-' || form || '''', NULL, NULL, NULL FROM c WHERE doc % 5 = 0
"""

def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, line: a line for each turn of each conversation, which begins with a word of its own."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    # The lines of every seventh conversation begin with blanks, some of them with two.
    lead = F.when(F.col("conv_id") % 7 == 0, F.when(F.col("turn") % 2 == 0, "  ").otherwise(" ")).otherwise("")
    return t.select("conv_id", F.concat(lead, text("call", F.col("conv_id"), "x turn ", F.col("turn"), " by ", F.col("role"), " took ", 1000 + F.col("turn") * 7, " ms")).alias("line"))


def cluster_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for the lines of each conversation: as many clusters as conversations, none of which reaches the driver."""
    return clusters.patterns(_calls(spark, sf_dir), "conv_id").select("conv_id", "n", "snippet", "error")


CLUSTER_TEMPLATES_SQL = f"""
WITH v AS (SELECT conv_id, turn::VARCHAR AS t, role AS r, (1000 + turn * 7)::VARCHAR AS ms FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
k AS (SELECT conv_id, count(*) AS n, count(DISTINCT r) AS roles, min(r) AS role, bit_and({c.mask_sql('t')}) AS mt, bit_and({c.mask_sql('r')}) AS mr, bit_and({c.mask_sql('ms')}) AS mm FROM v GROUP BY conv_id)
SELECT conv_id, n, CASE WHEN n > 1 THEN 'start(' || CASE WHEN conv_id % 7 = 0 THEN 'spaces' ELSE '' END || ') call' || conv_id || 'x turn ' || {c.first_sql('mt', 1)} || '(var_v0) by ' ||
  CASE WHEN roles = 1 THEN role || ' took ' || {c.first_sql('mm', 1)} || '(var_v1)' ELSE {c.first_sql('mr', 1)} || '(var_v1) took ' || {c.first_sql('mm', 1)} || '(var_v2)' END || ' ms end()' END AS snippet,
  CASE WHEN n = 1 THEN 'fewer than two different lines' END AS error FROM k
"""


def class_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents by the classes of their tokens: how many kinds of lines there are, by number of tokens and of lines."""
    lines = explode_lines(table(spark, sf_dir, "documents")).where(F.col("line").rlike("[^ \\t\\n\\x0b\\f\\r]"))
    kinds = lines.groupBy(clusters.class_sequence(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))
    return kinds.groupBy(F.size(F.split("kind", " ")).cast("long").alias("n_tokens"), F.least("n", F.lit(3)).alias("n_lines")).agg(F.count("*").alias("n_kinds"), F.sum("n").alias("n"))


CLASS_CLUSTERS_SQL = f"""
WITH t AS (SELECT doc_id, line_no, unnest(range(0, len(x))) AS i, unnest(x) AS t FROM (SELECT doc_id, line_no, list_filter(string_split_regex(line, '{SPACE_SQL}+'), lambda y: y <> '') AS x FROM ({DOC_LINES}))),
m AS (SELECT doc_id, line_no, i, t, {c.mask_sql('t')} AS m FROM t),
k AS (SELECT doc_id, line_no, i, t, {c.first_sql('m', 0)} AS k FROM m),
l AS (SELECT string_agg(CASE WHEN i = 0 AND k IN ('letter', 'letters') THEN t ELSE coalesce(k, 'other') END, ' ' ORDER BY i) AS kind, count(*) AS n_tokens FROM k GROUP BY doc_id, line_no),
g AS (SELECT kind, n_tokens, count(*) AS n FROM l GROUP BY ALL)
SELECT n_tokens, least(n, 3) AS n_lines, count(*) AS n_kinds, sum(n)::BIGINT AS n FROM g GROUP BY ALL
"""

QUERIES = {"cluster_templates": cluster_templates, "class_clusters": class_clusters, "registry_best_fit": registry_best_fit, "registry_records": registry_records}
ORACLES = {"cluster_templates": CLUSTER_TEMPLATES_SQL, "class_clusters": CLASS_CLUSTERS_SQL, "registry_best_fit": REGISTRY_BEST_FIT_SQL, "registry_records": REGISTRY_RECORDS_SQL}
