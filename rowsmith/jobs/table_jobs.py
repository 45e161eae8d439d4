"""Templates over tables of lines, in whatever order they are stored.

The lines are those of conversations: a heading for each turn, what is said line by line, and an end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import line_tables, templates
from ..sources.documents import lines_of, table

#: A heading whose values fill down, lines below it.
HEADED = "turn digits(var_turn, meta_data_filldown) word(var_role, meta_data_filldown) end()\n> something(var_said, meta_data_required) end() -> Record"
#: The same with a state inside turns, their lines gathered in a list, and an end of each.
STATES = """Start
turn digits(var_turn) word(var_role) end() -> Said
Said
> something(var_said, meta_data_list) end()
done digits() end() -> Record Start"""
#: Places that a turn takes up.
TURN = 1_000_000


def _lines(spark: SparkSession, sf_dir: str, close: bool = False) -> DataFrame:
    """doc, place, line: the parts of all turns as three tables behind one another, so that rows stand in no order."""
    t = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    place = F.col("turn").cast("long") * TURN
    said = t.select("conv_id", "turn", F.posexplode(lines_of(F.col("text"))).alias("i", "x"))
    out = said.select(F.col("conv_id").alias("doc"), (place + 1 + F.col("i")).alias("place"), F.concat(F.lit("> "), "x").alias("line"))
    out = out.union(t.select("conv_id", place, text("turn ", F.col("turn"), " ", F.col("role"))))
    return out.union(t.select("conv_id", place + TURN - 1, text("done ", F.col("turn")))) if close else out


def line_table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation: lines sorted within tasks, the state carried from batch to batch."""
    got = line_tables.parse_ordered(_lines(spark, sf_dir, True), templates.compile_snippet(STATES), "doc", "place")
    return got.select("doc", "record_no", "turn", "role", F.size("said").cast("long").alias("n_lines"), F.md5(F.array_join("said", "\n")).alias("digest"))


_TURNS = "SELECT conv_id AS doc, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL"
_LINES = r"string_split_regex(text, '\r\n|\r|\n')"
LINE_TABLE_SQL = f"""
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY turn) - 1)::BIGINT AS record_no, turn::VARCHAR AS turn, role, len({_LINES})::BIGINT AS n_lines, md5(array_to_string({_LINES}, chr(10))) AS digest FROM ({_TURNS})
"""


def native_fill_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said, line by line, with the turn and role filled down, by expressions and windows alone."""
    t = templates.compile_snippet(HEADED)
    return line_tables.records_of(line_tables.steps_of_rules(_lines(spark, sf_dir), t, "doc", "place"), t, "doc").drop("error")


NATIVE_FILL_SQL = f"""
WITH l AS (SELECT doc, turn, role, unnest(range(0, len(x))) AS i, unnest(x) AS said FROM (SELECT *, {_LINES} AS x FROM ({_TURNS})))
SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY turn, i) - 1)::BIGINT AS record_no, turn::VARCHAR AS turn, role, said FROM l WHERE said <> ''
"""


def long_document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as two documents, cut into chunks that run at the same time; states are composed over the chunks."""
    # Chunks of a hundred conversations each; a conversation has room for a hundred million turns.
    within = F.pmod(F.col("doc").cast("long"), F.lit(100))
    part = F.when(F.col("doc") % 8 == 0, "small").otherwise("large").alias("part")
    lines = _lines(spark, sf_dir, True).select(part, (F.col("doc").cast("long") - within).alias("hundred"), (within * 100_000_000 * TURN + F.col("place")).alias("place"), "line")
    t = templates.compile_snippet(STATES)
    steps = line_tables.steps_of_chunks(lines, t, "part", "place", chunk="hundred")
    return line_tables.records_of(steps, t, "part").select("part", "record_no", "turn", "role", F.size("said").cast("long").alias("n_lines"), F.md5(F.array_join("said", "\n")).alias("digest"))


LONG_DOCUMENT_SQL = f"""
WITH d AS (SELECT CASE WHEN doc % 8 = 0 THEN 'small' ELSE 'large' END AS part, * FROM ({_TURNS}))
SELECT part, (row_number() OVER (PARTITION BY part ORDER BY doc, turn) - 1)::BIGINT AS record_no, turn::VARCHAR AS turn, role, len({_LINES})::BIGINT AS n_lines, md5(array_to_string({_LINES}, chr(10))) AS digest FROM d
"""

QUERIES = {"line_table_records": line_table_records, "native_fill_records": native_fill_records, "long_document_records": long_document_records}
ORACLES = {"line_table_records": LINE_TABLE_SQL, "native_fill_records": NATIVE_FILL_SQL, "long_document_records": LONG_DOCUMENT_SQL}
