"""How work grows: what the plans of operators hold, and what reaches Python at once."""

from pyspark.sql import functions as F

from rowsmith.operators import profiles, tabular, templates, tokens
from rowsmith.sources.documents import PIECE, Texts, pieces_of


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_of_tokens_are_worked_out_once(spark):
    d = spark.createDataFrame([("a1 of 22",)], "line string").select(F.explode(tokens.symbolised(F.col("line"))).alias("t")).select("t.*")
    assert plan(d).count("RLIKE") < 100
    assert [tuple(r) for r in d.collect()] == [("v0", "word", "a1"), ("v1", "letters", "of"), ("v2", "digits", "22")]


def tables(spark):
    d = spark.createDataFrame([(1, "no name  size\n1  a     10\n2        7"), (2, None), (3, "x\nno name  size\n3  b     8")], "doc_id long, text string")
    return tabular.rows(d, 3, widths=[3, 6, None])


def test_columns_are_profiled_by_their_different_cells_in_one_pass(spark):
    found = tables(spark)
    assert plan(tabular.column_profile(found)).count("Aggregate") == 2
    assert "Join" not in plan(tabular.column_alignment(found))
    assert [(r.n, r.n_empty, r.least_width, r.most_width) for r in tabular.column_profile(found).orderBy("column_no").collect()] == [(4, 0, 1, 2), (4, 1, 0, 4), (4, 0, 1, 4)]


def test_snippets_of_tables_read_the_rows_once(spark):
    found = tables(spark)
    assert "Generate" not in plan(tabular.table_snippets(found, ["a", "b", "c"]))


def test_cells_are_written_out_for_a_known_number_of_columns(spark):
    assert "lambda" not in plan(tables(spark).select("cells", "layout")).split("Generate")[0]


def test_texts_reach_python_in_pieces(spark):
    t = templates.compile_snippet("start() digits(var_a, or_empty) end() -> Record")
    head = "x" * (PIECE - 2)
    d = spark.createDataFrame([(1, f"{head}\n\r\n12"), (2, ""), (3, None), (None, head + "y\r\n3\r\n" + "4\n" * 3 * PIECE + "5"), (5, head + "yyy\r\r\n7")], "doc_id long, text string")
    assert "regexp_extract_all" in plan(templates.parse(d, t)) and "regexp_extract_all" in plan(tabular.marked_found(d, 2))
    rows = pieces_of(d.coalesce(1))
    assert max(r["_x"] for r in rows.select(F.length("_x").alias("_x")).collect()) <= PIECE + 1
    lines = [(k, list(x)) for k, x in Texts(rows.toArrow().to_batches(max_chunksize=2))]
    assert lines == [(1, [head, "", "12"]), (2, [""]), (None, [head + "y", "3", *["4"] * (3 * PIECE), "5"]), (5, [head + "yyy", "", "7"])]
    got = templates.parse(d.coalesce(1), t).select("doc_id", "record_no", "a").collect()
    own = lambda k: [r["a"] for r in sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["record_no"])]
    assert own(1) == ["", "12"] and own(2) == [""] and own(3) == [] and own(5) == ["", "7"]
    assert own(None) == ["3", *["4"] * (3 * PIECE), "5"]


def test_marked_tables_of_many_pieces_are_one_table(spark):
    body = "".join(f"n{i:<8} {i % 7}\n" for i in range(PIECE))
    d = spark.createDataFrame([(1, "name      size\n" + body + "<user-marker-one-line>long name\n          8")], "doc_id long, text string")
    got = tabular.marked_rows(d, 2).orderBy("row_no").collect()
    assert [r["row_no"] for r in got] == list(range(PIECE + 1))
    assert [r["cells"] for r in got] == [*([f"n{i}", str(i % 7)] for i in range(PIECE)), ["long name", "8"]]


def test_starts_in_hand_are_those_of_columns(spark):
    lines = ["", "  a  b c", "a |  b|c", "---  ==  --", " --- -", "x   y  "]
    d = spark.createDataFrame([(x,) for x in lines], "x string")
    ways = [({"widths": [2, 3, None]}, tabular.starts_by_widths([2, 3, None])), ({"rule": True}, tabular.starts_by_rule(F.col("x"))), ({"divider": "|"}, tabular.starts_by_divider(F.col("x"), "|")), ({}, tabular.starts_by_gaps(F.col("x"))), ({"gap": 1}, tabular.starts_by_gaps(F.col("x"), 1))]
    for how, column in ways:
        assert [(r["x"], r["s"]) for r in d.select("x", column.alias("s")).collect()] == [(x, tabular.starts_in(x, **how)) for x in lines]


def test_patterns_of_slots_name_their_class_once(spark):
    d = spark.createDataFrame([("7",), ("12",)], "value string")
    p = profiles.class_of_sets(d.withColumn("k", F.lit("a")), ["k"])
    got = p.select(profiles.regex(F.col("actual"), F.col("k"), "root").alias("r"))
    assert plan(got).count("CASE WHEN") < 500
    assert [r["r"] for r in got.collect()] == [r"(?P<a>[^ \t\n\x0b\f\r]+)"]


def test_slot_shapes_read_the_tables_once(spark):
    from rowsmith.jobs.block_jobs import slot_shapes

    assert "Join" not in plan(slot_shapes(spark, "/root/testdata/sf0.001"))


def test_blanks_are_written_out_for_a_known_number_of_columns(spark):
    found = tables(spark)
    blanks = found.select("layout", F.array(*tabular.blanks_of(3, "")).alias("b"))
    assert "lambda" not in plan(blanks).split("Generate")[0]
    assert sorted((r["layout"], r["b"]) for r in blanks.collect()) == [("101", [0, 6, 8]), ("111", [0, 1, 2]), ("111", [0, 2, 5]), ("111", [0, 2, 5])]
