"""Tables of lines against the sequential machine on whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from rowsmith.operators import line_tables, templates

#: Templates of one state, and of several.
SINGLE = {
    "plain": "a digits(var_a) end() -> Record\nb digits(var_b)",
    "down": "g word(var_g, meta_data_filldown)\na digits(var_a, meta_data_required) -> Record\nx -> Clear\nz -> Clearall",
    "up": "a digits(var_a) -> Record\ng word(var_g, meta_data_fillup)\nb digits(var_b, meta_data_fillup) -> Record",
    "list": "a digits() -> Continue.Record\na digits(var_a)\nb digits(var_b, meta_data_list)\ng word(var_g, meta_data_list)\nx -> EOF",
    "errors": "a digits(var_a) -> Record\nz -> Error\ng word(var_g)\nx -> EOF",
    "both": "g word(var_g, meta_data_filldown)\na digits(var_a, meta_data_list, meta_data_required)\nb digits(var_b, meta_data_fillup) -> Record\nz -> Clearall",
}
SEVERAL = {
    "states": "Start\ng word(var_g, meta_data_filldown) -> Inner\nx -> EOF\nInner\na digits(var_a) -> Record\nb digits(var_b, or_empty) -> Continue\nz -> Start\nb digits() -> Record Start\nx -> Error",
    "end": "Start\na digits(var_a, meta_data_list)\nb digits(var_b) -> Record Other\nOther\ng word(var_g) -> Record\nx -> End\nz -> Clearall Start",
    "eof": "Start\na digits(var_a) -> Record\ng word(var_g) -> Next EOF\nb digits(var_b) -> Lost\nEOF",
}
LINES = ["a 1", "a 22", "b 3", "b 44", "b ", "g up", "g down", "x", "z", "noise", "a", "", "a 5 more"]


def documents(seed):
    rng = random.Random(seed)
    weights = [6, 6, 4, 4, 1, 3, 3, 0.4, 0.6, 2, 1, 1, 1]
    docs = {k: rng.choices(LINES, weights, k=rng.randrange(0, 40)) for k in range(40)}
    return docs | {None: rng.choices(LINES, weights, k=30), 100: ["noise"] * 5, 101: ["z"], 102: ["a 1"]}


def table(spark, docs, seed=0):
    rows = [(k, 3 * i, x) for k, lines in docs.items() for i, x in enumerate(lines)] + [(7, 5000, None)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "doc long, place long, x string").repartition(5).withColumn("chunk", F.lit("further"))


def want(docs, t):
    machine = templates.Machine(t)
    out = []
    for k, lines in docs.items():
        rows, error = machine.records("\n".join(lines)) if lines else ([], None)
        out += [(k, i, None, *r.values()) for i, r in enumerate(rows)]
        if error:
            out.append((k, 0, error, *([] if n in machine.has["List"] else "" for n in t.values)))
    return sorted(out, key=repr)


def got(df, t):
    return sorted(((r.doc, r.record_no, r.error, *(r[n] for n in t.values)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [*SINGLE, *SEVERAL])
def test_every_way_agrees_with_the_machine(spark, name):
    t = templates.compile_snippet({**SINGLE, **SEVERAL}[name])
    docs = documents(len(name))
    lines, expected = table(spark, docs), want(docs, t)
    assert len(expected) > 20
    assert got(line_tables.parse_ordered(lines, t, "doc", "place", "x"), t) == expected
    for size in (5,):
        assert got(line_tables.records_of(line_tables.steps_of_chunks(lines, t, "doc", "place", "x", size), t, "doc"), t) == expected, size
    if name in SINGLE:
        assert line_tables.is_single_state(t)
        for size in (None, 7):
            native = line_tables.records_of(line_tables.steps_of_rules(lines, t, "doc", "place", "x", size), t, "doc")
            assert got(native, t) == expected, size
        assert not any(x in native._jdf.queryExecution().toString() for x in ("InPandas", "InArrow", "PythonUDF"))
    else:
        with pytest.raises(ValueError):
            line_tables.steps_of_rules(lines, t)


def test_long_documents_in_small_batches(spark):
    """The open record is carried from batch to batch; records are given out before the document ends."""
    t = templates.compile_snippet(SINGLE["down"])
    docs = {1: [x for k in range(4000) for x in (f"g w{k // 50}", f"a {k}")], 2: ["a 1"]}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(line_tables.parse_ordered(table(spark, docs), t, "doc", "place", "x"), t) == want(docs, t)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    run = line_tables.Run(templates.Machine(t))
    for x in docs[1][:100]:
        run.feed(x)
    assert len(run.sure()) == 50 and not run.rows


def test_empty_tables(spark):
    t = templates.compile_snippet(SINGLE["plain"])
    empty = table(spark, {})
    for size in (None, 5):
        assert line_tables.parse_table(empty, t, "doc", "place", "x", size).collect() == []
    several = templates.compile_snippet(SEVERAL["states"])
    assert line_tables.parse_table(empty, several, "doc", "place", "x", 5).collect() == []


def test_lines_of_a_chunk_stay_together(spark):
    """Lines from several sources, joined with a table small enough that Spark changes the plan of a join as it runs."""
    t = templates.compile_snippet("Start\nturn digits(var_turn) end() -> Said\nSaid\n> something(var_said, meta_data_list) end()\ndone end() -> Record Start")
    ids = spark.range(400).select((F.col("id") % 2).alias("doc"), (F.col("id") * 10).alias("at"), F.lpad(F.lit("x"), 500, "x").alias("pad"))
    parts = [ids.select("doc", (F.col("at") + i).alias("place"), x.alias("x")) for i, x in enumerate([F.concat(F.lit("turn "), F.col("at").cast("string")), F.concat(F.lit("> "), "pad"), F.lit("done")])]
    lines = parts[0].union(parts[1]).union(parts[2])
    # Joins that are planned by shuffles, and broadcast when their sizes are known.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        chunked = line_tables.records_of(line_tables.steps_of_chunks(lines, t, "doc", "place", "x", chunk_lines=100), t, "doc")
        # Lines that a join has dealt by their document.
        joined = lines.join(spark.range(2).withColumnRenamed("id", "doc"), "doc")
        for df in (chunked, line_tables.parse_ordered(joined, t, "doc", "place", "x")):
            # Not the shuffle of a join, which Spark may leave out as it runs.
            assert "REPARTITION_BY_COL" in df._jdf.queryExecution().executedPlan().toString()
            rows = df.collect()
            assert len(rows) == 400 and all(len(r.said) == 1 and r.turn for r in rows)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_long_conversations_do_not_run_into_each_other(spark, tmp_path):
    """More turns than 1000 in one conversation, and ids of any size."""
    from rowsmith.jobs import table_jobs

    turns = [(1, i, "user", "a\nb") for i in range(1500)] + [(c, i, "user", "c") for c in (3, 10**15 + 1, 10**15 + 3) for i in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = sorted(table_jobs.long_document_records(spark, str(tmp_path)).collect(), key=lambda r: r.record_no)
    assert [(r.turn, r.n_lines) for r in rows] == [(str(t), len(x.split("\n"))) for _, t, _, x in turns]
