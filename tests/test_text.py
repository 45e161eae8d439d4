"""Pairs, tables, templates, verification, registry, tokens and mined patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rowsmith.operators import category, mining, profiles, registry, tabular, templates, tokens, verify
from rowsmith.sources.documents import explode_lines
from rowsmith.streaming import counts


VALUES = ["", "on", "7", "x y", "x, y", "21:40", "6:07:08 h", "0a:1b:2c:3d:4e:5f", "::9", "fd00::1, fd00::2", "3.5 km/h (max)"]


@pytest.mark.parametrize("seed", range(5))
def test_rendered_pairs_are_read_back(seed):
    """Keys of one word or two before their values, wide gaps in between; fewer are read if fewer are asked for."""
    rng = random.Random(seed)
    for _ in range(100):
        keys = rng.sample(["mode", "speed", "via", "left side", "no(s)", "n.r", "kind"], rng.randrange(1, 5))
        pairs = [(k, rng.choice(VALUES)) for k in keys]
        line = "".join(f"{k}: {v}" + " " * rng.randrange(2, 5) for k, v in pairs).rstrip(" ")
        assert category.split_pairs(line, len(pairs)) == pairs, line
        if all(v for _, v in pairs):
            assert category.split_pairs(line, 1)[0][0] == pairs[0][0]
    for line in ("", "words alone", ":starts with one", "left 8:15", "at ::1", "02:42:ac:11:00:02 seen"):
        assert category.split_pairs(line, 2) == [], line


def test_variable_and_records(spark):
    d = spark.createDataFrame([(1, "free block(s): 3\n10:20:30\nowner:\nx"), (2, "none"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in category.records(d, ["free_block_s", "owner"]).orderBy("doc_id").collect()][:2] == [(1, "3", "", True), (2, "", "", False)]


FILES = "kind | changed on      | file\n-----|-----------------|-----\nlnk  | 3 May 2021      | a b\nd    |                 | c"


def test_tables(spark):
    d = spark.createDataFrame([(1, FILES)], "doc_id long, text string")
    got = tabular.rows(d, 3, divider="|").orderBy("row_no").collect()
    assert [(r.cells, r.layout) for r in got] == [(["lnk", "3 May 2021", "a b"], "111"), (["d", "", "c"], "101")]
    cut = spark.createDataFrame([(1, "ab  cd\nabcdef gh")], "doc_id long, text string")
    assert tabular.rows(cut, 2, gap=2).first()["cells"] == ["abcd", "ef gh"]
    assert tabular.header_names(["Changed-On 1", "", "file", "file"]) == ["changed_on", "col1", "file", "file3"]
    assert tuple(tabular.divider_edges(explode_lines(spark.createDataFrame([(1, "| a |\n| b |\nc")], "doc_id long, text string")), "|").first()) == (True, True)


def test_machine():
    t = templates.compile_snippet("start() job: mixed_words(var_job) end()\ntook: number(var_took) end() -> Record")
    rows, error = templates.Machine(t).records("job: a b\ntook: 12.75\nnoise\njob: c\ntook: 5")
    assert error is None and rows == [{"job": "a b", "took": "12.75"}, {"job": "c", "took": "5"}]


def test_first_rule_wins_and_states():
    t = templates.compile_snippet("words(var_a) end() -> Record\nwords(var_b) end() -> Record")
    assert templates.Machine(t).records("x y")[0] == [{"a": "x y", "b": ""}]
    t = templates.compile_snippet("Start\nbegin -> Body\nBody\nstop -> EOF\nk digits(var_k)")
    assert templates.Machine(t).records("k 1\nbegin\nk 2\nstop\nk 3")[0] == [{"k": "2"}]


def test_options():
    t = templates.compile_snippet("g letters(var_g, meta_data_filldown)\ni digits(var_i, meta_data_required) -> Record")
    assert templates.Machine(t).records("g a\ni 1\ni 2\ng b\ni 3")[0] == [{"g": "a", "i": "1"}, {"g": "a", "i": "2"}, {"g": "b", "i": "3"}]
    t = templates.compile_snippet("i digits(var_i) -> Record\nt letters(var_t, meta_data_fillup) -> Record")
    assert templates.Machine(t).records("i 1\ni 2\nt x")[0] == [{"i": "1", "t": "x"}, {"i": "2", "t": "x"}, {"i": "", "t": "x"}]
    t = templates.compile_snippet("n digits(var_n) -> Continue.Record\nn digits(var_n)\n- word(var_w, meta_data_list)\nbad -> Error")
    assert templates.Machine(t).records("bad")[1]


def test_snippet_lines():
    values = {}
    assert templates.compile_line("=== end() -> record", values) == templates.Rule("^={2,}$$", "Next", "Record")
    assert templates.compile_line("a  b $5 -> continue.Record Other", values) == templates.Rule(r"^a +b \x245", "Continue", "Record", "Other")
    assert templates.compile_line("ignore_case__ ab", values).pattern == "^(?i)ab"
    assert templates.compile_line("keep__ ^x.*y -> Next", values).pattern == "^x.*y"
    with pytest.raises(templates.SnippetError):
        templates.compile_snippet("nothing here")
    with pytest.raises(templates.SnippetError):
        templates.compile_snippet("strange(var_x)")


@pytest.mark.parametrize(
    "snippet",
    [
        "n digits(var_n) w word(var_w) end() -> Record\nw word(var_w) -> Record", "n: something(var_n, or_empty) end() -> Record", "n: something(var_n, or_empty) w: word(var_w, or_empty) end() -> Record\nbare -> Record\nw: digits(var_n, or_empty) -> Record",
        "bare -> Record\nn digits(var_n, or_empty) -> Record",
    ],
)
def test_native_path_agrees_with_the_machine(spark, snippet):
    """Also on records whose captures are all empty, and on rules that capture nothing."""
    t = templates.compile_snippet(snippet)
    lines = ["n: ", "n: q", "n:  w: ", "n: x w: y", "w: ", "w: 5", "bare", "", "n ", "n 7", *(f"n {i} w a{i}" if i % 3 else f"w b{i}" if i % 2 else "other" for i in range(30))]
    d = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    assert templates.is_stateless(t)
    machine = [tuple(r[n] for n in t.values) for r in templates.parse(d, t).orderBy("record_no").collect()]
    native = [tuple(r[n] for n in t.values) for r in templates.parse_lines(explode_lines(d), t).orderBy("line_no").collect()]
    assert machine == native and len(machine) > 1
    with pytest.raises(ValueError):
        templates.parse_lines(explode_lines(d), templates.compile_snippet("n digits(var_n)"))


def test_choices_are_left_to_the_machine():
    f = templates.always_captures
    assert f(r"^a ${x} (b|c) \| [|]$$") and f("^(${x})$$") and f("^(a|b)? ${x}")
    assert not f("^(${x})?$$") and not f("^(${x}|b)") and not f("^${x}|b") and not f("^((${x}) ){0,2}")


def test_parse_odd_documents(spark):
    t = templates.compile_snippet("n digits(var_n) -> Record\nbad -> Error")
    d = spark.createDataFrame([(1, None), (2, ""), (3, "n 1\nbad"), (4, "n 1")], "doc_id long, text string")
    assert [(r.doc_id, r.n, r.error is None) for r in templates.parse(d, t).orderBy("doc_id").collect()] == [(3, "", False), (4, "1", True)]


def test_verify(spark):
    want = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "d int, n int, v string")
    got = spark.createDataFrame([(1, 0, " a"), (1, 1, "x"), (3, 0, "c")], "d int, n int, v string")
    n = verify.verify_counts(got, want, "d")
    bad = verify.verify_content(got, want, ["d", "n"], ["v"])
    assert {(r.d, r.n): (r.missing, r.unexpected, r.different) for r in bad.collect()} == {(1, 1): (False, False, True), (2, 0): (True, False, False), (3, 0): (False, True, False)}
    assert {r.d: r.message for r in verify.verdicts(n, bad, "d").collect()} == {1: "content differs", 2: "no record", 3: "expected 0 records, got 1"}


def test_bags(spark):
    """Repeats count, order does not; nulls equal nulls; blanks of the parsed side alone are trimmed."""
    want = [(1, "a", 1)] * 3 + [(1, "b", None), (2, None, 2), (2, " c", 3)]
    got = [(1, " a ", 1)] * 5 + [(2, None, 2), (2, None, 2), (2, " c", 3), (None, "z", 1)]
    kind = "d int, v string, n int"
    bad = verify.verify_bag(spark.createDataFrame(got, kind).repartition(4), spark.createDataFrame(want, kind), ["d"], ["v", "n"]).collect()
    assert sorted([tuple(r) for r in bad], key=repr) == sorted([(1, "a", 1, 2), (1, "b", None, -1), (2, None, 2, 1), (2, "c", 3, 1), (2, " c", 3, -1), (None, "z", 1, 1)], key=repr)
    assert verify.verify_bag(spark.createDataFrame(want, kind), spark.createDataFrame(want[::-1], kind), ["d"], ["v", "n"], False).collect() == []


def test_recommendations_from_data(spark):
    d = spark.createDataFrame([("12", "ab"), ("7", "x"), ("a", "-"), ("", "a"), (None, "b"), ("x y", "1.5")], "a string, b string")
    got = {(r.a, r.b): (r.recommended, r.translated) for r in profiles.recommendations(d).collect()}
    assert got == {("12", "ab"): ("word", False), ("7", "x"): ("alphabet_numeric", True), ("a", "-"): ("graph", True), ("", "a"): (None, False), (None, "b"): (None, False), ("x y", "1.5"): ("non_whitespaces_group", True)}


def test_rules_of_tables_by_one_aggregation(spark):
    """The same rules as table_snippets(), with gaps, stretches of empty cells, several words, trailing blanks and dividers."""
    rng = random.Random(21)
    cell = lambda: rng.choice(["", "a", "b c", "12", "1.5", "x-y z w"])
    for divider, bar in (("", "   "), ("|", " | ")):
        texts = ["\n".join(["h" * 8 + bar + "i" * 8 + bar + "j" * 8, *((f"{cell():<8}{bar}{cell():<8}{bar}{cell()}" + rng.choice(["", "  "])) for _ in range(20))]) for _ in range(4)]
        found = tabular.rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, divider=divider, **({} if divider else {"widths": [11, 11, None]}))
        want = [r.snippet for r in tabular.table_snippets(found, ["p", "q", "r"], divider).orderBy("rank").collect()]
        assert tabular.table_rules(found, ["p", "q", "r"], divider) == want and len(want) > 5


def test_ties_of_widths_go_to_the_first_row(spark):
    d = spark.createDataFrame([(k, f"name  x\n{'a' * w:<6}y") for k, w in enumerate([2, 4, 2, 4, 3])], "doc_id long, text string").repartition(3)
    widths = {r.column_no: r.width for r in tabular.column_alignment(tabular.rows(d, 2, widths=[6, None])).collect()}
    assert widths[0] == 3


def test_registry(spark):
    old = spark.createDataFrame([("a", "T1 "), ("b", "T2")], "name string, template string")
    new = spark.createDataFrame([("a", "T2"), ("c", "T1"), ("d", "T4")], "name string, template string")
    assert [tuple(r) for r in registry.upsert(old, new.where("name <> 'a'")).collect()] == [("b", "T2", "kept"), ("c", "T1", "renamed"), ("d", "T4", "added")]
    assert [tuple(r) for r in registry.upsert(old, new.where("name = 'a'")).collect()] == [("a", "T1 ", "refused"), ("b", "T2", "kept")]
    found = registry.lookup(spark.createDataFrame([("a",), ("x",), ("B!",)], "name string"), old)
    assert {r.name: r.status for r in found.collect()} == {"a": "FOUND", "x": "NOT_FOUND", "B!": "INVALID-TEMPLATE-NAME-FORMAT"}


def test_tokens(spark):
    d = spark.createDataFrame([("abc 12  x-y",)], "line string")
    assert [tuple(t) for t in d.select(tokens.symbolised(F.col("line"), "1").alias("t")).first()["t"]] == [("v10", "letters", "abc"), ("v11", "digits", "12"), ("v12", "mixed_word", "x-y")]
    r = d.select(tokens.join_tokens(F.col("line"), 1, 2).alias("j"), tokens.split_token(F.lit("1/1/2"), "/").alias("s")).first()
    assert r.j == "12  x-y" and r.s == ["1", "/", "1", "/", "2"]
    assert tokens.captured(d, [("letters", "a"), ("digits", None), ("=x-y", "b")]).select("a", "b").first() == ("abc", "x-y")


SLOTS = {
    "digits": lambda rng: str(rng.randrange(10, 9999)), "letters": lambda rng: rng.choice(["Xa", "Xbb", "Xccc", "Xdddd", "Xe"]), "mixed_number": lambda rng: f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}", "mixed_word": lambda rng: f"{rng.choice('XYZ')}{rng.randrange(9)}/{rng.choice('uvw')}",
    "phrase": lambda rng: f"X{rng.choice('abcd')}{rng.randrange(100, 999)} Y{rng.randrange(100, 999)}" + rng.choice(["", f" Z{rng.randrange(100, 999)}"]),
}


def rendered(rng, n):
    """Lines of one form: literal words, and between them slots of one class each, with what each holds."""
    literals = rng.sample(["red", "of", "=>", "(max)", "gets", "$", "until", "|"], rng.randrange(2, 5))
    kinds = [rng.choice([None, *SLOTS]) for _ in literals]
    kinds[0] = kinds[0] or "digits"
    rows = []
    for _ in range(n):
        values = [SLOTS[k](rng) if k else None for k in kinds]
        rows.append((" ".join(x for lit, v in zip(literals, values) for x in (lit, v) if x is not None), [v for v in values if v is not None]))
    return rows, [k for k in kinds if k]


@pytest.mark.parametrize("seed", range(6))
def test_patterns_of_rendered_lines(seed):
    """What is inferred from lines that differ matches all of them, captures what each slot was given, and compiles."""
    rng = random.Random(seed)
    for _ in range(25):
        rows, kinds = rendered(rng, 8)
        lines = [x for x, _ in rows]
        found = mining.general_pattern(lines)
        assert found is not None, lines
        matches = [re.fullmatch(found[0], x) for x in lines]
        assert all(matches)
        varying = [i for i in range(len(kinds)) if len({v[i] for _, v in rows}) > 1]
        # Words that some values have in common may stand outside of the slot.
        if all(kinds[i] != "phrase" for i in varying):
            assert [list(m.groups()) for m in matches] and [[m[f"v{k}"] for k in range(len(varying))] for m in matches] == [[v[i] for i in varying] for _, v in rows]
        t = templates.compile_snippet(found[1] + " -> Record")
        assert len(templates.Machine(t).records("\n".join(lines))[0]) == len(lines)


def test_envelopes_and_words_that_may_lack():
    """Blanks around lines, spacing within, and a word that only some lines have."""
    rng = random.Random(9)
    for _ in range(40):
        lead, end = rng.choice([(0, 1), (0, 4), (2, 4)]), rng.choice([(0, 1), (0, 3)])
        lines = [" " * rng.randrange(*lead) + f"unit {k}{rng.choice(['', ' spare'])} left{rng.choice([' ', '   '])}{rng.randrange(10, 99)} h" + " " * rng.randrange(*end) for k in range(11, 17)]
        lines += [" " * lead[0] + "unit 20 spare left 30 h", " " * lead[0] + "unit 21 left 31 h"]
        found = mining.general_pattern(lines)
        assert found and all(re.fullmatch(found[0], x) for x in lines), lines
    assert mining.general_pattern(["alone"]) is None and mining.general_pattern(["alone", " alone  "]) is None


def test_clusters_of_a_table(spark):
    """Each cluster has the pattern that its lines have by themselves; one of a single line has none."""
    rng = random.Random(12)
    clusters = {f"k{i}": [x for x, _ in rendered(rng, 6)[0]] for i in range(8)} | {"one": ["same", " same "]}
    d = spark.createDataFrame([(k, x) for k, lines in clusters.items() for x in lines], "kind string, line string").repartition(5)
    rows = {r.kind: r for r in mining.matching_patterns(d, "kind").collect()}
    assert sorted(rows) == sorted(clusters) and (rows["one"].pattern, rows["one"].error) == (None, mining.TOO_FEW)
    for k, lines in clusters.items():
        if k != "one":
            assert rows[k].error is None and all(re.fullmatch(rows[k].pattern, x) for x in lines)
            assert templates.compile_snippet(rows[k].snippet + " -> Record").values


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "n 1\nn 22"), (2, "n 3")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = counts.signature_counts(stream).writeStream.outputMode("complete").format("memory").queryName("signatures").start()
    q.processAllAvailable()
    q.stop()
    assert {r.signature: r.n for r in spark.table("signatures").collect()} == {"n digit()": 2, "n digits()": 1}


def test_headers_alignment_and_snippets(spark):
    d = spark.createDataFrame([(1, "name   size\n----   ----\na       10\nbbb      5\nc       7")], "doc_id long, text string")
    assert tabular.pick_headers(d, [0, "---"]).first()["headers"] == ["name   size", "----   ----"]
    found = tabular.rows(d, 2, rule=True)
    assert {r.column_no: (r.alignment, r.width) for r in tabular.column_alignment(found).collect()} == {0: ("left", 2), 1: ("center", 2)}
    assert [r.snippet for r in tabular.table_snippets(found, ["name", "size"]).collect()] == ["start() letters(var_name)  digits(var_size) end() -> Record"] == tabular.table_rules(found, ["name", "size"])
    lines = spark.createDataFrame([("a: 1  b: x y",), ("a: 22  b:",)], "line string")
    assert category.block_snippet(category.pairs(lines, ["line"], 2)).first()[0] == "a: digits(var_a)  b: phrase(var_b, or_empty)"


def test_patterns_match_all_lines(spark):
    """The shortest lines have one form; the patterns have to cover the others too."""
    lines = [("click", f"click by user {i}{' again' if i % 3 == 0 and i > 20 else ''} with ab{i % 7} cd") for i in range(400)] + [("boot", "boot ok"), ("boot", "boot ok"), ("odd", None), ("odd", "  "), ("odd", "x\ty"), ("odd", "x y z")]
    d = spark.createDataFrame(lines, "kind string, line string")
    got = {r.kind: r for r in mining.matching_patterns(d, "kind").collect()}
    assert all(re.fullmatch(got["click"].pattern, x) for k, x in lines if k == "click")
    assert got["boot"].pattern is None and "click" in got["click"].snippet


def test_slot_classes_come_from_all_lines(spark):
    lines = [f"put {i} to k" for i in range(1, 300)] + ["put 1.5 to k"]
    d = spark.createDataFrame([("put", x) for x in lines], "kind string, line string").repartition(3)
    assert [(r.snippet) for r in mining.matching_patterns(d, "kind", sample=2).collect()] == ["start() put number(var_v0) to k end()"]


def test_diff_templates_cover_their_clusters(spark):
    from rowsmith.jobs import text_jobs

    rows = text_jobs.diff_templates(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 5 and all(r.snippet and r.error is None and r.n == r.n_matched for r in rows)
