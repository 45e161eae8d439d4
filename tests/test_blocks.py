"""Tables and pairs between markers, from text to snippet and back; marked rows, headers, token edits, files."""

import random

import pytest
from pyspark.sql import functions as F

from rowsmith.operators import category, profiles, tabular, templates, tokens
from rowsmith.sources.documents import read_texts, write_records

TABLE = "Shift 7 of ok\nplace     unit      state\n--------  --------  -------\nnorth     four      on\neast                off line\nwest      three\n\nEnd of shift 7\nnorth  z  y"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_table_between_markers(spark):
    d = docs(spark, TABLE, None, "", "no table here")
    snippet = tabular.block_snippet(d, ["place", "unit", "state"], "shift", "end of", rule=True)
    assert snippet.split("\n") == [
        "Shift digit() of ok -> Table", "Table", "place     unit      state",
        "start() letters(var_place)  letters(var_unit)  word(var_state, at_most_1_phrase_occurrences) end() -> Record",
        "start() letters(var_place)  letters(var_unit) end(space) -> Record",
        "start() letters(var_place) space(repetition_14_14) word(var_state, at_most_1_phrase_occurrences) end() -> Record", "End of shift digit() -> EOF",
    ]
    got = [(r.place, r.unit, r.state) for r in templates.parse(d, templates.compile_snippet(snippet)).orderBy("record_no").collect()]
    # The first rule that matches decides, so words of a last cell may fill an empty one before it.
    assert got == [("north", "four", "on"), ("east", "off", "line"), ("west", "three", "")]
    whole = tabular.block_snippet(docs(spark, TABLE.split("\n", 1)[1].split("\n\n")[0]), ["place", "unit", "state"], rule=True)
    assert "-> Table" not in whole and "-> EOF" not in whole


def test_divided_table_parses_back(spark):
    rows = [("x y", "", "12"), ("", "q", ""), ("z", "w", "7"), ("u v w", "", "")]
    text = "\n".join(["a        | b        | c", "---------|----------|--------", *(f"{a:<8} | {b:<8} | {x:<7}".rstrip() for a, b, x in rows)])
    d = docs(spark, text)
    t = templates.compile_snippet(tabular.block_snippet(d, ["a", "b", "c"], divider="|"))
    assert [(r.a, r.b, r.c) for r in templates.parse(d, t).orderBy("record_no").collect()] == rows


def test_modes():
    assert [tabular.mode_of(d) for d in ("|", " ", "   ", "")] == ["divider", "blanks", "gaps", "rule"]
    assert tabular.mode_of("|", [3, None]) == "widths" and tabular.mode_of("  ", reference="--- ---") == "reference" and tabular.mode_of("|", reference="a b") == "divider"
    with pytest.raises(ValueError):
        tabular.mode_of("||")


@pytest.mark.parametrize("divider, how", [("|", {}), (" ", {}), ("  ", {}), ("", {}), ("|", {"widths": [6, 6, None]}), ("  ", {"reference": "----  ----  -"})])
def test_parsed_in_every_mode(spark, divider, how):
    """One table in the form of each mode: the rows are the same."""
    bar = "| " if divider == "|" and not how else "  " if divider != " " else " "
    width = {" ": 4}.get(divider, 6 - len(bar))
    line = lambda a, b, x: f"{a:<{width}}{bar}{b:<{width}}{bar}{x}"
    head = [] if "reference" in how else [line("name", "unit", "n")]
    text = "\n".join([*head, *([line("-" * width, "-" * width, "-")] if divider == "" else []), line("ab", "", "1"), line("cd", "ef", "2")])
    got = tabular.parsed(docs(spark, text), 3, divider, **how).orderBy("row_no").collect()
    assert [r.cells for r in got] == [["ab", "", "1"], ["cd", "ef", "2"]]


def test_reference_row_of_the_user(spark):
    d = docs(spark, "name  size\na     10\nbb    5")
    assert [r.cells for r in tabular.rows(d, 2, reference="----  ----").orderBy("row_no").collect()] == [["name", "size"], ["a", "10"], ["bb", "5"]]


def test_column_names(spark):
    d = docs(spark, "last      user-id            Last\nchange    2                  Change\n--------  --------  -------  -----\n1  2", "only text", None)
    assert [r.names for r in tabular.column_names(d, 4, rule=True).collect()] == [["last_change", "user_id", "col2", "last_change3"]]
    assert [r.names for r in tabular.column_names(d, 4, rule=True, explicit=list("abcd")).collect()] == [list("abcd")]


def ledger(rng, heads, tails, gaps):
    """A marked table, and its rows as cells and further lines."""
    rows = []
    for k in range(12):
        how = rng.choice(["plain", *["head"] * heads, *["tail"] * tails])
        cells = [f"id{k}", rng.choice(["", "7", "42"]) if gaps else "7", f"note {k}x"]
        if how == "head":
            cells[0] = f"name of no {k}"
        rows.append((how, cells, [f"more {k}y"] + ["and so on"] * rng.randrange(2) if how == "tail" else []))
    text = "id        state    note\n--------- -------- ----"
    for how, (a, b, c), more in rows:
        mark = {"head": rng.choice(["<user-marker-one-line>", " < User Marker One Line >"]), "tail": "<user_marker.multi+line>", "plain": ""}[how]
        text += f"\n{mark}" + (f"{a}\n{'':<10}" if how == "head" else f"{a:<10}") + f"{b:<9}{c}" + "".join(f"\n{'':<{19 + i}}{x}" for i, x in enumerate(more))
    return text, [(cells, more) for _, cells, more in rows]


@pytest.mark.parametrize("heads, tails, gaps", [(1, 0, False), (0, 1, False), (1, 1, False), (1, 1, True), (0, 1, True), (0, 0, True)])
def test_marked_tables(spark, heads, tails, gaps):
    """Rows as they were rendered; and by rules inferred from the marked tables, from the texts without marks."""
    rng = random.Random(heads * 4 + tails * 2 + gaps)
    tables = [ledger(rng, heads, tails, gaps) for _ in range(5)]
    d = docs(spark, *(t for t, _ in tables), None, "")
    got = {}
    for r in tabular.marked_rows(d, 3, rule=True).orderBy("doc_id", "row_no").collect():
        got.setdefault(r.doc_id, []).append((r.cells, r.tails))
    assert got == {k: rows for k, (_, rows) in enumerate(tables)}
    t = templates.compile_snippet(tabular.marked_snippet(d, ["id", "state", "note"], rule=True))
    plain = d.select("doc_id", tabular.unmarked(F.col("text")).alias("text"))
    got = {}
    for r in templates.parse(plain, t).orderBy("doc_id", "record_no").collect():
        note = list(r.note) if tails else [r.note]
        got.setdefault(r.doc_id, []).append(([r.id, r.state, note[0]], note[1:]))
    # The heading is a row by its words.
    assert {k: v[1:] if v and v[0][0][0] == "id" else v for k, v in got.items()} == {k: rows for k, (_, rows) in enumerate(tables)}


def test_marked_tables_that_cannot_be_told_apart(spark):
    head = "a        b\n-------- ----\n"
    with pytest.raises(ValueError, match="first cell"):
        tabular.marked_snippet(docs(spark, head + "x\n<user-marker-one-line>long one\n         y"), ["a", "b"], rule=True)
    with pytest.raises(ValueError, match="last cell"):
        tabular.marked_snippet(docs(spark, head + "<user-marker-multi-line>x        y\n         z\nu        v", head + "         w"), ["a", "b"], rule=True)
    with pytest.raises(ValueError, match="always empty"):
        tabular.marked_snippet(docs(spark, head + "x"), ["a", "b"], rule=True)


CARD = "intro: 1\nbegin 3\nname: ann lee  age: 7\nplain words\nowner:   place: x\nrate = 5\nend\nname: no"


def test_pairs_between_markers(spark):
    d = docs(spark, CARD, CARD.replace("begin 3", "begin 9").replace("owner:", "owner: k"), None, "none")
    blocks = category.block_pairs(d, "begin", "end", {3: (1, "=")}, 2)
    got = category.block_records(blocks, ["name", "age", "owner", "place", "rate"]).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == [("ann lee", "7", "", "x", "5", True), ("ann lee", "7", "k", "x", "5", True), ("", "", "", "", "", False), ("", "", "", "", "", False)]
    own = category.block_pairs(d.where("doc_id < 2"), "begin", "end", None, 2)
    snippet = category.block_template(own)
    assert snippet.split("\n") == ["begin digit() -> Table", "Table", "name: phrase(var_name)  age: digit(var_age)", "plain words", "owner:zero_or_spaces()letter(var_owner, or_empty)  place: letter(var_place)", "rate = digit()", "end -> EOF"]
    t = templates.compile_snippet(snippet)
    assert [(r.name, r.age, r.owner, r.place) for r in templates.parse(d.where("doc_id < 2"), t).orderBy("doc_id").collect()] == [("ann lee", "7", "", "x"), ("ann lee", "7", "k", "x")]
    assert templates.regexes(t)[1].startswith("^name: (?P<name>") and len(templates.regexes(t)) == 6


def test_snippets_are_bounded(spark):
    """Blocks and tables with lines, headers and markers of their own: the most frequent forms, and how many lines they are."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    d = docs(spark, *(f"open {word(k % 7)}\nage: {k}\nfree {word(k)}\nwell known\nend {word(k)}\nage: no" for k in range(300)), None)
    blocks = category.block_pairs(d, "open", "end")
    snippet = category.block_template(blocks, most=5)
    assert len(snippet.split("\n")) == 5 + 1 + 1 + 5 + 5 and "well known" in snippet and "age: digits(var_age)" in snippet
    got = {r.kind: tuple(r)[1:] for r in category.block_coverage(blocks, most=5).collect()}
    assert got == {"pairs": (1, 300, 1, 300), "free": (301, 600, 5, 304), "start": (7, 300, 5, 43 * 5), "end": (300, 300, 5, 5)}
    assert len(category.block_template(blocks).split("\n")) == 7 + 1 + 1 + 200 + 200
    tables = docs(spark, *(f"head {word(k)}  x\n----  --\na     {k}" for k in range(40)))
    assert len(tabular.block_snippet(tables, ["p", "q"], rule=True, most=6).split("\n")) == 7
    assert category.block_coverage(blocks.limit(0)).where("n_forms + n_lines + forms_kept + lines_kept > 0").count() == 0


def test_token_edits(spark):
    lines = spark.createDataFrame([("a 12 cd",), ("a cd",), ("12 cd",), ("cd",), ("a 12",)], "line string")
    got = tokens.captured(lines, [("letters", "x"), ("digits", "y"), ("=cd", None)], or_empty=True).collect()
    assert [(r.line, r.x, r.y) for r in got] == [("a 12 cd", "a", "12"), ("a cd", "a", ""), ("12 cd", "", "12"), ("cd", "", "")]
    got = tokens.captured(lines, [("=a", None), ("digits", "y"), ("=cd", "z")], or_empty=True).collect()
    assert [(r.line, r.y, r.z) for r in got] == [("a 12 cd", "12", "cd"), ("a cd", "", "cd"), ("a 12", "12", "")]
    r = lines.limit(1).select(tokens.joined(F.lit(" p 1  q r"), [1, 2]).alias("a"), tokens.joined(F.lit("p 1  q r"), [0, 1, 3], "7").alias("b")).first()
    assert tuple(r.a) == ("v1", "mixed_word_group", "1  q") and tuple(r.b) == ("v70", "mixed_word_group", "p 1  r")


def test_value_shapes(spark):
    d = spark.createDataFrame([(["a b", "c d e"],), (["a", "b c"],), (["1", "x2"],)], "v array<string>")
    v = F.col("v")
    assert [tuple(r) for r in d.select(profiles.is_plural(v), profiles.is_singular(v), profiles.is_mixing(v), profiles.is_not_alphabet(v)).collect()] == [(True, False, False, True), (False, False, True, False), (False, True, False, True)]
    assert d.limit(1).select(profiles.regex(F.lit("phrase"), F.lit("k"), "root")).first()[0].startswith("(?P<k>[^ ")


def test_records_are_written_by_template(spark, tmp_path):
    d = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t1", "c")], "template string, v string")
    write_records(d, str(tmp_path / "out"), "template")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("template", "v").collect()) == [("t1", "a"), ("t1", "c"), ("t2", "b")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("p 1\nq")
    assert [r.text for r in read_texts(spark, str(tmp_path / "in")).collect()] == ["p 1\nq"]
