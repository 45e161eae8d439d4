"""Edit scripts: laws of their steps on generated lines, and their use on tables of lines."""

import random
import re

import pytest

from rowsmith.operators import edits, templates

PARTS = ["lamp", "x9", "7", "4410", "1.5", "a=b", "k:v;w", "(in)", "--", "p/q/r", "ü", "A", "#", "3,14%", "<up|down>", "«"]


def line_of(rng):
    body = "".join(rng.choice(PARTS) + rng.choice([" ", " ", "   ", "\t"]) for _ in range(rng.randrange(1, 8))).rstrip()
    return rng.choice(["", "", " "]) + body + rng.choice(["", "  "])


def test_texts_read_back():
    rng = random.Random(1)
    for _ in range(300):
        line = line_of(rng)
        s = edits.symbolise(line, rng.choice(["", "3", "a b"]))
        assert s.leading + "".join(t.value + t.gap for t in s.tokens) + s.trailing == line
        assert edits.read(s.text()) == s
        assert all(re.fullmatch(edits.c.PATTERN[t.kind], t.value) for t in s.tokens)


def test_split_and_join_keep_the_text():
    """Whatever is split or joined, the line stays; new tokens get numbers after the largest; patterns fit the line."""
    rng = random.Random(2)
    for _ in range(300):
        line = line_of(rng).strip()
        s = edits.symbolise(line)
        for _ in range(rng.randrange(1, 4)):
            before = {t.id: t for t in s.tokens}
            largest = max(t.number for t in s.tokens)
            k = rng.randrange(len(s.tokens))
            if rng.random() < 0.5:
                s.action = f"{s.tokens[k].id}-split-{rng.choice(['', '=', ':;', '/', '|<>'])}"
                edits.step(s)
                new = [t for t in s.tokens if before.get(t.id) is not t]
                if largest:
                    assert [t.number for t in new] == list(range(largest + 1, largest + 1 + len(new)))
            elif k + 1 < len(s.tokens) and "\t" not in s.tokens[k].value + s.tokens[k].gap + s.tokens[k + 1].value:  # no class holds a tab
                s.action = f"{s.tokens[k].id},{s.tokens[k + 1].id}-join"
                edits.step(s)
            assert s.action == "" and "".join(t.value + t.gap for t in s.tokens) == line
        for t in s.tokens:
            t.mode = rng.choice(["", "c", "k"])
            t.or_empty = bool(t.mode) and rng.random() < 0.3
        ids = [t.id for t in s.tokens]
        if len(set(ids)) < len(ids):
            continue  # tokens without numbers may be numbered alike
        m = re.fullmatch(edits.pattern(s), line)
        assert m, (edits.pattern(s), line)
        if not any(t.or_empty for t in s.tokens) and all(t.gap or not t.mode for t in s.tokens[:-1]):
            singles = [t for t in s.tokens if t.mode == "c" and "( " not in edits.c.PATTERN[t.kind]]
            assert all(m[t.id] == t.value for t in singles) or any("( " in edits.c.PATTERN[t.kind] for t in s.tokens)
        have = set(re.split("[ \t]+", line)) | {f"#{len(line.split())}", "*"}
        assert set(edits.words(s)) <= have


def test_directives_wait_for_actions():
    s = edits.read("capture(6,4:5) keep(0) action(1-split-=): rate cpu=80 now ok")
    edits.step(s)
    assert s.text() == "capture(6,4:5) keep(0) action(): letters(var=v0, value=rate) letters(var=v4, value=cpu)punct(var=v5, value==)digits(var=v6, value=80) letters(var=v2, value=now) letters(var=v3, value=ok)"
    edits.step(s)
    assert s.done() and edits.snippet(s) == "letters() letters(var_v4)punct(var_v5)digits(var_v6) now ok"
    assert edits.read(s.text()) == s
    s = edits.finished("capture(0 2,or) keep() action(): up (7) days")
    assert [t.or_empty for t in s.tokens] == [True, False, True] and edits.read(s.text()) == s
    assert [bool(re.fullmatch(edits.pattern(s), x)) for x in ("up (7) days", "(7) days", "up (7) ", "up (7)days", "(7)", "up (8) days")] == [True, True, True, False, False, False]


@pytest.mark.parametrize("spec", ["capture(7) keep() action(): a b", "capture() keep() action(3:2-join): a b c d", "capture() keep() action(1-cut): a b", "capture(0) keep(x) action(): a", "capture(,) keep() action(): a", "capture(0) keep() action(): ", "capture(0) keep() action(): digit(var=v0, value=1) tail"])
def test_faults(spec):
    with pytest.raises(edits.EditError):
        edits.finished(spec)


def test_scripts_of_several_lines(spark):
    """A script a line, plain lines in between; compiled as a template, they parse a text of that form."""
    text = "box 17 open\n\nitem: red cup, 4 left\nitem: tin pan, 12 left\nend"
    spec = "\n".join(["capture(1) keep(2) action(): box 17 open", "", "capture(13,11) keep() action(11:12-join): mixed_word(var=v10, value=item:) letters(var=v11, value=red) mixed_word(var=v12, value=cup,) digit(var=v13, value=4) letters(var=v14, value=left)", "end"])
    snippet = edits.snippets(spec)
    assert snippet.split("\n") == ["box digits(var_v1) letters()", "", "item: mixed_phrase(var_v11) digit(var_v13) left", "end"]
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = templates.parse(d, templates.compile_snippet(snippet)).collect()
    assert [(r.v1, r.v11, r.v13) for r in rows] == [("17", "red cup,", "4")]


def test_lines_meet_their_scripts(spark):
    """Against every script tried on every line; scripts without literal words, with equal words, and faulty ones."""
    rng = random.Random(5)
    lines = [line_of(rng).strip() for _ in range(150)] + ["", None, "same 1 x", "same 22 x", "same 3 y"]
    specs = [("all", "capture(0,1,2) keep() action(): ab 12 x"), ("word", "capture(1) keep() action(): same 1 x"), ("word2", "capture(1,2) keep() action(): same 33 x"), ("wide", "capture(0) keep() action(0:2-join): lamp lamp lamp"), ("bad", "capture(8) keep() action(): a"), ("none", "capture() keep() action(): a b"), ("null", None)]
    specs += [(f"s{k}", "capture(0 or_empty) keep() action(): " + line_of(rng)) for k in range(30)]
    compiled = edits.compile_scripts(spark.createDataFrame(specs, "name string, spec string"))
    errors = {r.name: r.error for r in compiled.collect()}
    assert {n for n, e in errors.items() if e} >= {"bad", "none", "null"} and not errors["wide"]
    good = [(n, re.compile(edits.pattern(edits.finished(s)))) for n, s in specs if not errors[n]]
    want = sorted(((k, n, sorted(m.groupdict().items())) for k, line in enumerate(lines) if line is not None for n, p in good if (m := p.fullmatch(line))), key=repr)
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    got = sorted(((r.k, r["name"], sorted(r.captured.items())) for r in edits.captured(df, compiled).collect()), key=repr)
    assert got == want and any(n == "wide" for _, n, _ in got)
