"""Documents and registries: words that templates need, best fits against trying all, records by name."""

import random
import re

import pytest

from rowsmith.operators import dispatch, templates

PIECES = ["load digits(var_a)", "disk word(var_b): digits(var_c)", "up  since mixed_word(var_d) end()", "x.y=digits(var_e)", "[digits(var_f)] done", "words(var_g) end()", "ignore_case__ Total digits(var_h)", "tag#letters(var_i, or_empty) ok"]
LINES = ["load 5", "load 77 now", "disk sda: 9", "up since 3d", "up   since x", "x.y=4", "[8] done", "[9] done!", "total 3", "TOTAL 44", "tag# ok", "tag#ab ok", "overload 6", "plain words", "1 2 3", ""]


def template(rng):
    snippet = "\n".join(p + rng.choice(["", " -> Record"]) if rng.random() < 0.8 else p + " -> Record" for p in rng.sample(PIECES, rng.randrange(1, 4)))
    return templates.compile_snippet(snippet)


def test_templates_read_back():
    for text in ["Start\ng word(var_g, meta_data_filldown) -> Inner\nInner\na digits(var_a, meta_data_list_required) -> Continue.Record\nz -> Next.Clear Start\nx -> EOF", "n words(var_n) => digits(var_m) end() -> Record\nend -> Error"]:
        t = templates.compile_snippet(text)
        assert dispatch.read_template(t.text()) == t
    for bad in ("", "Value x (a)", "Value x (a", "Value Odd x (a)\n\nStart\n  ^${x}", "Value x (a)\n\nStart\n  ^${x} -> Next.Odd Start", "Value x ([)\n\nStart\n  ^${x}", "Start\n  ^a", "Value x (a)\nStart\nno rule"):
        with pytest.raises(templates.SnippetError):
            dispatch.read_template(bad)


def test_needed_words():
    f = dispatch.needed_words
    assert f("^load ${a}") == {"load"} and f("^load${a} x$$") == {"x"} and f("^a +b\\.c d") == {"a", "b", "c"} and f("^a* b$$") == {"b"} and f("^(x|y) z ") == {"z"}
    assert f("^a|b") == set() and f("^(?i)a b ") == set() and f("^x[a-z ]+y z-") == {"z"} and f("^ab{2,} c$$") == {"c"} and f("^ab+ c$$") == {"c"} and f("^-+a -$$") == {"a"}


def test_candidates_lose_nothing():
    """Every template that gives a record is among those that are tried; the best is that of trying all."""
    rng = random.Random(3)
    for _ in range(60):
        rows = [(f"t{k}", template(rng).text()) for k in range(8)] + [("bad", "Value"), ("null", None)]
        own = dispatch.Registry(rows)
        assert set(own.errors) == {"bad", "null"}
        for _ in range(8):
            text = "\n".join(rng.choices(LINES, k=rng.randrange(0, 7)))
            scores = []
            for name, t in rows[:8]:
                got, _ = templates.Machine(dispatch.read_template(t)).records(text)
                filled = sum(bool(v) for r in got for v in r.values())
                if filled:
                    scores.append((-len(got), -filled, name))
            assert {n for *_, n in scores} <= set(own.candidates(text))
            best = min(scores, default=(0, 0, None))
            assert own.fit(text)[:3] == (best[2], -best[0], -best[1])


def test_tables(spark):
    rng = random.Random(8)
    rows = [(f"t{k}", template(rng).text()) for k in range(20)] + [("bad", "Value"), ("stop", "Value a (.+)\n\nStart\n  ^load -> Error\n  ^${a} -> Record")]
    texts = ["\n".join(rng.choices(LINES, k=5)) for _ in range(40)] + [None, ""]
    registry = spark.createDataFrame(rows, "name string, template string")
    docs = spark.createDataFrame([(k % 30, t, rows[k % len(rows)][0] if k % 4 else "lost") for k, t in enumerate(texts)], "doc long, text string, name string").repartition(3)
    own = dispatch.Registry(rows)
    want = sorted([(k % 30, *(own.fit(t)[:3] if t is not None else (None, 0, 0))) for k, t in enumerate(texts)], key=repr)
    for block in (dispatch.BLOCK, 300):
        got = dispatch.best_fit(docs, registry, "doc", block=block).collect()
        assert sorted([(r.doc, r["name"], r.n_records, r.n_values) for r in got], key=repr) == want, block
    got = {}
    for r in dispatch.parse_by_name(docs, registry, key="doc").collect():
        got.setdefault((r.doc, r["name"]), []).append((r.record_no, r.error, {**r["values"], **r["lists"]}))
    for r in docs.where("text IS NOT NULL").collect():
        found = [x for x in got.get((r.doc, r["name"]), [])]
        if r["name"] == "lost":
            assert (0, "no template 'lost'", {}) in found
        elif r["name"] != "bad":
            records, error = own.machine(r["name"]).records(r.text)
            assert all((i, None, x) in found for i, x in enumerate(records)) and (not error or (0, error, {}) in found)
    assert dispatch.best_fit(docs.limit(0), registry, "doc").collect() == [] and all(re.match("t|stop", n or "t") for _, n, *_ in want)


def test_words_of_required_values_leave_few_templates():
    forms = [(f"t{i}", f"Value Filldown id ([0-9]+)\nValue Required n ([0-9]+)\n\nStart\n  ^number ${{id}}$$\n  ^step{i}s ${{n}}$$ -> Record") for i in range(50)]
    own = dispatch.Registry([*forms, ("loose", "Value id ([0-9]+)\n\nStart\n  ^number ${id}$$"), ("any", "Value Required x (.)\nValue y (.)\n\nStart\n  ^${x}$$\n  ^number ${y}$$")])
    assert own.candidates("number 5\nstep7s 3") == ["any", "loose", "t7"]
    assert own.fit("number 5\nstep7s 3\nstep7s 4") == ("t7", 2, 4, 3)
    assert own.fit("number 5\nstep99s 3") == ("loose", 1, 1, 2)
