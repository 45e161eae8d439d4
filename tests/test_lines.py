"""Markers, signatures, slices and splitting of lines."""

import random
import re

from pyspark.sql import functions as F

from rowsmith.operators import lines as ln
from rowsmith.sources.documents import explode_lines, lines_of, read_texts

ALPHABET = "aBc 05.-+(["


def texts(rng, n):
    return [["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 7))] for _ in range(n)]


def first(lines, fits):
    return next((k for k, x in enumerate(lines) if fits(x)), None)


def test_markers_find_the_first_line(spark):
    """Plain text without regard to case, patterns, wildcards made out of lines, and places."""
    rng = random.Random(4)
    docs = texts(rng, 60)
    d = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(docs)], "k long, text string")
    place = lambda item: [r[1] for r in sorted(d.select("k", ln.position_of(lines_of(F.col("text")), item)).collect())]
    for _ in range(6):
        some = rng.choice([x for t in docs for x in t if len(x) > 1])
        part = some[: rng.randrange(1, 1 + len(some))]
        assert place(part.swapcase()) == [first(t, lambda x: part.lower() in x.lower()) for t in docs], part
        # Every mark of a line stands for itself, for any mark, for its kind, or with its neighbours for any run.
        wild, regex = "", ""
        for c in part:
            how = rng.randrange(4)
            if how == 0:
                wild, regex = wild + "?", regex + "."
            elif how == 1 and c.isdigit():
                wild, regex = wild + "[[:digit:]]", regex + "[0-9]"
            elif how == 2:
                wild, regex = wild + "*", regex + ".*"
            elif c not in "[+":
                wild, regex = wild + c, regex + re.escape(c)
        assert place(f"--wildcard {wild}") == [first(t, lambda x: re.search(regex, x, re.I)) for t in docs], wild
    for pattern in ("[05]{2}", "^b", r"\.$", "c[^a]+a"):
        assert place(f"--regex {pattern}") == [first(t, lambda x: re.search(pattern, x, re.I)) for t in docs]
    for k in (0, 2, 5, -1, -4):
        assert place(k) == [(k if k >= 0 else len(t) + k) if -len(t) <= k < len(t) else None for t in docs]
    assert place(None) == [None] * len(docs)


def test_signature(spark):
    want = {
        "": "start() end(space)", "    ": "start() end(space)", "\t ": "start() end(whitespace)", "unit 4 has 17": "unit digit() has digits()", "host 10.0.0.9 c::d": "host 10.0.0.9 c::d",
        "rule ======== end": "rule puncts() end", "load 0.75": "load number()", "7 8  9 55% + q": "digit() digit()  digit() mixed_number() + q",
    }
    d = spark.createDataFrame([(k,) for k in want], "line string")
    assert {r.line: r.s for r in d.select("line", ln.signature(F.col("line")).alias("s")).collect()} == want


def test_signature_of_a_place(spark):
    """A place from the end counts backwards; one that is not there is an error as a value."""
    d = spark.createDataFrame([(1, "a 1\nb 22\nc x"), (2, "only 5"), (3, None)], "doc_id long, text string")
    at = lambda i: {r.doc_id: (r.signature, r.error) for r in ln.signature_at(d, i).collect()}
    assert at(1) == {1: ("b digits()", None), 2: (None, "line 1 is not there"), 3: (None, "line 1 is not there")}
    assert at(-1)[1] == ("c x", None) and at(-1)[2] == ("only digit()", None) and at(-2)[2] == (None, "line -2 is not there")


def test_lines(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.line_no, r.line) for r in explode_lines(d).orderBy("doc_id", "line_no").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, ""), (3, 0, "")]
    (tmp_path / "x.txt").write_text("p\nq")
    assert read_texts(spark, str(tmp_path)).first()["text"] == "p\nq"


def test_kinds(spark):
    rows = ["", " \t", "word_1", " a b", "--- ===", "12:30", "11:22:33:44:55:66", "::1", "plain"]
    d = spark.createDataFrame([(x,) for x in rows], "x string")
    x = F.col("x")
    got = d.select(ln.is_empty(x), ln.is_word(x), ln.has_no_letter(x), ln.is_symbols(x), ln.is_clock_or_address(x), ln.leading(x), ln.trailing(x)).collect()
    assert [r[0] for r in got] == [True, True, *[False] * 7]
    assert [r[1] for r in got] == [False, False, True, *[False] * 5, True]
    assert [r[3] for r in got] == [False] * 4 + [True] + [False] * 4
    assert [r[4] for r in got] == [False] * 5 + [True] * 3 + [False]
    assert (got[1][5], got[1][6], got[3][5]) == (" \t", "", " ")


def test_between(spark):
    d = spark.createDataFrame([(1, "a\nSTART\nb\nEND\nc"), (2, "END\nx\nSTART\ny")], "doc_id long, text string")
    take = lambda **k: sorted((r.doc_id, r.line_no) for r in ln.between(d, "start", "end", **k).collect())
    assert take() == [(1, 1), (1, 2)]
    assert take(inclusive=False) == [(1, 2)]
