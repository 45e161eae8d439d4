"""Patterns of many clusters against those of each cluster by itself."""

import random
import re

from pyspark.sql import functions as F

from rowsmith.operators import clusters, mining, templates


def test_clusters_as_each_by_itself(spark):
    """Clusters of one form, of several words that may lack, of tabs and blanks around; keys that lack; blank and null lines."""
    rng = random.Random(6)
    rows, single = [], {}
    for k in range(30):
        form = rng.choice(["a {n} b", "  a {n}{w} b ", "x {t} {n}", "{t}: {n}/{n} {t}", "same", "p\t{n}  q"])
        lines = [form.format(n=rng.randrange(10, 99999), w=rng.choice(["", " more"]), t=rng.choice(["up", "down", "left", "to-day"])) for _ in range(rng.randrange(1, 12))]
        key = None if k == 0 else k
        single[key] = lines
        rows += [(key, x) for x in lines] + [(key, "  "), (key, None)]
    rng.shuffle(rows)
    got = {r.k: r for r in clusters.patterns(spark.createDataFrame(rows, "k long, line string").repartition(6), "k").collect()}
    assert set(got) == set(single)
    table = {r.k: r for r in mining.matching_patterns(spark.createDataFrame([(k or 0, x) for k, x in rows], "k long, line string"), "k").collect()}
    for key, lines in single.items():
        r = got[key]
        assert r.n == len(lines) and (r.error is None) == (r.pattern is not None)
        if len({x.strip() for x in lines}) < 2:
            assert r.error == mining.TOO_FEW
        elif r.pattern:
            assert all(re.fullmatch(r.pattern, x) for x in lines), (r.pattern, lines)
        assert (r.pattern, r.snippet) == (table[key or 0].pattern, table[key or 0].snippet)


def test_rounds_learn_from_lines_that_fail(spark):
    """A sample of two lines says nothing of the words that the others hold."""
    lines = [f"put {i} to k" for i in range(100, 130)] + ["put 2.25 to k", "put 3 to kk", "put 1:30 to longer"]
    r = clusters.patterns(spark.createDataFrame([("p", x) for x in lines], "k string, line string"), "k", sample=2).first()
    assert r.error is None and all(re.fullmatch(r.pattern, x) for x in lines) and templates.compile_snippet(r.snippet).values
    assert clusters.patterns(spark.createDataFrame([], "k string, line string"), "k").collect() == []


def test_class_sequence(spark):
    d = spark.createDataFrame([("go 12 x-y",), ("7  go",), ("",), (None,), ("«» a",)], "line string")
    assert [r[0] for r in d.select(clusters.class_sequence(F.col("line"))).collect()] == ["go digits mixed_word", "digit letters", "", None, "non_whitespaces letter"]
