"""Classes of values and sets, and the relations between classes."""

import pytest
from pyspark.sql import functions as F

from rowsmith.functions import classes as c
from rowsmith.functions.lattice import BESIDE, RELATION, SUBSET_OF, SUPERSET_OF, recommended
from rowsmith.operators import profiles as p

SETS = [
    (["1"], "digit"), (["1", "2"], "digit"), (["12"], "digits"), (["1", "12"], "digits"), (["1.1"], "number"), (["1", "1.1", ".5"], "number"), (["a"], "letter"), (["abc"], "letters"), (["a", "1"], "alphabet_numeric"),
    (["abc1"], "word"), (["-"], "punct"), (["-+"], "puncts"), (["-- ++"], "puncts_phrase"), (["--  ++"], "puncts_group"), (["-", "-- ++"], "puncts_or_phrase"), (["a", "-"], "graph"), (["1,234"], "mixed_number"), (["$1.5"], "mixed_number"),
    (["a.b"], "mixed_word"), (["abc xyz"], "phrase"), (["abc", "abc xyz"], "words"), (["abc  xyz"], "word_group"), (["abc", "abc  xyz"], "word_or_group"), (["a.b c.d"], "mixed_phrase"), (["a.b", "a.b c"], "mixed_words"), (["a.b  c"], "mixed_word_group"),
    (["é"], "non_whitespace"), (["éa"], "non_whitespaces"), (["abc", "123", "-+"], "non_whitespaces"), (["abc", "-+", "a b"], "non_whitespaces_or_phrase"), (["-- é"], "non_whitespaces_phrase"), (["--  é"], "non_whitespaces_group"), ([""], None), ([" "], None),
]


def test_sets(spark):
    rows = [(i, v) for i, (values, _) in enumerate(SETS) for v in values]
    d = spark.createDataFrame(rows, "i int, value string")
    got = {r.i: r.actual for r in p.class_of_sets(d, ["i"]).collect()}
    assert got == {i: want for i, (_, want) in enumerate(SETS)}


def test_mask_of_a_union_is_the_mask_of_its_parts(spark):
    d = spark.createDataFrame([(i % 3, v) for i, v in enumerate(["abc", "a1", "x", "q9", "word", "z z"])], "k int, value string").withColumn("m", c.mask(F.col("value")))
    parts = d.groupBy("k").agg(F.bit_and("m").alias("m")).agg(F.bit_and("m").alias("m")).first()["m"]
    assert parts == d.agg(F.bit_and("m").alias("m")).first()["m"]


def test_long_lines_do_not_exhaust_the_stack(spark):
    d = spark.createDataFrame([("word " * 20_000 + "end",)], "value string")
    assert p.classified(d).first()["actual"] == "phrase"


def test_relation():
    assert len(RELATION) == 18 * 18
    for a in c.NAMES:
        assert not set(BESIDE[a]) & (SUBSET_OF[a] | SUPERSET_OF[a])
        assert recommended(a, a) == a
    assert recommended("digits", "graph") == "non_whitespaces" and recommended("graph", "digits") == "mixed_word"


@pytest.mark.parametrize("name, lessen, root", [("phrase", "word_or_group", "non_whitespaces_or_group"), ("digits", "digits", "non_whitespaces"), ("graph", "graph", "non_whitespace")])
def test_names(name, lessen, root):
    assert (c.lessen_name(name), c.root_name(name)) == (lessen, root)


def test_snippets(spark):
    d = spark.createDataFrame([("digits", "v0", "(1)", True)], "a string, v string, x string, e boolean")
    r = d.select(p.snippet(F.col("a"), F.col("v"), F.col("e")).alias("s"), p.readable_snippet(F.col("a"), F.col("v"), F.col("x")).alias("r")).first()
    assert r.s == "digits(var_v0, or_empty)" and r.r == "digits(var=v0, value=_SYMBOL_LEFT_PARENTHESIS_1_SYMBOL_RIGHT_PARENTHESIS_)"


def test_predicates(spark):
    d = spark.createDataFrame([(["12", "½"], ["ab", "é"], ["--", "+"], ["a b", "c"], ["a  b"])], "n array<string>, a array<string>, p array<string>, g array<string>, w array<string>")
    r = d.select(p.is_numeric(F.col("n")), p.is_alphabet(F.col("a")), p.is_punctuation(F.col("p")), p.is_group(F.col("g")), p.is_group_with_multi_spaces(F.col("g")), p.is_group_with_multi_spaces(F.col("w")), p.plural(F.col("n")), p.singular(F.col("g"))).first()
    assert list(r) == [True, True, True, True, False, True, "12 12", "a"]


def test_class_of_a_token(spark):
    """The first pattern that matches, as by the mask of all."""
    import random

    rng = random.Random(5)
    tokens = [None, "", *("".join(rng.choice("aZ09.-+$(,:%é«/") for _ in range(rng.randrange(1, 6))) for _ in range(1500))]
    d = spark.createDataFrame([(t,) for t in tokens], "t string")
    assert d.where(~c.class_of_token(F.col("t")).eqNullSafe(c.class_of(c.mask(F.col("t"))))).count() == 0
