"""Classes of values and of sets of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classes as c
from ..functions.lattice import RELATION


def classified(values: DataFrame, value: str = "value") -> DataFrame:
    """values with class and actual (the sub-pattern) of each."""
    return values.withColumn("_mask", c.mask(F.col(value))).withColumn("class", c.class_of(F.col("_mask"))).withColumn("actual", c.actual_of(F.col("_mask"))).drop("_mask")


def class_of_sets(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n, n_empty, or_empty, class, actual: the first class that all values but empty ones match.

    Values are counted before they are classified, so that each distinct one is matched once.
    """
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    empty = F.coalesce(F.col(value), F.lit("")) == ""
    profile = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(empty, F.col("_n")).otherwise(0)).alias("n_empty"), F.bit_and(F.when(~empty, c.mask(F.col(value)))).alias("_mask"))
    return profile.select(*keys, "n", "n_empty", (F.col("n_empty") > 0).alias("or_empty"), c.class_of(F.col("_mask")).alias("class"), c.actual_of(F.col("_mask")).alias("actual"))


def dimension(spark: SparkSession) -> DataFrame:
    """actual, class, lessen, root, pattern: 30 rows."""
    return spark.createDataFrame(c.DIMENSION, "actual string, class string, lessen string, root string, pattern string")


def relation(spark: SparkSession) -> DataFrame:
    """a, b, is_subset, is_superset, recommended: 324 rows."""
    return spark.createDataFrame(RELATION, "a string, b string, is_subset boolean, is_superset boolean, recommended string")


def with_names(profile: DataFrame) -> DataFrame:
    """Adds lessen, root and pattern of the sub-pattern."""
    return profile.join(F.broadcast(dimension(profile.sparkSession)).drop("class"), "actual", "left")


def recommended_for(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) with is_subset, is_superset, recommended."""
    return pairs.join(F.broadcast(relation(pairs.sparkSession)), ["a", "b"], "left")


def snippet(actual: Column, variable: Column, or_empty: Column | None = None) -> Column:
    """`class(var_name)` or `class(var_name, or_empty)`."""
    option = F.when(or_empty, ", or_empty").otherwise("") if or_empty is not None else F.lit("")
    return F.concat(actual, F.lit("(var_"), variable, option, F.lit(")"))


def regex(actual: Column, variable: Column, level: str = "actual") -> Column:
    """`(?P<name>pattern)` of a slot at a level of its class: actual, lessen (any gaps) or root (any text)."""
    names = {a: {"actual": a, "lessen": le, "root": r}[level] for a, _, le, r, _ in c.DIMENSION}
    patterns = F.create_map(*(F.lit(x) for a, n in names.items() for x in (a, c.PATTERN[n])))
    # A lookup becomes a choice that names its key 30 times: the key is worked out before.
    pattern = F.get(F.transform(F.array(actual), lambda a: F.element_at(patterns, a)), 0)
    return F.concat(F.lit("(?P<"), variable, F.lit(">"), pattern, F.lit(")"))


def readable_snippet(actual: Column, variable: Column, value: Column) -> Column:
    """`class(var=name, value=x)`; parentheses of the value are spelled out."""
    safe = F.replace(F.replace(value, F.lit("("), F.lit("_SYMBOL_LEFT_PARENTHESIS_")), F.lit(")"), F.lit("_SYMBOL_RIGHT_PARENTHESIS_"))
    return F.concat(actual, F.lit("(var="), variable, F.lit(", value="), safe, F.lit(")"))


def singular(values: Column) -> Column:
    """First token of the first value."""
    return F.split(F.trim(F.get(values, 0)), " +")[0]


def plural(values: Column) -> Column:
    """First value with a blank, else the first token twice."""
    several = F.filter(values, lambda v: F.trim(v).contains(" "))
    return F.coalesce(F.get(several, 0), F.concat(singular(values), F.lit(" "), singular(values)))


def is_group(values: Column) -> Column:
    """Whether some value has several tokens, and whether some has them wide apart."""
    return F.exists(values, lambda v: F.trim(v).rlike("[^ ] +[^ ]"))


def is_group_with_multi_spaces(values: Column) -> Column:
    return F.exists(values, lambda v: F.trim(v).rlike("[^ ]  +[^ ]"))


def is_plural(values: Column) -> Column:
    """Whether all values have several tokens."""
    return F.forall(values, lambda v: F.trim(v).rlike("[^ ] +[^ ]"))


def is_singular(values: Column) -> Column:
    """Whether all values have one token."""
    return F.forall(values, lambda v: F.trim(v).rlike(r"\A[^ ]+\z"))


def is_mixing(values: Column) -> Column:
    """Whether some values have one token and some have several."""
    return ~is_singular(values) & ~is_plural(values)


def is_numeric(values: Column) -> Column:
    return F.forall(values, lambda v: v.rlike(r"\A\p{N}+\z"))


def is_alphabet(values: Column) -> Column:
    return F.forall(values, lambda v: v.rlike(r"\A\p{L}+\z"))


def is_not_alphabet(values: Column) -> Column:
    """Whether no value is all letters."""
    return F.forall(values, lambda v: ~v.rlike(r"\A\p{L}+\z"))


def is_printable(values: Column) -> Column:
    return F.forall(values, lambda v: ~v.rlike(r"[\p{C}\p{Zl}\p{Zp}]") & ~F.replace(v, F.lit(" "), F.lit("")).rlike(r"\p{Zs}"))


def is_punctuation(values: Column) -> Column:
    return is_printable(values) & F.forall(values, lambda v: v.rlike(r"\A[^\p{L}\p{N}]+\z"))


def recommendations(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The columns of pairs and class_a, class_b, recommended, translated: the class that the first value's
    class recommends beside the second's, and whether it fits both values.

    A recommended class may fit neither (digits beside letters: word), and then has no pattern for them.
    Values that no class fits, empty and null ones, and classes without a recommendation give nulls and
    false. The relation of classes is 324 rows, broadcast.
    """
    relation = pairs.sparkSession.createDataFrame([(x, y, r) for x, y, _, _, r in RELATION], "class_a string, class_b string, recommended string")
    found = pairs.withColumn("_ma", c.mask(F.col(a))).withColumn("_mb", c.mask(F.col(b))).withColumn("class_a", c.class_of(F.col("_ma"))).withColumn("class_b", c.class_of(F.col("_mb")))
    joined = found.join(F.broadcast(relation), ["class_a", "class_b"], "left")
    return joined.select(*pairs.columns, "class_a", "class_b", "recommended", F.coalesce(_fits(F.col("_ma").bitwiseAND(F.col("_mb")), F.col("recommended")), F.lit(False)).alias("translated"))


def _fits(m: Column, name: Column) -> Column:
    """Whether a mask has a sub-pattern of a class."""
    out = F.lit(False)
    for own in c.NAMES:
        bits = sum(1 << k for k, s in enumerate(c.SUBS) if s[0] == own)
        out = F.when(name == own, m.bitwiseAND(bits) != 0).otherwise(out)
    return out
