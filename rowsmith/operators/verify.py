"""Verification of parsed records: counts, content, verdicts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verify_counts(parsed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, n_parsed, n_expected, ok. expected has a row for each record, or key and n_expected."""
    want = expected if "n_expected" in expected.columns else expected.groupBy(key).agg(F.count("*").alias("n_expected"))
    got = parsed.groupBy(key).agg(F.count("*").alias("n_parsed"))
    j = got.join(want.select(key, "n_expected"), key, "full").select(key, F.coalesce("n_parsed", F.lit(0)).alias("n_parsed"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"))
    return j.withColumn("ok", F.col("n_parsed") == F.col("n_expected"))


def verify_content(parsed: DataFrame, expected: DataFrame, keys: list[str], fields: list[str], ignore_space: bool = True) -> DataFrame:
    """keys, missing, unexpected, different: a row for each record that is not as expected, in order.

    ignore_space trims the parsed values only.
    """
    own = lambda f: F.trim(F.col(f)) if ignore_space else F.col(f)
    p = parsed.select(*keys, F.struct(*(own(f).alias(f) for f in fields)).alias("_p"))
    e = expected.select(*keys, F.struct(*(F.col(f) for f in fields)).alias("_e"))
    j = p.join(e, keys, "full")
    return j.where(~F.col("_p").eqNullSafe(F.col("_e"))).select(*keys, F.col("_p").isNull().alias("missing"), F.col("_e").isNull().alias("unexpected"), (F.col("_p").isNotNull() & F.col("_e").isNotNull()).alias("different"))


def verify_bag(parsed: DataFrame, expected: DataFrame, keys: list[str], fields: list[str], ignore_space: bool = True) -> DataFrame:
    """keys, fields, surplus: the rows that are there more often (surplus above 0) or less often than expected.

    Order does not count, repeated rows do, nulls equal nulls. Both sides are counted together and before
    the shuffle, so that a row repeated any number of times costs one row a task. ignore_space trims the
    parsed values only.
    """
    own = [F.trim(F.col(f)).alias(f) if ignore_space and dict(parsed.dtypes)[f] == "string" else F.col(f) for f in fields]
    both = parsed.select(*keys, *own, F.lit(1).alias("_n")).union(expected.select(*keys, *fields, F.lit(-1)))
    return both.groupBy(*keys, *fields).agg(F.sum("_n").alias("surplus")).where("surplus <> 0")


def verdicts(counts: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """key, ok, message: nothing parsed fails; else both checks have to hold."""
    bad = content.groupBy(key).agg(F.count("*").alias("n_bad"))
    j = counts.join(bad, key, "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))
    message = F.when(F.col("n_parsed") == 0, "no record").when(~F.col("ok"), F.concat(F.lit("expected "), F.col("n_expected").cast("string"), F.lit(" records, got "), F.col("n_parsed").cast("string"))).when(F.col("n_bad") > 0, "content differs").otherwise("ok")
    return j.select(key, (F.col("ok") & (F.col("n_bad") == 0) & (F.col("n_parsed") > 0)).alias("ok"), message.alias("message"))


def covered(line: Column, patterns: list[str]) -> Column:
    """Whether some pattern matches a whole line."""
    out = F.lit(False)
    for p in patterns:
        out = out | line.rlike(rf"\A(?:{p})\z")
    return out
