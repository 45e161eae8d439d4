"""A ledger of quality rules: one bit a rule and the measurements behind it, evaluated once.

Policies are versioned sets of bits, so that a new policy, or the effect of leaving one rule out, is
a bitwise operation over the ledger and needs no text. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, table

#: Rules in order of their bit: the name, and the failure as a SQL expression over the measurements.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versioned policies: the bits that reject a document.
POLICIES = {"base": BASE, "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"], "v2": sum(BIT.values())}
POLICY = "v2"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often a lambda refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array.

    Windows go by their 64-bit hash, sorted with their places; a window whose neighbour in that
    order has the same hash is repeated, and the places that such windows cover are counted once.
    """

    def sorted_windows(hashed: Column) -> Column:
        return F.array_sort(F.transform(F.slice(hashed, F.lit(1), F.size(hashed) - 2), lambda _, i: F.struct(F.xxhash64(F.get(hashed, i), F.get(hashed, i + 1), F.get(hashed, i + 2)).alias("h"), i.alias("i"))))

    def covered(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda w, k: F.coalesce(F.get(ordered, k - 1)["h"] == w["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == w["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda w: F.array(w["i"], w["i"] + 1, w["i"] + 2)))))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(sorted_windows(h), covered)))


def measured(docs: DataFrame) -> DataFrame:
    """One row a document with its measurements. Null text has no words, lines or symbols."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents(docs).select(
        "doc_id",
        F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("lines"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
    )
    return d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and failures, the bits of all rules that a document fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs).withColumn("failures", total.cast("long"))


def passes(failures: Column, policy: int) -> Column:
    return failures.bitwiseAND(policy) == 0


def sole_failure(failures: Column, policy: int) -> Column:
    """The one bit of a policy that a row fails, if it fails just one: without that rule it would be kept."""
    own = failures.bitwiseAND(policy)
    return F.when((own != 0) & (own.bitwiseAND(own - 1) == 0), own).otherwise(F.lit(0)).cast("long")


def ablation(book: DataFrame, policy: int) -> DataFrame:
    """For each rule of a policy: rows that it fails, that it alone fails, and kept without it.

    A sum of bit tests over the ledger; partial sums leave each task, whatever the number of rows.
    """
    sums = [F.count("*").alias("total")]
    for name, bit in BIT.items():
        f = F.col("failures").bitwiseAND(policy)
        sums += [F.sum((f.bitwiseAND(bit) != 0).cast("long")).alias(f"{name}_failed"), F.sum((f == bit).cast("long")).alias(f"{name}_alone"), F.sum((f.bitwiseAND(~bit) == 0).cast("long")).alias(f"{name}_kept")]
    wide = book.agg(*sums)
    used = [n for n, b in BIT.items() if policy & b]
    parts = ", ".join(f"'{n}', coalesce({n}_failed, 0), coalesce({n}_alone, 0), coalesce({n}_kept, 0)" for n in used)
    return wide.select(F.expr(f"stack({len(used)}, {parts}) AS (rule, failed, alone, kept_without)"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    f = F.col("failures")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(f, BASE)).alias("base_failed"), passes(f, POLICIES[POLICY]).alias("kept"), "failures", "n_lines",
        *(passes(f, bits).alias(f"kept_{name}") for name, bits in POLICIES.items()), sole_failure(f, POLICIES[POLICY]).alias("sole_failure"),
    )


OP10_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM base),
windows AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS different
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (SELECT r, count(*) AS n, sum(length(w)) AS chars FROM words GROUP BY r),
m AS (
  SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(l.n - l.different, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN counts c USING (r) LEFT JOIN lines l USING (r) LEFT JOIN covered v USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures, n_lines::BIGINT AS n_lines,
  (failures & 3) = 0 AS kept_base, (failures & 15) = 0 AS kept_v1, failures = 0 AS kept_v2, CASE WHEN failures IN (1, 2, 4, 8, 16, 32) THEN failures ELSE 0 END AS sole_failure FROM f
"""
