"""Predicates, signatures and slices of lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import CLASSES, PUNCT
from ..sources.documents import lines_of

SPACE = r"[ \t\n\x0b\f\r]"


def leading(line: Column) -> Column:
    return F.regexp_extract(line, rf"\A{SPACE}*", 0)


def trailing(line: Column) -> Column:
    """White space at the end; all of a line that has nothing else counts as leading."""
    return F.when(line.rlike(rf"[^ \t\n\x0b\f\r]"), F.regexp_extract(line, rf"({SPACE}*)\z", 1)).otherwise("")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_empty(line: Column) -> Column:
    return ~line.rlike(r"[^ \t\n\x0b\f\r]")


def is_word(line: Column) -> Column:
    return stripped(line).rlike(r"\A[A-Za-z][A-Za-z0-9_]*\z")


def has_no_letter(line: Column) -> Column:
    return stripped(line).rlike(r"\A[^a-zA-Z0-9]+\z")


def is_symbols(line: Column) -> Column:
    """Runs of punctuation and blanks between them alone, as under a heading."""
    return line.rlike(rf"\A *{PUNCT}+(?: +{PUNCT}+)*+ *\z")


def is_clock_or_address(data: Column) -> Column:
    """Times, hardware addresses and addresses of version 6 hold colons that separate nothing."""
    return (
        data.rlike(r"[0-9]+(?::[0-9]+)+") | data.rlike(r"(?i)\A[0-9a-f]{2}(?:[:-][0-9a-f]{2}){5}") | data.rlike(r"(?i)\A[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}")
        | data.rlike(r"(?i)\A(?:[0-9a-f]{1,4}:)*:(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?\z") | data.startswith("::") | data.endswith("::")
    )


#: The classes that a signature replaces, each between white space or line ends. One mark is a class of its
#: own and stays.
MASKED = [(name, PUNCT + "{2,}" if name == "puncts" else re.sub(r"\((?!\?)(?<!\\\()", "(?:", dict(CLASSES)[name])) for name in ("digit", "digits", "number", "puncts", "mixed_number")]


def signature(line: Column) -> Column:
    """The line with its numeric and punctuation tokens replaced by their class; spacing stays.

    A line without a digit or two marks in a row has no such token, and is left as it is.
    """
    out = line
    for name, pattern in MASKED:
        out = F.regexp_replace(out, rf"(?<![^ \t\n\x0b\f\r]){pattern}(?![^ \t\n\x0b\f\r])", f"{name}()")
    blank = F.when(line.rlike(r"[^ ]"), "start() end(whitespace)").otherwise("start() end(space)")
    return F.when(is_empty(line), blank).when(line.rlike(f"[0-9]|{PUNCT}{{2}}"), out).otherwise(line)


def signature_at(docs: DataFrame, index: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, signature, error of the line at a place of each document; negative places count from the end.

    A place that a document does not have, and a null text, gives the error as a value.
    """
    lines = lines_of(F.col(text))
    at = F.lit(index) if index >= 0 else F.size(lines) + index
    d = docs.select(key, F.when(at >= 0, F.get(lines, at)).alias("_line"))
    return d.select(key, F.when(F.col("_line").isNotNull(), signature(F.col("_line"))).alias("signature"), F.when(F.col("_line").isNull(), f"line {index} is not there").alias("error"))


def signature_sql(line: str) -> str:
    """The same for DuckDB; twice each, as a blank may belong to two tokens."""
    out = line
    for name, pattern in MASKED:
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[ \\t\\n\\x0b\\f\\r]){pattern.replace('(?:', '(?:')}($|[ \\t\\n\\x0b\\f\\r])', '\\1{name}()\\2', 'g')"
    return f"CASE WHEN regexp_matches({line}, '[^ \\t\\n\\x0b\\f\\r]') THEN {out} WHEN regexp_matches({line}, '[^ ]') THEN 'start() end(whitespace)' ELSE 'start() end(space)' END"


# Bracket classes of wildcards and their counterparts.
_BRACKETS = {"[:digit:]": "0-9", "[:alpha:]": "a-zA-Z", "[:alnum:]": "a-zA-Z0-9", "[:space:]": r" \t\n\x0b\f\r", "[:punct:]": PUNCT[1:-1], "[:upper:]": "A-Z", "[:lower:]": "a-z"}


def marker_pattern(item: str) -> str:
    """The pattern of a marker: `--regex R`, `--wildcard W` or plain text; case does not count."""
    kind, _, rest = item.partition(" ")
    if kind == "--regex":
        return f"(?i){rest}"
    if kind == "--wildcard":
        for k, v in _BRACKETS.items():
            rest = rest.replace(k, v)
        rest = re.sub(r"([.()|^$+\\])", r"\\\1", rest)
        # A star after a class or a single mark stands for any run; braces repeat what is before them.
        return "(?i)" + rest.replace("*", ".*").replace("?", ".")
    return "(?i)" + re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", item)


def position_of(lines: Column, item: int | str | None) -> Column:
    """0-based place of the first line that a marker matches, or a valid index itself; else null.

    Negative indices count from the end.
    """
    if item is None:
        return F.lit(None).cast("int")
    if isinstance(item, int):
        return F.when(F.size(lines) > item, F.lit(item)) if item >= 0 else F.when(F.size(lines) >= -item, F.size(lines) + item)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(marker_pattern(item))), True)
    return F.when(at > 0, (at - 1).cast("int"))


def cut(docs: DataFrame, start: int | str | None, end: int | str | None, inclusive: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first (place of the first line that is kept), lines (an array), start_line and end_line: the lines
    of each document from a start marker to before an end marker, and the markers, null where there are none.

    Tables include the start line, categories do not; those also ignore an end before the start.
    Works on the lines of each row alone: no shuffle. A null text has no lines.
    """
    d = docs.select(key, F.coalesce(lines_of(F.col(text)), F.array().cast("array<string>")).alias("lines")).withColumn("a", position_of(F.col("lines"), start)).withColumn("b", position_of(F.col("lines"), end))
    a = F.coalesce(F.col("a") if inclusive else F.col("a") + 1, F.lit(0))
    b = F.col("b") if inclusive else F.when(~((F.col("a") > 0) & (F.col("b") > 0) & (F.col("a") >= F.col("b"))) | F.col("a").isNull(), F.col("b"))
    at = lambda c: F.when(F.col(c).isNotNull(), F.get("lines", F.col(c)))
    return d.select(key, a.alias("first"), F.slice("lines", a + 1, F.greatest(F.coalesce(b, F.size("lines")) - a, F.lit(0))).alias("lines"), at("a").alias("start_line"), at("b").alias("end_line"))


def between(docs: DataFrame, start: int | str | None, end: int | str | None, inclusive: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line: cut() with a row for each line."""
    return cut(docs, start, end, inclusive, key, text).select(key, "first", F.posexplode("lines").alias("n", "line")).select(key, (F.col("first") + F.col("n")).cast("long").alias("line_no"), "line")


def framed(body: list[str], starts: list[str], ends: list[str]) -> str:
    """The lines of a snippet between the rules for its markers, given as signatures."""
    first = [f"{x} -> Table" for x in starts]
    return "\n".join([*first, *(["Table"] if first else []), *body, *(f"{x} -> EOF" for x in ends)])


#: Rules of one kind that a snippet has at most: those of the most lines.
MOST_RULES = 200


def frequent(forms: DataFrame, form: str, most: int = MOST_RULES) -> DataFrame:
    """The rows of the forms of most lines (column n), equal ones by name: `most` of them.

    What reaches one place from each task is as many rows.
    """
    return forms.orderBy(F.desc("n"), form).limit(most)


def marker_forms(cuts: DataFrame, column: str) -> DataFrame:
    """form, n: the signatures of the markers of cut() in a column, start_line or end_line."""
    return cuts.where(F.col(column).isNotNull()).groupBy(signature(F.col(column)).alias("form")).agg(F.count("*").alias("n"))


def marker_signatures(cuts: DataFrame, most: int = MOST_RULES) -> tuple[list[str], list[str]]:
    """The signatures of the start and end markers of cut(), `most` of each at most: those of most documents."""
    one = lambda column: sorted(r["form"] for r in frequent(marker_forms(cuts, column), "form", most).collect())
    return one("start_line"), one("end_line")


def coverage(kinds: dict[str, DataFrame], form: str = "form", most: int = MOST_RULES) -> DataFrame:
    """kind, n_forms, n_lines, forms_kept, lines_kept: for forms with their lines (n), what frequent() leaves of them."""
    total = lambda d, names: d.agg(F.count("*").alias(names[0]), F.coalesce(F.sum("n"), F.lit(0)).alias(names[1]))
    each = [total(d, ("n_forms", "n_lines")).join(total(frequent(d, form, most), ("forms_kept", "lines_kept"))).select(F.lit(k).alias("kind"), "n_forms", "n_lines", "forms_kept", "lines_kept") for k, d in kinds.items()]  # one row to one row
    return reduce(DataFrame.union, each)
