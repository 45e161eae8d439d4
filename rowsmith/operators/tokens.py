"""Edits of the tokens of a line: name, split, join, capture."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import PATTERN, actual_of, mask


def tokens_of(line: Column) -> Column:
    """The runs of text between blanks."""
    return F.filter(F.split(line, r"[ \t\n\x0b\f\r]+"), lambda t: t != "")


def symbolised(line: Column, label: str = "") -> Column:
    """array<struct<id, class, text>>: tokens with the names v0, v1, ... of the label."""
    # Masks first: a name is looked up in many places of a mask, each of which would work the mask out anew.
    masked = F.transform(tokens_of(line), lambda t: F.struct(t.alias("t"), mask(t).alias("m")))
    return F.transform(masked, lambda s, i: F.struct(F.concat(F.lit(f"v{label}"), i.cast("string")).alias("id"), actual_of(s["m"]).alias("class"), s["t"].alias("text")))


def split_token(token: Column, separators: str) -> Column:
    """The token cut at runs of the separators, which are tokens of their own."""
    s = re.escape(separators).replace("/", r"\/")
    return F.regexp_extract_all(token, F.lit(f"[^{s}]+|[{s}]+"), F.lit(0))


def join_tokens(line: Column, first: int, last: int) -> Column:
    """The text of a run of tokens with its spacing."""
    return F.regexp_extract(line, rf"\A *(?:[^ ]+ +){{{first}}}([^ ]+(?: +[^ ]+){{{last - first}}})", 1)


def joined(line: Column, places: list[int], label: str = "") -> Column:
    """struct<id, class, text>: the tokens at the places as one, under the first one's name and classified
    anew; each but the last keeps the blanks behind it."""
    parts = F.regexp_extract_all(F.trim(line), F.lit(r"[^ ]+ *"), F.lit(0))
    text = F.rtrim(F.concat(*(F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in places)))
    return F.struct(F.lit(f"v{label}{places[0]}").alias("id"), actual_of(mask(text)).alias("class"), text.alias("text"))


def captured(lines: DataFrame, pattern: list[tuple[str, str | None]], line: str = "line", or_empty: bool = False) -> DataFrame:
    """The captured tokens of all lines that match an edited line.

    pattern: for each token its class or, after `=`, its literal text, and the column or None to keep
    it only. Lines that do not match give no row. With or_empty the captured tokens may be missing, with
    the blanks before them, and give ''.
    """
    whole, names, placed = r"\A *", [], False
    for what, name in pattern:
        p = re.escape(what[1:]) if what.startswith("=") else PATTERN[what].replace("(", "(?:").replace(r"\(?:", r"\(")
        # Blanks stand before a token, once there is one that must be there; before that, behind it.
        gap, behind = (" +", "") if placed else ("", " +")
        if name and or_empty:
            whole += f"(?:{gap}({p}){behind})?"
        else:
            whole += gap + (f"({p})" if name else f"(?:{p})")
            placed = True
        names += [name] if name else []
    whole += r" *\z"
    return lines.where(F.col(line).rlike(whole)).select(*lines.columns, *(F.regexp_extract(line, whole, i + 1).alias(n) for i, n in enumerate(names)))
