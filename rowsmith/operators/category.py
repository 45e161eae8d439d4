"""`key: value` lines to pairs and records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import PUNCT
from ..sources.documents import kept, lines_of
from .lines import MOST_RULES, coverage, cut, framed, frequent, is_clock_or_address, marker_forms, marker_signatures, signature

_CLOCK = re.compile(r"[0-9]+(:[0-9]+)+")
_MAC = re.compile(r"(?i)[0-9a-f]{2}([:-][0-9a-f]{2}){5}")
_V6 = re.compile(r"(?i)[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}|([0-9a-f]{1,4}:)*:([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?\Z")


def variable_of(key: Column) -> Column:
    """Key to column name: runs of blanks and punctuation become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(key, rf"(?: |{PUNCT})+", "_"), r"\A_+|_+\z", "")


def first_pair(line: Column, separator: str = ":") -> Column:
    """struct(key, value) of the first separator; null if there is none, nothing stands before it, or it
    is part of a time or address. An empty value stays empty."""
    at = F.instr(line, separator)
    before = F.substring_index(line, separator, 1)
    after = F.substring(line, at + len(separator), F.length(line))
    # The word around the separator loses the separator itself where a blank follows.
    word = F.concat(F.regexp_extract(before, r"[^ ]*\z", 0), F.when(after.startswith(" ") | (after == ""), "").otherwise(F.concat(F.lit(separator), F.regexp_extract(after, r"\A[^ ]*", 0))))
    return F.when((at > 1) & ~is_clock_or_address(word), F.struct(F.trim(before).alias("key"), F.ltrim(after).alias("value")))


def _holds_separators(word: str) -> bool:
    return bool(_CLOCK.search(word) or _MAC.match(word) or _V6.match(word) or word.startswith("::") or word.endswith("::"))


def split_pairs(line: str, count: int = 1, separator: str = ":") -> list[tuple[str, str]]:
    """Up to count pairs of a line. A key starts after the last wide gap before its separator, if there
    is one, else after the last blank; separators inside times and addresses belong to values."""
    marks = []
    at = line.find(separator)
    while at >= 0:
        a, b = line.rfind(" ", 0, at) + 1, line.find(" ", at)
        word = line[a : b if b >= 0 else len(line)]
        tail = word[:-1] if word.endswith((separator, ",")) and not word.endswith(2 * separator) else word
        if not _holds_separators(tail) and (at > a or line[:a].strip()):
            marks.append(at)
            at = line.find(separator, b if b >= 0 else len(line))
        else:
            at = line.find(separator, max(b, at + 1) if b >= 0 else len(line))
    if not marks or not line[: marks[0]].strip():
        return []
    out, key, start = [], line[: marks[0]].strip(), marks[0] + len(separator)
    for mark in marks[1:]:
        if len(out) + 1 >= count:
            break
        left = line[start:mark].rstrip()
        gaps = list(re.finditer(" {2,}", left)) or list(re.finditer(" +", left))
        if not gaps:
            continue
        out.append((key, left[: gaps[-1].start()].strip()))
        key, start = left[gaps[-1].end() :], mark + len(separator)
    out.append((key, line[start:].strip()))
    return out


def pairs(lines: DataFrame, keys: list[str], count: int = 1, separator: str = ":", line: str = "line") -> DataFrame:
    """keys, pair_no, key, variable, value: a row for each pair of each line; lines without any give none."""
    found = _split_udf(count, separator)(F.col(line))
    rows = lines.select(*keys, F.posexplode(found).alias("n", "p"))
    return rows.select(*keys, F.col("n").cast("long").alias("pair_no"), F.col("p.key").alias("key"), variable_of(F.col("p.key")).alias("variable"), F.col("p.value").alias("value"))


def _split_udf(count: int, separator: str):
    @F.pandas_udf("array<struct<key:string,value:string>>")
    def split(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [{"key": k, "value": v} for k, v in split_pairs(x, count, separator)] if x is not None else [])

    return split


def wide_pairs(lines: DataFrame, names: list[str], count: int, separator: str = ":", line: str = "line") -> DataFrame:
    """lines with one column a name; '' where a line has no such pair. One row a line, no shuffle."""
    found = lines.withColumn("_pairs", _split_udf(count, separator)(F.col(line)))
    found = found.withColumn("_pairs", F.transform("_pairs", lambda p: F.struct(variable_of(p["key"]).alias("key"), p["value"].alias("value"))))
    cell = lambda n: F.coalesce(F.get(F.filter("_pairs", lambda p: p["key"] == n), 0)["value"], F.lit(""))
    return found.select("*", *(cell(n).alias(n) for n in names)).drop("_pairs")


def records(docs: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", separator: str = ":") -> DataFrame:
    """One record a document from its lines of one pair each, and whether any line was one.

    The first line with a key counts; missing keys are ''. Works inside each row: no shuffle.
    """
    found = F.filter(F.transform(lines_of(F.col(text)), lambda x: first_pair(x, separator)), lambda p: p.isNotNull())
    d = docs.select(key, F.transform(found, lambda p: F.struct(variable_of(p["key"]).alias("key"), p["value"].alias("value"))).alias("_pairs"))
    cell = lambda n: F.coalesce(F.get(F.filter("_pairs", lambda p: p["key"] == n), 0)["value"], F.lit(""))
    return d.select(key, *(cell(n).alias(n) for n in names), (F.size("_pairs") > 0).alias("is_category"))


def _lines_udf(options: dict[int, tuple[int, str]], count: int, separator: str):
    """The pairs of all lines of an array, each with the line's place and the keys of its line; a line
    without any is kept whole, with a null key."""

    @F.pandas_udf("array<struct<line_no:long,pair_no:long,shape:string,key:string,value:string>>")
    def split(blocks: pd.Series) -> pd.Series:
        out = []
        for lines in blocks:
            rows = []
            for i, x in enumerate(lines if lines is not None else ()):
                found = split_pairs(x, *options.get(i, (count, separator)))
                shape = "\n".join(k for k, _ in found)
                rows += [{"line_no": i, "pair_no": n, "shape": shape, "key": k, "value": v} for n, (k, v) in enumerate(found)] or [{"line_no": i, "pair_no": 0, "shape": None, "key": None, "value": x}]
            out.append(rows)
        return pd.Series(out, dtype=object)

    return split


def block_pairs(docs: DataFrame, starting_from: int | str | None = None, ending_to: int | str | None = None, options: dict[int, tuple[int, str]] | None = None, count: int = 1, separator: str = ":", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pairs, start_line, end_line: the pairs of the lines between two markers, neither included.

    options gives count and separator of single lines, by their place from the start of the block. Lines
    without pairs are kept as literals. Works inside each row of docs: no shuffle.
    """
    return cut(docs, starting_from, ending_to, False, key, text).select(key, _lines_udf(options or {}, count, separator)(F.col("lines")).alias("pairs"), "start_line", "end_line")


def block_records(blocks: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """One record for each of block_pairs(): the first value of each name, '' where there is none, and
    whether the block has any pair at all."""
    d = blocks.select(key, F.transform(F.filter("pairs", lambda p: p["key"].isNotNull()), lambda p: F.struct(variable_of(p["key"]).alias("key"), p["value"].alias("value"))).alias("_pairs"))
    cell = lambda n: F.coalesce(F.get(F.filter("_pairs", lambda p: p["key"] == n), 0)["value"], F.lit(""))
    return d.select(key, *(cell(n).alias(n) for n in names), (F.size("_pairs") > 0).alias("is_category"))


def block_rules(blocks: DataFrame, separator: str = ":") -> DataFrame:
    """order, rule, n, is_pairs: a line of `key: class(var_name)` for each different line of keys, with the first place of
    one, the class of all values and the number of such lines; lines without pairs by their signature."""
    from .profiles import class_of_sets

    p = blocks.select(F.explode("pairs").alias("p")).select("p.*").withColumn("variable", variable_of(F.col("key")))
    keyed = p.where(F.col("key").isNotNull())
    place = keyed.groupBy("shape", "pair_no").agg(F.min("line_no").alias("first"), F.count("*").alias("lines"), F.min("key").alias("key"), F.min("variable").alias("variable"))
    profile = class_of_sets(keyed.select("shape", "pair_no", "value"), ["shape", "pair_no"]).join(place, ["shape", "pair_no"])
    gap = F.when(F.col("or_empty"), "zero_or_spaces()").otherwise(" ")
    slot = F.when(F.col("actual").isNull(), F.concat(F.lit("something(var_"), "variable", F.lit(", or_empty)"))).otherwise(F.concat("actual", F.lit("(var_"), "variable", F.when(F.col("or_empty"), ", or_empty").otherwise(""), F.lit(")")))
    part = F.concat("key", F.lit(separator), gap, slot)
    # The pairs of one line make one list.
    rules = profile.groupBy("shape").agg(F.min("first").alias("order"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pair_no", part.alias("part")))), lambda x: x["part"]), "  ").alias("rule"), F.max("lines").alias("n")).select("order", "rule", "n", F.lit(True).alias("is_pairs"))
    literal = p.where(F.col("key").isNull() & F.col("value").rlike("[^ ]")).groupBy(signature(F.col("value")).alias("rule")).agg(F.min("line_no").alias("order"), F.count("*").alias("n")).select("order", "rule", "n", F.lit(False).alias("is_pairs"))
    return rules.union(literal)


def block_template(blocks: DataFrame, separator: str = ":", most: int = MOST_RULES) -> str:
    """The snippet of blocks between markers: a rule to enter at each form of the start marker, block_rules()
    in the order of their first places, and one to stop at each form of the end marker.

    Of lines of keys, free lines and markers those forms that most lines have, `most` of each: as many rows
    reach the driver. block_coverage() says how many lines these are. Free lines capture nothing, so that the
    records are the same without their rules, unless another rule takes one of them for its own.
    """
    # Written once: rules and markers are read from them in several passes, each of which would find all pairs anew.
    blocks = kept(blocks.select("pairs", "start_line", "end_line"))
    rules = block_rules(blocks, separator)
    found = [(r["order"], r["rule"]) for own in (rules.where("is_pairs"), rules.where("NOT is_pairs")) for r in frequent(own, "rule", most).collect()]
    return framed([rule for _, rule in sorted(found)], *marker_signatures(blocks, most))


def block_coverage(blocks: DataFrame, separator: str = ":", most: int = MOST_RULES) -> DataFrame:
    """kind (pairs, free, start, end), n_forms, n_lines, forms_kept, lines_kept: what block_template() has rules for."""
    blocks = kept(blocks.select("pairs", "start_line", "end_line"))
    rules = block_rules(blocks, separator).withColumnRenamed("rule", "form")
    kinds = {"pairs": rules.where("is_pairs"), "free": rules.where("NOT is_pairs"), "start": marker_forms(blocks, "start_line"), "end": marker_forms(blocks, "end_line")}
    return coverage(kinds, most=most)


def block_snippet(found: DataFrame) -> DataFrame:
    """snippet: one line of `key: class(var_name)` for all keys of pairs(), in the order of their first places.

    One row a key is gathered, as many as there are keys.
    """
    from .profiles import class_of_sets

    first = found.groupBy("variable").agg(F.min(F.struct("pair_no", "key")).alias("first"))
    profile = class_of_sets(found.select("variable", "value"), ["variable"]).join(first, "variable")
    slot = F.when(F.col("actual").isNull(), F.concat(F.lit("something(var_"), "variable", F.lit(", or_empty)"))).otherwise(F.concat("actual", F.lit("(var_"), "variable", F.when(F.col("or_empty"), ", or_empty").otherwise(""), F.lit(")")))
    part = F.concat(F.col("first.key"), F.lit(": "), slot)
    return profile.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("first.pair_no").alias("o"), part.alias("part")))), lambda x: x["part"]), "  ").alias("snippet"))
