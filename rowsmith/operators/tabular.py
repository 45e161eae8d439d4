"""Tables in text: columns by the positions of a reference row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import PUNCT, actual_of, class_of, mask, names_of
from ..sources.documents import Texts, kept, lines_of, pieces_of
from .lines import MOST_RULES, cut, framed, frequent, is_symbols, marker_signatures, signature
from .templates import AT_ONCE


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), 0)


def _running(lengths: Column) -> Column:
    """0 and the running sums of all lengths but the last."""
    return F.aggregate(F.slice(lengths, F.lit(1), F.greatest(F.size(lengths) - 1, F.lit(0))), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def starts_by_widths(widths: list[int | None]) -> Column:
    """Fixed widths; the last one may be left open."""
    out, at = [], 0
    for w in widths:
        out.append(F.lit(at))
        at += w or 0
    return F.array(*out)


def starts_by_divider(row: Column, divider: str) -> Column:
    """Each cell starts where the reference row has a divider; the divider belongs to the cell before."""
    return _running(F.transform(F.split(row, re.escape(divider)), lambda p: F.length(p) + len(divider)))


def starts_by_gaps(row: Column, least: int = 2) -> Column:
    """Each cell starts at a run of text that least blanks or more separate from the one before."""
    return _running(F.transform(F.regexp_extract_all(row, F.lit(rf"(?:[^ ]| {{1,{least - 1}}}(?=[^ ]))+ *" if least > 1 else r"[^ ]+ *"), F.lit(0)), lambda p: F.length(p)))


def starts_by_rule(row: Column) -> Column:
    """Each cell starts at a run of symbols of a rule line, as in `---- ---`."""
    return _running(F.transform(F.regexp_extract_all(row, F.lit(PUNCT + "+ *"), F.lit(0)), lambda p: F.length(p)))


def _each(starts: Column, columns: int | None, use) -> Column:
    """use(start, its number) of all starts; written out where their number is known, which costs a fraction."""
    return F.array(*(use(F.get(starts, F.lit(i)), F.lit(i)) for i in range(columns))) if columns else F.transform(starts, use)


def cells_of(line: Column, starts: Column, divider: str = "", columns: int | None = None) -> Column:
    """The cells of a line: plain slices by position, the last to the end; divider and blanks trimmed.

    What overruns its column is cut there, as the positions alone decide. columns: how many starts there are, if known.
    """
    n = F.size(starts)

    def cell(start: Column, i: Column) -> Column:
        raw = F.when(i + 1 < n, F.substring(line, start + 1, F.get(starts, i + 1) - start)).otherwise(F.substring(line, start + 1, F.greatest(F.length(line), F.lit(1))))
        if divider:
            raw = F.regexp_replace(raw, rf"\A *(?:{re.escape(divider)})? *| *(?:{re.escape(divider)})? *\z", "")
        return F.trim(raw)

    return _each(starts, columns, cell)


def edges_of(line: Column, starts: Column, columns: int | None = None) -> Column:
    """array<struct<left, right>>: where the text of each cell begins and ends; null for empty cells."""
    n = F.size(starts)

    def edge(start: Column, i: Column) -> Column:
        raw = F.when(i + 1 < n, F.substring(line, start + 1, F.get(starts, i + 1) - start)).otherwise(F.substring(line, start + 1, F.greatest(F.length(line), F.lit(1))))
        left = start + F.length(raw) - F.length(F.ltrim(raw))
        return F.when(F.trim(raw) != "", F.struct(left.cast("long").alias("left"), (left + F.length(F.trim(raw))).cast("long").alias("right")))

    return _each(starts, columns, edge)


def layout_of(cells: Column, columns: int | None = None) -> Column:
    """1 for each cell with content, else 0."""
    if columns:
        return F.concat(*(F.when(F.get(cells, F.lit(i)) == "", "0").otherwise("1") for i in range(columns)))
    return F.array_join(F.transform(cells, lambda c: F.when(c == "", "0").otherwise("1")), "")


def mode_of(divider: str = "  ", widths: list[int | None] | None = None, reference: str | None = None) -> str:
    """How cells are found: by widths, by a divider, by a reference row that is given, by single blanks,
    by gaps of two blanks or more, or by a rule of symbols; ValueError for other dividers."""
    if widths:
        return "widths"
    if re.fullmatch(PUNCT, divider):
        return "divider"
    if reference is not None:
        return "reference"
    if divider == " ":
        return "blanks"
    if re.fullmatch(" {2,}", divider):
        return "gaps"
    if divider == "":
        return "rule"
    raise ValueError(f"no such divider: {divider!r}")


def _body(docs: DataFrame, columns: int, divider: str, widths: list[int | None] | None, rule: bool, gap: int, reference: str | None, key: str, lines: Column) -> DataFrame:
    """key, lines, starts, ref (place of the reference row): documents that have such a row."""
    start_of = (lambda x: starts_by_widths(widths)) if widths else (lambda x: starts_by_rule(x)) if rule else (lambda x: starts_by_divider(x, divider)) if divider else (lambda x: starts_by_gaps(x, gap))
    d = docs.select(key, lines.alias("lines"))
    if reference is not None:
        row = F.lit(reference)
        return d.withColumn("starts", F.when(is_symbols(row), starts_by_rule(row)).otherwise(starts_by_gaps(row, gap))).withColumn("ref", F.lit(-1)).where(F.size("starts") == columns)
    fits = lambda x: (is_symbols(x) if rule else ~is_symbols(x)) & (F.size(start_of(x)) == columns)
    # Lines are tried up to the first that fits: -1 - n stands for n lines that do not.
    first = F.aggregate("lines", F.lit(-1), lambda at, x: F.when(at >= 0, at).when(fits(x), -1 - at).otherwise(at - 1))
    d = d.withColumn("ref", first).where("ref >= 0")
    return d.withColumn("starts", start_of(F.get("lines", F.col("ref"))))


def rows(docs: DataFrame, columns: int, divider: str = "", widths: list[int | None] | None = None, rule: bool = False, gap: int = 2, reference: str | None = None, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """key, row_no, line, starts, cells, edges, layout of the rows below the reference row of each document.

    The reference row is the first line that has the given number of columns: by widths the first line,
    by a divider, by a rule of symbols, or else by gaps; with a reference row that is given, all lines are
    rows. Rows of symbols are left out, and blank lines. text: a column of texts, or an array of lines.
    Works inside each row of docs: no shuffle.
    """
    d = _body(docs, columns, divider, widths, rule, gap, reference, key, lines_of(F.col(text)) if isinstance(text, str) else text)
    body = F.filter(F.slice("lines", F.col("ref") + 2, F.size("lines")), lambda x: ~is_symbols(x) & x.rlike("[^ ]"))
    d = d.select(key, "starts", F.posexplode(body).alias("n", "x"))
    x, starts = F.col("x"), F.col("starts")
    d = d.select(key, F.col("n").cast("long").alias("row_no"), x.alias("line"), "starts", cells_of(x, starts, divider, columns).alias("cells"), edges_of(x, starts, columns).alias("edges"))
    return d.withColumn("layout", layout_of(F.col("cells"), columns))


def parsed(docs: DataFrame, columns: int, divider: str = "  ", widths: list[int | None] | None = None, reference: str | None = None, key: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """rows() in the mode that the arguments name, as mode_of() ranks them."""
    mode = mode_of(divider, widths, reference)
    how = {"widths": {"widths": widths}, "divider": {"divider": divider}, "reference": {"reference": reference}, "blanks": {"gap": 1}, "gaps": {"gap": 2}, "rule": {"rule": True}}[mode]
    return rows(docs, len(widths) if mode == "widths" else columns, key=key, text=text, **how)


def name_of(header: Column) -> Column:
    """Runs of digits, blanks and punctuation become underscores, none at the ends; lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(header, rf"(?:[0-9 ]|{PUNCT})+", "_"), r"\A_+|_+\z", ""))


def column_names(docs: DataFrame, columns: int, divider: str = "", widths: list[int | None] | None = None, rule: bool = False, gap: int = 2, explicit: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, names: the names of the columns of each document's table, from the data.

    The cells of all header lines of a column are joined, and made a name; a blank one is called after its
    number, and one that an earlier column has gets its number. Header lines are those to the reference
    row, that of symbols left out. Names that are given take the place of the header's. No shuffle.
    """
    d = _body(docs, columns, divider, widths, rule, gap, None, key, lines_of(F.col(text)))
    if explicit:
        return d.select(key, F.array(*map(F.lit, explicit)).alias("names"))
    d = d.select(key, "starts", F.filter(F.slice("lines", F.lit(1), F.col("ref") + 1), lambda x: ~is_symbols(x) & x.rlike("[^ ]")).alias("heads"))
    d = d.withColumn("cells", F.transform("heads", lambda x: cells_of(x, F.col("starts"), divider)))
    joined = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda j: name_of(F.array_join(F.filter(F.transform("cells", lambda c: F.get(c, j)), lambda c: c != ""), "_")))
    d = d.select(key, F.transform(joined, lambda x, j: F.when(x == "", F.concat(F.lit("col"), j.cast("string"))).otherwise(x)).alias("names"))
    return d.select(key, F.transform("names", lambda x, j: F.when(F.array_contains(F.slice("names", F.lit(1), j), x), F.concat(x, j.cast("string"))).otherwise(x)).alias("names"))


def named(found: DataFrame, names: list[str]) -> DataFrame:
    """rows() with a column for each cell."""
    return found.select(*(c for c in found.columns if c not in ("line", "starts", "cells", "edges", "layout")), *(F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)))


def header_names(headers: list[str]) -> list[str]:
    """Column names: runs of digits, blanks and punctuation become underscores; lower case; blank ones
    and repeated ones are told apart by their number."""
    out: list[str] = []
    for i, h in enumerate(headers):
        name = re.sub(rf"(?:[0-9 ]|{PUNCT})+", "_", h).strip("_").lower() or f"col{i}"
        out.append(f"{name}{i}" if name in out else name)
    return out


def column_profile(found: DataFrame, keys: list[str] = ()) -> DataFrame:
    """For each column number: rows, empty cells, least and most width, most items, class, sub-pattern.

    Cells are counted before they are classified, so that each distinct one of a column is matched once.
    """
    cells = found.select(*keys, F.posexplode("cells").alias("n", "cell")).select(*keys, F.col("n").cast("long").alias("column_no"), "cell")
    counts = cells.groupBy(*keys, "column_no", "cell").agg(F.count("*").alias("_n"))
    full = F.col("cell") != ""
    p = counts.groupBy(*keys, "column_no").agg(
        F.sum("_n").alias("n"), F.sum(F.when(full, 0).otherwise(F.col("_n"))).cast("long").alias("n_empty"), F.min(F.length("cell")).cast("long").alias("least_width"), F.max(F.length("cell")).cast("long").alias("most_width"),
        F.max(F.when(full, F.size(F.split("cell", " +"))).otherwise(0)).cast("long").alias("most_items"), F.bit_and(F.when(full, mask(F.col("cell")))).alias("_mask"),
    )
    return p.withColumn("class", class_of(F.col("_mask"))).withColumn("actual", actual_of(F.col("_mask"))).drop("_mask")


def column_alignment(found: DataFrame, keys: list[str] = ()) -> DataFrame:
    """For each column number: alignment by its distinct edges, and the width that it is given.

    One left edge: left; else one right edge: right; else center. The width is that of all cells if they
    agree, or the most if the edge is on the right or most cells have it, else the mean, rounded up. Of widths
    that as many cells have, that of the first row counts, by document and row number.
    """
    place = F.struct(F.col(found.columns[0]).alias("k"), "row_no").alias("place")
    e = found.select(*keys, place, F.posexplode("edges").alias("n", "e"), "cells").select(*keys, "place", F.col("n").cast("long").alias("column_no"), "e", F.length(F.get("cells", F.col("n"))).alias("w")).where("e IS NOT NULL")
    # One pass over the cells; what follows has a row for each width of a column.
    widths = e.groupBy(*keys, "column_no", "w").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.min("e.left").alias("l0"), F.max("e.left").alias("l1"), F.min("e.right").alias("r0"), F.max("e.right").alias("r1"))
    common = widths.groupBy(*keys, "column_no").agg(
        F.min_by("w", F.struct((-F.col("n")).alias("n"), "first")).alias("mode"), F.max("w").alias("most"), F.count("*").alias("kinds"), F.ceil(F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("mean"),
        (F.min("l0") == F.max("l1")).alias("one_left"), (F.min("r0") == F.max("r1")).alias("one_right"),
    )
    width = F.when((F.col("kinds") == 1) | (~F.col("one_left") & F.col("one_right")) | (F.col("one_left") & (F.col("mode") == F.col("most"))), F.col("most")).otherwise(F.col("mean"))
    alignment = F.when(F.col("one_left"), "left").when(F.col("one_right"), "right").otherwise("center")
    return common.select(*keys, "column_no", alignment.alias("alignment"), width.cast("long").alias("width"))


def pick_headers(docs: DataFrame, picks: list[int | str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, headers: the lines of each document at the given places or with the given texts, in their order."""
    lines = F.transform(lines_of(F.col(text)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    wanted = lambda s: F.coalesce(*([F.lit(None)] + [F.when((s["i"] == p) if isinstance(p, int) else s["x"].contains(p), True) for p in picks]), F.lit(False))
    return docs.select(key, F.transform(F.filter(lines, wanted), lambda s: s["x"]).alias("headers"))


#: The token of each class of groups.
TOKEN_OF = {"words": "word", "mixed_words": "mixed_word", "puncts_group": "puncts", "non_whitespaces_group": "non_whitespaces"}
ONE_BLANK = ("words", "phrase", "mixed_words", "mixed_phrase", "puncts_or_phrase", "puncts_phrase", "non_whitespaces_or_phrase", "non_whitespaces_phrase")


def table_snippets(found: DataFrame, names: list[str], divider: str = "") -> DataFrame:
    """layout, rank, snippet: a line rule for each distinct layout of rows(), in descending order of layouts.

    A full cell is a slot of its column's class; a class of groups takes as many further tokens as the
    column has at most. A stretch of empty cells between slots, or between dividers, is as many blanks as
    it has in the rows of that layout; at the end it is any number. The rows themselves match their rules.
    """
    # Few rows, written once, as layouts, columns and stretches are all read from them.
    g = kept(_stretches(found, len(names), divider))
    columns = g.groupBy("column_no").agg(F.max("items").alias("most_items"), F.bit_and("mask").alias("_mask"))
    slots = columns.agg(F.array_sort(F.collect_list(F.struct("column_no", class_of(F.col("_mask")).alias("class"), actual_of(F.col("_mask")).alias("actual"), "most_items"))).alias("columns"))  # a row for each column
    stretches = g.groupBy("layout").agg(F.array_sort(F.collect_list(F.struct("column_no", "least", "most", "trailing"))).alias("stretches"))  # a row for each column
    ranked = _ranked(stretches).join(F.broadcast(slots))

    def assemble(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"layout": pdf["layout"], "rank": pdf["rank"], "snippet": [_rule(x, s, c, names, divider) for x, s, c in zip(pdf["layout"], pdf["stretches"], pdf["columns"])]})

    return ranked.mapInPandas(assemble, "layout string, rank long, snippet string")


def blanks_of(columns: int, divider: str) -> list[Column]:
    """Of each column of rows() the blanks before its cell, or between its dividers where that is empty; written out, as cells are."""
    edge = lambda i: F.get("edges", F.lit(i))
    left = lambda i: edge(i)["left"] - F.coalesce(*(edge(j)["right"] for j in reversed(range(i))), F.lit(0))
    return [F.when(F.substring("layout", i + 1, 1) == "1", left(i)).otherwise(F.get("starts", F.lit(i + 1)) - F.get("starts", F.lit(i)) - len(divider)) for i in range(columns)]


def _stretches(found: DataFrame, columns: int, divider: str) -> DataFrame:
    """layout, column_no, least, most, trailing, items, mask: a row for each layout of rows() and column."""
    both = F.array(*(F.struct(b.alias("blanks"), F.get("cells", F.lit(i)).alias("cells")) for i, b in enumerate(blanks_of(columns, divider))))
    cells = found.select("layout", F.col("line").rlike(r"[ \t]\z").alias("trailing"), F.posexplode(both).alias("column_no", "x"))
    # Each different value of a column is matched once a task and layout, so that what repeats costs little.
    value = cells.groupBy("layout", "column_no", F.col("x.cells").alias("cell")).agg(F.min("x.blanks").alias("least"), F.max("x.blanks").alias("most"), F.bool_or("trailing").alias("trailing"))
    is_full = F.col("cell") != ""
    return value.groupBy("layout", "column_no").agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.bool_or("trailing").alias("trailing"),
        F.max(F.when(is_full, F.size(F.split("cell", " +"))).otherwise(0)).alias("items"), F.bit_and(F.when(is_full, mask(F.col("cell")))).alias("mask"),
    )


def table_rules(found: DataFrame, names: list[str], divider: str = "") -> list[str]:
    """The snippets of table_snippets() in their order, by one aggregation over the cells of rows().

    The driver gets a row for each layout and column, 2 ** columns times columns at most.
    """
    g = _stretches(found, len(names), divider)
    rules: dict[str, list] = {}
    columns = [{"mask": -1, "most_items": 0} for _ in names]
    for r in sorted(g.collect(), key=lambda r: r["column_no"]):
        rules.setdefault(r["layout"], []).append(r.asDict())
        own = columns[r["column_no"]]
        own["mask"] &= -1 if r["mask"] is None else r["mask"]
        own["most_items"] = max(own["most_items"], r["items"])
    for own in columns:
        own["class"], own["actual"] = names_of(own["mask"]) if own["mask"] != -1 else (None, None)
    return [_rule(layout, rules[layout], columns, names, divider) for layout in sorted(rules, reverse=True)]


def _slot(column: dict, name: str) -> str:
    more = int(column["most_items"]) - 1
    if column["class"] in TOKEN_OF and more > 0:
        return f"{TOKEN_OF[column['class']]}(var_{name}, at_most_{more}_{'phrase' if column['actual'] in ONE_BLANK else 'group'}_occurrences)"
    return f"{column['actual']}(var_{name})"


def _rule(layout: str, stretches: list, columns: list, names: list[str], divider: str) -> str:
    """The rule of one layout. Next to a space() one blank on either side is text, and counts."""
    last = max((i for i, x in enumerate(layout) if x == "1"), default=-1)
    trailing = any(bool(s["trailing"]) for s in stretches) or (last < len(layout) - 1)
    out, indent = "", False
    for i, x in enumerate(layout[: last + 1] if not divider else layout):
        least, most = int(stretches[i]["least"] or 0), int(stretches[i]["most"] or 0)
        if divider and i:
            # A blank or more on either side of a divider, and just as many as an empty cell has.
            out += ("  " if layout[i - 1] == "1" else " " if out else "") + divider + ("  " if x == "1" else "")
        if x == "1":
            if not divider and i and layout[i - 1] == "0":
                before = 1 if "1" not in layout[:i] else 2
                out += f" space(repetition_{max(0, least - before)}_{max(0, most - before)}) "
            elif not divider and i:
                out += "  "
            elif not out:
                indent = indent or most > 0
            out += _slot(columns[i], names[i])
        elif divider and i == 0:
            indent = True
        elif divider and i < len(layout) - 1:
            out += f" space(repetition_{max(0, least - 2)}_{max(0, most - 2)})"
    return f"start({'space' if indent else ''}) {out.strip()} end({'space' if trailing else ''}) -> Record"


def block_snippet(docs: DataFrame, names: list[str], starting_from: int | str | None = None, ending_to: int | str | None = None, divider: str = "", key: str = "doc_id", text: str = "text", most: int = MOST_RULES, **how) -> str:
    """The snippet of a table between markers, from all documents: a rule to enter at each form of the start
    marker, one for each form of a header line, the rules of all layouts, and one to stop at each form of
    the end marker.

    What reaches the driver is a line for each layout, 2 ** columns at most, and of the forms of headers and of
    markers those that most documents have, `most` of each.
    """
    pieces = cut(docs, starting_from, ending_to, True, key, text)
    found = rows(pieces, len(names), divider=divider, key=key, text=F.col("lines"), **how)
    body = table_rules(found, names, divider)
    starts, ends = marker_signatures(pieces, most)
    b = _body(pieces, len(names), divider, how.get("widths"), how.get("rule", False), how.get("gap", 2), how.get("reference"), key, F.col("lines"))
    heads = b.select(F.posexplode(F.slice("lines", F.lit(1), F.col("ref") + 1)).alias("i", "x")).where(~is_symbols(F.col("x")) & F.col("x").rlike("[^ ]"))
    forms = heads.groupBy(F.rtrim(signature(F.col("x"))).alias("head")).agg(F.min("i").alias("i"), F.count("*").alias("n"))
    # A header that is itself a marker has its rule before.
    return framed([*(r["head"] for r in sorted(frequent(forms, "head", most).collect(), key=lambda r: (r["i"], r["head"])) if r["head"] not in {x.rstrip() for x in starts}), *body], starts, ends)


def layouts(found: DataFrame) -> DataFrame:
    """layout, n, rank in descending order of layouts: one template rule each."""
    # As many rows as there are layouts, 2 ** columns at most.
    return _ranked(found.groupBy("layout").agg(F.count("*").alias("n")))


def _ranked(by_layout: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return by_layout.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("layout"))).cast("long"))


def divider_edges(lines: DataFrame, divider: str, line: str = "line") -> DataFrame:
    """Whether more than half of the lines start, and end, with the divider."""
    x = F.trim(F.col(line))
    return lines.agg((F.avg(x.startswith(divider).cast("double")) > 0.5).alias("starts"), (F.avg(x.endswith(divider).cast("double")) > 0.5).alias("ends"))


def continued(lines: DataFrame, keys: list[str], is_start: Column, order: str = "line_no", line: str = "line") -> DataFrame:
    """keys, group_no, first, tails: lines that continue one another as an array after the line that starts."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    grouped = lines.withColumn("group_no", F.sum(is_start.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("group_no > 0")
    all_ = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(F.col(line)).alias("x"))))
    return grouped.groupBy(*keys, "group_no").agg(all_.alias("a")).select(*keys, "group_no", F.col("a")[0]["x"].alias("first"), F.transform(F.slice("a", F.lit(2), F.size("a")), lambda s: s["x"]).alias("tails"))


# Fixed value: the form of the markers.
_USER_MARKER = re.compile(r"(?i) *< *user[ ._+-]marker[ ._+-](one|multi)[ ._+-]?line *>")


def prepared(lines: Iterable[str]) -> Iterator[tuple[str, str | None, list[str]]]:
    """(line, first cell, further lines of the last cell) with the markers that users put before lines.

    A marked one line is the first cell of the line after it. A marked multi line starts a row, and lines
    behind it whose indent is more than 0.8 times the first of them go on with its last cell; they keep
    their indent.
    """
    indent, head, now = None, None, None
    tail = False
    for x in lines:
        if tail:
            own = len(x) - len(x.lstrip())
            if x.strip() and (indent is None or own > 0.8 * indent):
                indent = own if indent is None else indent
                now[2].append(x.rstrip())
                continue
            tail, indent = False, None
        m = _USER_MARKER.match(x)
        rest = x[m.end() :] if m else x
        if m and m[1].lower() == "one":
            head = rest.strip()
            continue
        if now:
            yield now
        now = (rest, head, [])
        head, tail = None, bool(m)
    if now:
        yield now


def starts_in(row: str, divider: str = "", widths: list[int | None] | None = None, rule: bool = False, gap: int = 2) -> list[int]:
    """starts_by_widths(), starts_by_rule(), starts_by_divider() or starts_by_gaps() of a line in hand."""
    if widths:
        lengths = [w or 0 for w in widths]
    elif divider and not rule:
        lengths = [len(p) + len(divider) for p in row.split(divider)]
    else:
        lengths = [len(p) for p in re.findall(PUNCT + "+ *" if rule else rf"(?:[^ ]| {{1,{gap - 1}}}(?=[^ ]))+ *" if gap > 1 else "[^ ]+ *", row)]
    return [0, *accumulate(lengths[:-1])]


def marked_found(docs: DataFrame, columns: int, divider: str = "", widths: list[int | None] | None = None, rule: bool = False, gap: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of rows() for tables with marked lines, and head (first cell on a line of its own, or '') and
    tails (further lines of the last cell, with their indent). Texts reach Python in pieces, and leave it as rows."""
    symbols = re.compile(rf" *{PUNCT}+(?: +{PUNCT}+)*+ *")

    def read(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.string())]
        texts, out = Texts(batches), []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [texts.kind, *kinds])], [key, "row_no", "line", "starts", "head", "tails"])

        for k, lines in texts:
            starts, n = None, 0
            for x, head, tails in prepared(lines):
                is_rule = symbols.fullmatch(x) is not None
                if starts is None:
                    own = starts_in(x, divider, widths, rule, gap) if is_rule == rule else []
                    starts = own if len(own) == columns else None
                elif not is_rule and x.strip(" "):
                    out.append((k, n, x, starts, head or "", tails))
                    n += 1
                    if len(out) >= AT_ONCE:
                        yield batch()
                        out = []
        if out:
            yield batch()

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("row_no", T.LongType()), T.StructField("line", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("head", T.StringType()), T.StructField("tails", T.ArrayType(T.StringType()))])
    d = pieces_of(docs, key, text).mapInArrow(read, schema)
    line, starts = F.col("line"), F.col("starts")
    d = d.select(key, "row_no", "line", "starts", cells_of(line, starts, divider, columns).alias("cells"), edges_of(line, starts, columns).alias("edges"), "head", "tails")
    return d.select(key, "row_no", "line", "starts", "cells", "edges", layout_of(F.col("cells"), columns).alias("layout"), "head", "tails")


def marked_rows(docs: DataFrame, columns: int, divider: str = "", widths: list[int | None] | None = None, rule: bool = False, gap: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row_no, cells, tails: rows() of tables whose lines users have marked as parts of one row.

    tails has the further lines of the last cell. Works inside each row of docs: no shuffle.
    """
    d = marked_found(docs, columns, divider, widths, rule, gap, key, text)
    cells = F.when(F.col("head") != "", F.transform("cells", lambda c, i: F.when(i == 0, F.col("head")).otherwise(c))).otherwise(F.col("cells"))
    return d.select(key, "row_no", cells.alias("cells"), F.transform("tails", lambda x: F.regexp_replace(x, r"\A\s+", "")).alias("tails"))


def unmarked(text: Column) -> Column:
    """The text without its users' markers."""
    return F.regexp_replace(text, r"(?im)^ *< *user[ ._+-]marker[ ._+-](?:one|multi)[ ._+-]?line *>", "")


def marked_snippet(docs: DataFrame, names: list[str], divider: str = "", key: str = "doc_id", text: str = "text", **how) -> str:
    """The snippet of tables with rows of several lines, from texts in which users have marked them; it reads
    texts without markers. Its last column is a list where a row goes on in further lines.

    A first cell on a line of its own leads to a state that reads the rest of the row. With further lines,
    a row's beginning is recognised without capturing, which ends the record before it, and then captured.
    ValueError where a row of nothing but a first cell, or but a last cell that stands where further lines do,
    cannot be told from these. The driver gets a row for each layout.
    """
    found = marked_found(docs, len(names), divider, key=key, text=text, **how)
    last = len(names) - 1
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    cells = F.when(F.col("head") != "", F.transform("cells", lambda c, i: F.when(i == 0, F.col("head")).otherwise(c))).otherwise(F.col("cells"))
    # Further lines are rows of nothing but a last cell, where the profile of columns is concerned.
    tails = F.transform("tails", lambda x: F.transform("cells", lambda c, i: F.when(i == last, F.ltrim(x)).otherwise("")))
    profile = column_profile(found.select(F.explode(F.concat(F.array(cells), tails)).alias("cells"))).orderBy("column_no").collect()
    columns = [r.asDict() for r in profile]
    for c in columns:
        if c["actual"] is None:
            raise ValueError(f"column {names[c['column_no']]} is always empty")
    blanks = F.array(*blanks_of(len(names), divider))
    headed = (F.col("head") != "").alias("headed")
    each = found.select(headed, "layout", F.posexplode(blanks).alias("column_no", "blanks"), F.col("line").rlike(r"[ \t]\z").alias("trailing"))
    g = each.groupBy("headed", "layout", "column_no").agg(F.min("blanks").alias("least"), F.max("blanks").alias("most"), F.bool_or("trailing").alias("trailing"))
    g = g.groupBy("headed", "layout").agg(F.array_sort(F.collect_list(F.struct("column_no", "least", "most", "trailing"))).alias("stretches")).orderBy(F.desc("layout"))
    rules = [(r["headed"], r["layout"], [s.asDict() for s in r["stretches"]]) for r in g.collect()]  # 2 ** columns for each, at most
    edge = found.select(F.explode("tails").alias("x")).agg(F.min(indent(F.col("x"))).alias("least"), F.max(indent(F.col("x"))).alias("most")).first()
    heads, listed = [x for h, x, _ in rules if h], edge["most"] is not None
    if heads and any(x.rstrip("0") == "1" for h, x, _ in rules if not h):
        raise ValueError("a row of nothing but a first cell looks like a first cell on a line of its own")
    lonely = [s for h, x, s in rules if listed and not h and x == "0" * last + "1"]
    if any(s[last]["least"] <= edge["most"] and s[last]["most"] >= edge["least"] for s in lonely):
        raise ValueError("a row of nothing but a last cell stands where further lines do")

    own = f"(var_{names[last]}"
    as_list = lambda x: re.sub(re.escape(own) + r"((?:, \w+)*)\)", lambda m: f"{own}{m[1]}, meta_data_list)", x) if listed else x
    bare = lambda x: re.sub(r"\(var_\w+(?:, )?", "(", x)
    row = lambda x, s: _rule(x, s, columns, names, divider).removesuffix(" -> Record")
    body, rest = [], []
    for is_headed, x, s in rules:
        r = row(x, s)
        if is_headed:
            rest.append(f"{as_list(r)} -> {'Next' if listed else 'Record'} Start")
        else:
            body += [f"{bare(r)} -> Continue.Record", f"{as_list(r)} -> Next"] if listed else [f"{r} -> Record"]
    if heads:
        line = f"start() {_slot(columns[0], names[0])} end(space)"
        lead = ([f"{bare(line)} -> Continue.Record"] if listed else []) + [f"{line} -> Rest"]
        # Words one blank apart are no row where cells are further apart.
        body = [*lead, *body] if columns[0]["actual"] in ONE_BLANK or columns[0]["class"] not in TOKEN_OF else [*body, *lead]
    if listed:
        body.append(as_list(f"start() space(repetition_{max(0, edge['least'] - 1)}_{max(0, edge['most'] - 1)}) {_slot(columns[last], names[last])} end(space)"))
    return "\n".join([*body, *(["", "Rest", *rest] if heads else [])])
