"""Line templates with typed slots from lines that differ."""

from __future__ import annotations

import difflib
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as c
from .tokens import tokens_of


def without_space(line: Column) -> Column:
    return F.regexp_replace(line, r"[ \t\n\x0b\f\r]+", "")


def spacing_variants(lines: DataFrame, line: str = "line") -> DataFrame:
    """content, n, variants, leading and trailing (always, sometimes, never), tabs of lines equal but for
    their white space. Only what is merged before the shuffle is held."""
    x = F.col(line)
    g = lines.where(x.rlike(r"[^ \t\n\x0b\f\r]")).groupBy(without_space(x).alias("content"))
    kind = lambda p: F.when(F.bool_and(x.rlike(p)), "always").when(F.bool_or(x.rlike(p)), "sometimes").otherwise("never")
    return g.agg(F.count("*").alias("n"), F.count_distinct(x).alias("variants"), kind(r"\A[ \t]").alias("leading"), kind(r"[ \t]\z").alias("trailing"), F.bool_or(x.rlike(r"[\t\x0b\f]")).alias("tabs"))


def slots(lines: DataFrame, line: str = "line") -> DataFrame:
    """cluster, n_tokens, pos, n, literal, class, actual: each token place of lines that start alike.

    Lines cluster by their first token and number of tokens. A place whose tokens are all equal is
    literal; another has the class of all its values, from masks that combine before the shuffle.
    """
    t = lines.select(tokens_of(F.col(line)).alias("t")).where(F.size("t") > 0).select(F.col("t")[0].alias("cluster"), F.size("t").cast("long").alias("n_tokens"), F.posexplode("t").alias("pos", "token"))
    counts = t.groupBy("cluster", "n_tokens", F.col("pos").cast("long").alias("pos"), "token").agg(F.count("*").alias("n"))
    g = counts.groupBy("cluster", "n_tokens", "pos").agg(F.sum("n").alias("n"), F.count("*").alias("n_values"), F.min("token").alias("least"), F.bit_and(c.mask(F.col("token"))).alias("m"))
    return g.select("cluster", "n_tokens", "pos", "n", F.when(F.col("n_values") == 1, F.col("least")).alias("literal"), F.when(F.col("n_values") > 1, c.class_of(F.col("m"))).alias("class"), F.when(F.col("n_values") > 1, c.actual_of(F.col("m"))).alias("actual"))


def templates(lines: DataFrame, line: str = "line") -> DataFrame:
    """cluster, n_tokens, n, template: literals and `class(var_vK)` slots in their order."""
    s = slots(lines, line).withColumn("part", F.coalesce("literal", F.concat("actual", F.lit("(var_v"), F.col("pos").cast("string"), F.lit(")"))))
    # One row a token place: a template holds as many parts as its lines have tokens.
    return s.groupBy("cluster", "n_tokens").agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), " ").alias("template"))


# Lines of different numbers of tokens: diffs of pairs in a bounded sample, tested on every line.


def class_of_values(values: list[str], level: str = "actual") -> str | None:
    """The sub-pattern of a set of values, as the masks give it."""
    several = all(len(v.split()) > 1 for v in values)
    for k, (_, sub, _, plain) in enumerate(c.SUBS):
        if several and c.SINGLE_OR_MORE >> k & 1:
            continue
        if all(re.fullmatch(plain, v) for v in values):
            return sub if level == "actual" else c.lessen_name(sub) if level == "lessen" else c.root_name(sub)
    return None


def segments(a: str, b: str) -> list[tuple[str, str, str]]:
    """(common or changed, run of a, run of b) of the tokens of two lines."""
    x, y = a.split(), b.split()
    out: list[list] = []
    for mark, token in ((d[0], d[2:]) for d in difflib.ndiff(x, y) if d[0] != "?"):
        kind = "common" if mark == " " else "changed"
        if not out or out[-1][0] != kind:
            out.append([kind, [], []])
        if mark in " -":
            out[-1][1].append(token)
        if mark in " +":
            out[-1][2].append(token)
    return [(k, " ".join(p), " ".join(q)) for k, p, q in out]


def pair_parts(a: str, b: str, level: str = "actual") -> list[tuple[str, bool | None]] | None:
    """(literal, None) or (sub-pattern, whether one of the lines lacks it) in the order of two lines.

    Runs of several tokens count as ones with wide gaps; what their gaps are in all lines is seen later.
    """
    parts: list[tuple[str, bool | None]] = []
    for kind, p, q in segments(a, b):
        if kind == "common":
            parts += [(token, None) for token in p.split()]
            continue
        both = [v.replace(" ", "  ") for v in (p, q) if v]
        name = class_of_values(both, level)
        if name is None or name not in c.PATTERN:
            return None
        parts.append((name, len(both) == 1))
    return parts


#: What may stand between two tokens, as seen in all lines: one blank, blanks, any white space.
ONE, BLANKS, ANY = 0, 1, 2
_GAP = {ONE: (" ", " "), BLANKS: (" +", "  "), ANY: (r"\s+", "\t ")}


def assembled(parts: list[tuple[str, bool | None]], gaps: list[int] | None = None, noted: bool = False) -> tuple[str, str]:
    """(pattern, snippet) of parts, with the kind of each gap, blanks if none are given; an optional slot
    goes with its gap. noted: a pattern that takes any white space, with each gap as a group."""
    pattern, snippet, n, k = "", "", 0, 0
    open_ = False  # whether something stands before, so that a gap is due
    for i, (text, optional) in enumerate(parts):
        gap = ("", "") if not open_ else _GAP[BLANKS if gaps is None else gaps[k]]
        shown = gap[1] if open_ else ""
        between = (rf"(?P<g{k}>\s+)" if noted else gap[0]) if open_ else ""
        k += open_
        if optional is None:
            pattern, snippet, open_ = pattern + between + re.escape(text), snippet + shown + text, True
            continue
        slot = f"(?P<v{n}>{c.PATTERN[text]})"
        snippet += f"{shown}{text}(var_v{n}{', or_empty' if optional else ''})"
        n += 1
        if not optional:
            pattern, open_ = pattern + between + slot, True
        elif open_:
            pattern += f"(?:{between}{slot})?"
        else:  # in front: the gap behind it is its own
            own = _GAP[BLANKS if gaps is None else gaps[k]]
            pattern += f"(?:{slot}" + (rf"(?P<g{k}>\s+)" if noted else own[0]) + ")?"
            snippet += own[1]
            k += 1
    return pattern, snippet.rstrip()


def pair_pattern(a: str, b: str, level: str = "actual") -> tuple[str, str] | None:
    """(pattern, snippet) for two lines, with their white space around."""
    parts = pair_parts(a.strip(), b.strip(), level)
    if parts is None:
        return None
    pattern, snippet = assembled(parts)
    both = (a, b)
    ends = [envelope(all(f(x) for x in both), any(f(x) for x in both), any(re.search(r"[\t\n\x0b\f\r]", x) for x in both)) for f in (lambda x: x[:1].isspace(), lambda x: x[-1:].isspace())]
    return ends[0][0] + pattern + ends[1][0], snippet


def envelope(always: bool, sometimes: bool, tabs: bool) -> tuple[str, str]:
    """Pattern and snippet option of the white space at an end of the lines."""
    if not sometimes:
        return "", ""
    return (r"\s" if tabs else " ") + ("+" if always else "*"), ("whitespace" if tabs else "space") + ("s" if always else "")


def candidates(lines: list[str]) -> dict[str, list[tuple[str, bool | None]]]:
    """Patterns of two lines, with their parts, that match all of them, in the order of combinations; by
    exact classes first, then by widened ones, then by their white-space ancestors."""
    lines = list(dict.fromkeys(x.strip() for x in lines if x.strip()))
    out: dict[str, list[tuple[str, bool | None]]] = {}
    for level in ("actual", "lessen", "root"):
        for a, b in combinations(lines, 2):
            parts = pair_parts(a, b, level)
            if parts is not None and (pattern := assembled(parts, noted=True)[0]) not in out and all(re.fullmatch(pattern, x) for x in lines):
                out[pattern] = parts
    return out


def gap_kind(gap: str) -> int:
    return ONE if gap == " " else BLANKS if not gap.strip(" ") else ANY


def general_pattern(lines: list[str]) -> tuple[str, str] | None:
    """(pattern, snippet) of some lines in hand: the first candidate, with the classes of all values of its
    slots, the kinds of all its gaps and the white space around the lines."""
    own = [x.strip() for x in lines if x.strip()]
    for pattern, parts in candidates(own).items():
        masks, gaps = [-1] * sum(o is not None for _, o in parts), [ONE] * pattern.count("(?P<g")
        for x in own:
            m = re.fullmatch(pattern, x).groupdict()
            masks = [k & value_mask(m[f"v{i}"]) if m[f"v{i}"] else k for i, k in enumerate(masks)]
            gaps = [max(g, gap_kind(m[f"g{i}"])) if m[f"g{i}"] else g for i, g in enumerate(gaps)]
        raw = [x for x in lines if x.strip()]
        tabs = any(re.search(r"[\t\n\x0b\f\r]", x) for x in raw)
        ends = [(all(f(x) for x in raw), any(f(x) for x in raw), tabs) for f in (lambda x: x[:1].isspace(), lambda x: x[-1:].isspace())]
        return finished(refined(parts, masks), gaps, *ends)
    return None


def finished(parts: list[tuple[str, bool | None]], gaps: list[int], leading: tuple, trailing: tuple) -> tuple[str, str]:
    """(pattern, snippet) with what stands around the lines."""
    pattern, snippet = assembled(parts, gaps)
    (before, start), (after, end) = envelope(*leading), envelope(*trailing)
    return before + pattern + after, f"start({start}) {snippet} end({end})"


def value_mask(value: str) -> int:
    """The mask of one value, outside Spark."""
    m = 1 << c.PLURAL_BIT if len(value.split()) > 1 else 0
    return m | sum(1 << k for k, (_, _, _, plain) in enumerate(c.SUBS) if re.fullmatch(plain, value))


def refined(parts: list[tuple[str, bool | None]], masks: list[int]) -> list[tuple[str, bool | None]]:
    """parts with the classes that the masks of all values of their slots give."""
    left, out = iter(masks), []
    for text, optional in parts:
        if optional is not None:
            m = next(left)
            if m >> c.PLURAL_BIT & 1:
                m &= ~c.SINGLE_OR_MORE
            text = next((sub for k, (_, sub, _, _) in enumerate(c.SUBS) if m >> k & 1), text)
        out.append((text, optional))
    return out


def _samples(lines: DataFrame, cluster: str, line: str, sample: int) -> DataFrame:
    """cluster, line: the shortest and longest line of each number of tokens, `sample` of them spread
    evenly over the lengths where there are more."""
    x = F.struct(F.length(line).alias("length"), F.col(line).alias("line"))
    ends = lines.groupBy(cluster, F.size(tokens_of(F.col(line))).alias("n_tokens")).agg(F.min(x).alias("least"), F.max(x).alias("most"))
    ends = ends.select(cluster, F.explode(F.array("least", "most")).alias("x")).distinct()
    w = Window.partitionBy(cluster)
    k, n = F.row_number().over(w.orderBy("x")) - 1, F.count("*").over(w)
    # Of n lines those stay at which k * (sample - 1) / (n - 1) reaches a further whole number.
    spread = lambda k: F.floor(k * (sample - 1) / F.greatest(n - 1, F.lit(1)))
    return ends.withColumn("keep", (n <= sample) | (k == 0) | (spread(k) > spread(k - 1))).where("keep").select(cluster, F.col("x.line").alias("line"))


#: What stands in the place of a pattern where there is none.
TOO_FEW, NO_PATTERN = "fewer than two different lines", "no pattern of two lines matches all lines"


def matching_patterns(lines: DataFrame, cluster: str, line: str = "line", sample: int = 12, rounds: int = 8) -> DataFrame:
    """cluster, pattern, snippet, error: the first candidate that matches all lines of the cluster.

    Candidates come from pairs of a bounded sample and are tested on every line. Where all of them fail,
    for each the least line that it fails on joins the sample for the next round. The classes of the
    slots, the gaps between tokens and the white space around the lines are those of all lines; blank
    lines do not count. Where fewer than two lines differ, or no candidate of any round matches all
    lines, pattern and snippet are null and error says so. What passes through the driver is bounded by
    the sample and its candidates for each cluster.
    """
    raw = F.col(line)
    x = F.regexp_replace(raw, r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\z", "")
    own = lines.select(F.col(cluster).alias("cluster"), raw.alias("raw"), x.alias("line")).where("line <> ''")
    lead, trail = F.col("raw").rlike(r"\A[ \t\n\x0b\f\r]"), F.col("raw").rlike(r"[ \t\n\x0b\f\r]\z")
    around = {
        r["cluster"]: r
        for r in own.groupBy("cluster").agg(
            F.bool_and(lead).alias("all_lead"), F.bool_or(lead).alias("lead"), F.bool_and(trail).alias("all_trail"), F.bool_or(trail).alias("trail"), F.bool_or(F.col("raw").rlike(r"[\t\n\x0b\f\r]")).alias("tabs"),
            (F.min("line") < F.max("line")).alias("several"),
        ).collect()
    }
    open_: dict = {}
    for r in _samples(own, "cluster", "line", sample).collect():
        if around[r["cluster"]]["several"]:
            open_.setdefault(r["cluster"], []).append(r["line"])
    found: dict = {k: (None, None, NO_PATTERN if r["several"] else TOO_FEW) for k, r in around.items()}
    for _ in range(rounds):
        tried = {k: got for k, some in open_.items() if (got := candidates(sorted(set(some), key=lambda s: (len(s), s))))}
        if not tried:
            break
        fails: dict = {k: set() for k in tried}
        seen: dict = {}
        for r in _tested(own, {k: list(got) for k, got in tried.items()}).collect():
            if r["fail"] is not None:
                fails[r["cluster"]].add((r["k"], r["fail"]["line"]))
            else:
                seen.setdefault((r["cluster"], r["k"]), {})[r["part"], r["i"]] = r["masks"] if r["part"] == "slot" else r["kind"]
        nxt = {}
        for key, got in tried.items():
            dead = {k for k, _ in fails[key]}
            first = next((k for k in range(len(got)) if k not in dead), None)
            if first is None:
                more = sorted({x for _, x in fails[key]}, key=lambda s: (len(s), s))
                nxt[key] = open_[key] + more[:sample]
                continue
            pattern, parts = list(got.items())[first]
            own_seen, r = seen.get((key, first), {}), around[key]
            masks = [own_seen.get(("slot", i), 0) for i in range(sum(o is not None for _, o in parts))]
            gaps = [own_seen.get(("gap", i), ONE) for i in range(pattern.count("(?P<g"))]
            found[key] = (*finished(refined(parts, masks), gaps, (r["all_lead"], r["lead"], r["tabs"]), (r["all_trail"], r["trail"], r["tabs"])), None)
        open_ = nxt
    kind = lines.select(F.col(cluster).alias(cluster)).schema[0].dataType.simpleString()
    return lines.sparkSession.createDataFrame([(k, *p) for k, p in found.items()], f"`{cluster}` {kind}, pattern string, snippet string, error string")


def _tested(lines: DataFrame, patterns: dict) -> DataFrame:
    """cluster, k, part, i, masks, kind, fail: for pattern k of a cluster the least line that it fails on; or
    of its slot i the masks of all values, of its gap i the widest kind.

    Each task hands on a bounded number of rows; a pattern that failed in a task is not tried there on
    longer lines.
    """
    shared = lines.sparkSession.sparkContext.broadcast(patterns)

    def test(batches):
        import pandas as pd

        compiled = {key: [re.compile(p) for p in ps] for key, ps in shared.value.items()}
        fails: dict = {}
        slots: dict = {}
        gaps: dict = {}
        memo: dict = {}
        for pdf in batches:
            for key, x in zip(pdf["cluster"], pdf["line"]):
                for k, p in enumerate(compiled.get(key, ())):
                    at, size = (key, k), (len(x), x)
                    if at in fails and fails[at] <= size:
                        continue
                    m = p.fullmatch(x)
                    if m is None:
                        fails[at] = size
                    elif at not in fails:
                        for name, v in m.groupdict().items():
                            if not v:
                                continue
                            if name[0] == "g":
                                gaps[*at, int(name[1:])] = max(gaps.get((*at, int(name[1:])), ONE), gap_kind(v))
                                continue
                            if v not in memo:
                                if len(memo) > 100_000:
                                    memo.clear()
                                memo[v] = value_mask(v)
                            slots[*at, int(name[1:])] = slots.get((*at, int(name[1:])), -1) & memo[v]
        rows = [(key, k, "fail", -1, None, None, n, x) for (key, k), (n, x) in fails.items()]
        rows += [(key, k, "slot", i, m, None, None, None) for (key, k, i), m in slots.items() if (key, k) not in fails]
        rows += [(key, k, "gap", i, None, g, None, None) for (key, k, i), g in gaps.items() if (key, k) not in fails]
        out = pd.DataFrame(rows, columns=["cluster", "k", "part", "i", "masks", "kind", "length", "line"])
        yield out.astype({"masks": "Int64", "kind": "Int32", "length": "Int32"})

    kind = lines.schema["cluster"].dataType.simpleString()
    t = lines.select("cluster", "line").mapInPandas(test, f"cluster {kind}, k int, part string, i int, masks long, kind int, length int, line string")
    return t.groupBy("cluster", "k", "part", "i").agg(F.bit_and("masks").alias("masks"), F.max("kind").alias("kind"), F.min(F.when(F.col("line").isNotNull(), F.struct("length", "line"))).alias("fail"))
