"""Edit scripts of lines as data: a table of scripts is compiled and applied to the lines that each fits.

A script is `capture(...) keep(...) action(...): ` and a sample line, or the line in its readable form
`class(var=v0, value=text) ...`. Actions split tokens at characters (`0-split`, `1-split-=<>`) or join
them (`2:4-join`, `1,3-join`); tokens that a split makes get the numbers after the largest so far.
Once no action is left, the captured tokens become columns, kept ones match their class, and all
others are literal. Items are numbers, ranges or names; `or_empty` behind the last lets them be missing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes as c
from ..sources.documents import LINE_END
from . import templates
from .tokens import tokens_of

#: Scripts, at most so many, that are broadcast; beyond, lines meet them by a shuffle on their words.
FEW_SCRIPTS = 20_000
# The form of scripts and their elements, the mark of what may be missing, how parentheses are spelled
# out in values, and the characters of labels that names cannot have.
_SCRIPT = re.compile(r"capture\(([^)]*)\) keep\(([^)]*)\) action\(([^)]*)\): ?(.*)", re.S)
_ELEMENT = re.compile(r"([a-z]+(?:_[a-z]+)*)\(([cCkK]?var)=([^,()]+), value=([^)]+)\)")
_OR_EMPTY = re.compile(r"[_-]?or(?:[_-]empty)?", re.I)
SPACE = r"[ \t\n\x0b\f\r]"
_PLURAL = re.compile(rf"{c.NON_SPACE}{SPACE}+{c.NON_SPACE}")
_LEFT, _RIGHT = "_SYMBOL_LEFT_PARENTHESIS_", "_SYMBOL_RIGHT_PARENTHESIS_"
_NO_NAME = r"[\x20-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+"


class EditError(ValueError):
    pass


def classify(value: str) -> str:
    """The name of the first sub-pattern, in rank order, that a value matches."""
    plural = bool(_PLURAL.search(value.strip()))
    for k, (_, sub, _, plain) in enumerate(c.SUBS):
        if not (plural and c.SINGLE_OR_MORE >> k & 1) and re.fullmatch(plain, value):
            return sub
    raise EditError(f"no class for '{value}'")


@dataclass
class Token:
    kind: str
    id: str
    value: str
    gap: str = ""
    mode: str = ""  # c: captured, k: kept
    or_empty: bool = False

    @property
    def number(self) -> int:
        m = re.search(r"([0-9]+)(?:_([0-9]+))?\Z", self.id)
        return 0 if not m else int(m[1]) if m[2] is None else 10 * int(m[1]) + int(m[2])

    def text(self) -> str:
        mode = f"{self.mode}var"
        value = self.value.replace("(", _LEFT).replace(")", _RIGHT)
        return f"{self.kind}({mode.capitalize() if self.or_empty else mode}={self.id}, value={value}){self.gap}"


@dataclass
class Script:
    capture: str = ""
    keep: str = ""
    action: str = ""
    tokens: list[Token] = field(default_factory=list)
    leading: str = ""
    trailing: str = ""

    def text(self) -> str:
        return f"capture({self.capture}) keep({self.keep}) action({self.action}): {self.leading}{''.join(t.text() for t in self.tokens)}{self.trailing}"

    def at(self, name: str) -> int:
        found = [k for k, t in enumerate(self.tokens) if t.id == name]
        if not found:
            raise EditError(f"no token {name}")
        return found[0]

    def done(self) -> bool:
        return not (self.capture or self.keep or self.action)


def symbolise(line: str, label: str = "") -> Script:
    """The tokens of a line with their classes, named v0, v1, ... of the label."""
    label = re.sub(_NO_NAME, "_", label)
    leading, body, trailing = re.fullmatch(f"({SPACE}*)(.*?)({SPACE}*)", line, re.S).groups()
    parts = re.split(f"({SPACE}+)", body) if body else []
    tokens = [Token(classify(v), f"v{label}{k}", v, gap) for k, (v, gap) in enumerate(zip(parts[::2], [*parts[1::2], ""]))]
    return Script(tokens=tokens, leading=leading, trailing=trailing)


def read(text: str, label: str = "") -> Script:
    """A script with or without directives; the line in it may be readable elements or plain text."""
    m = _SCRIPT.fullmatch(text)
    if m is None:
        return symbolise(text, label)
    body = m[4]
    found = list(_ELEMENT.finditer(body))
    if not found:
        script = symbolise(body, label)
    else:
        script = Script(leading=body[: found[0].start()], trailing=body[found[-1].end() :])
        if script.leading.strip() or script.trailing.strip():
            raise EditError(f"text outside of elements: '{body}'")
        for e, after in zip(found, [*(f.start() for f in found[1:]), found[-1].end()]):
            script.tokens.append(Token(e[1], e[3], e[4].replace(_LEFT, "(").replace(_RIGHT, ")"), body[e.end() : after], e[2][0].lower() if len(e[2]) > 3 else "", e[2][0] in "CK"))
    if not script.tokens:
        raise EditError("the script has no line")
    script.capture, script.keep, script.action = (m[k].strip() for k in (1, 2, 3))
    return script


def _names(items: str) -> tuple[list[str], bool]:
    """Names of numbers, ranges and names, apart by commas or blanks; whether the last may be missing."""
    names, or_empty = [], False
    for item in re.split("[, \t]+", items.strip(", \t")):
        or_empty = bool(_OR_EMPTY.search(item))
        item = _OR_EMPTY.sub("", item)
        if m := re.fullmatch(r"([0-9]+):([0-9]+)", item):
            names += [f"v{k}" for k in range(int(m[1]), int(m[2]) + 1)]
        elif re.fullmatch(r"\w+", item):
            names.append(f"v{item}" if item.isdigit() else item)
    if not names:
        raise EditError(f"no tokens in '{items}'")
    return names, or_empty


def _split(script: Script, name: str, marks: str) -> None:
    k = script.at(name)
    token, largest = script.tokens[k], max(t.number for t in script.tokens)
    apart = f"[{re.escape(marks)}]+" if marks else c.PUNCT + "+"
    values = [v for v in re.split(f"({apart})", token.value) if v]
    new: list[Token] = []
    for v in values:
        before, v, behind = re.fullmatch(f"({SPACE}*)(.*?)({SPACE}*)", v, re.S).groups()
        if new:
            new[-1].gap += before
        if v:
            # Where no token has a number yet, parts are numbered within their token.
            new.append(Token(classify(v), f"v{largest + len(new) + 1}" if largest else f"{name}{len(new)}", v, behind))
    new[-1].gap += token.gap
    script.tokens[k : k + 1] = new


def _join(script: Script, names: list[str]) -> None:
    own = [script.tokens[script.at(n)] for n in names]
    value = "".join(t.value + t.gap for t in own).strip()
    k = script.at(names[0])
    script.tokens[k] = Token(classify(value), own[0].id, value, own[-1].gap)
    script.tokens = [t for t in script.tokens if not any(t is o for o in own[1:])]


def step(script: Script) -> None:
    """Carries out the actions, or if there are none what is captured and kept."""
    if script.action:
        for op in re.split(",? +", script.action):
            if m := re.fullmatch(r"([0-9]+):([0-9]+)[-_]join", op, re.I):
                if int(m[1]) > int(m[2]):
                    raise EditError(f"no tokens in '{op}'")
                _join(script, [f"v{k}" for k in range(int(m[1]), int(m[2]) + 1)])
            elif m := re.fullmatch(r"(\w+?(?:,\w+?)*)[-_]join", op, re.I):
                _join(script, [f"v{x}" if x.isdigit() else x for x in m[1].split(",")])
            elif m := re.fullmatch(r"(\w+?)[-_]split(?:[-_]?(.*))", op, re.I):
                marks = re.sub("_right_parenthesis_", ")", re.sub("_left_parenthesis_", "(", m[2], flags=re.I), flags=re.I)
                _split(script, f"v{m[1]}" if m[1].isdigit() else m[1], marks)
            else:
                raise EditError(f"no action '{op}'")
        script.action = ""
        return
    for mode, items in (("c", script.capture), ("k", script.keep)):
        if items:
            names, or_empty = _names(items)
            for name in names:
                token = script.tokens[script.at(name)]
                token.mode, token.or_empty = mode, token.or_empty or or_empty
    script.capture = script.keep = ""


def finished(text: str, label: str = "") -> Script:
    """The script with all its directives carried out, actions first."""
    script = read(text, label)
    while not script.done():
        step(script)
    return script


def pattern(script: Script) -> str:
    """What a whole line matches; captured tokens are named groups."""
    out = " *" if script.leading else ""
    for t in script.tokens:
        if not t.mode:
            out += templates._literal(t.value + t.gap)
            continue
        p = f"(?:{c.PATTERN[t.kind]})"
        p = f"(?:{p}|)" if t.or_empty else p
        out += f"(?P<{t.id}>{p})" if t.mode == "c" else p
        out += (" *" if not t.gap.strip(" ") else r"\s*") if t.or_empty and t.gap else templates._literal(t.gap)
    return out + (" *" if script.trailing else "")


def snippet(script: Script) -> str:
    """The line in the notation that templates are compiled from."""
    out = script.leading
    for t in script.tokens:
        if not t.mode:
            out += t.value + t.gap
            continue
        inside = [f"var_{t.id}"] * (t.mode == "c") + ["or_empty"] * t.or_empty
        out += f"{t.kind}({', '.join(inside)})"
        out += ("zero_or_spaces()" if not t.gap.strip(" ") else "zero_or_whitespaces()") if t.or_empty and t.gap else t.gap
    return out + script.trailing


def snippets(text: str) -> str:
    """The snippet of a script of one line or several; tokens of plain lines are labelled with the line's number."""
    return "\n".join(snippet(finished(line, str(k) if k else "")) if line.strip() else line for k, line in enumerate(re.split(LINE_END, text)))


def words(script: Script) -> list[str]:
    """Literal words, between blanks, that every line that fits has; `#n` for one of n words, `*` for any line.

    Words with a mark twice in a row stand for any number of that mark, and a word behind one that may be
    missing may touch it: these are left out.
    """
    runs, now = [], []
    for t in script.tokens:
        now.append(t)
        if re.search(SPACE, t.gap):
            runs.append(now)
            now = []
    runs += [now] if now else []
    # A literal may hold blanks of its own after a join: its first and last word are those of its neighbours.
    out, loose = [], False
    for run in runs:
        if not loose and not any(t.mode for t in run):
            out += [w for w in "".join(t.value for t in run).split() if not re.search(r"([!-/:-@\[-`{-~])\1", w)]
        loose = any(t.or_empty for t in run)
    if out:
        return sorted(set(out))
    if any(t.mode and (t.or_empty or "( " in c.PATTERN[t.kind]) for t in script.tokens):
        return ["*"]
    gaps = sum(bool(re.search(SPACE, t.gap)) for t in script.tokens[:-1])
    return [f"#{1 + gaps + sum(len(t.value.split()) - 1 for t in script.tokens if not t.mode)}"]


def compile_scripts(scripts: DataFrame) -> DataFrame:
    """scripts(name, spec) to name, pattern, columns, snippet, words, error; a script that fails has its error as a value."""

    def run(batches):
        for pdf in batches:
            rows = []
            for spec in pdf["spec"]:
                try:
                    script = finished(spec or "")
                    p = pattern(script)
                    re.compile(p)
                    if not any(t.mode == "c" for t in script.tokens):
                        raise EditError("nothing is captured")
                    rows.append((p, [t.id for t in script.tokens if t.mode == "c"], snippet(script), words(script), None))
                except (EditError, re.error) as e:
                    rows.append((None, None, None, None, str(e)))
            yield pdf[["name"]].assign(**{n: [r[k] for r in rows] for k, n in enumerate(("pattern", "columns", "snippet", "words", "error"))})

    return scripts.select("name", "spec").mapInPandas(run, "name string, pattern string, columns array<string>, snippet string, words array<string>, error string")


def anchored(compiled: DataFrame) -> DataFrame:
    """name, pattern, word: of each script that compiled the word that the fewest scripts need."""
    each = compiled.where(F.col("error").isNull()).select("name", "pattern", F.explode("words").alias("word"))
    n = each.groupBy("word").agg(F.count("*").alias("n"))
    return each.join(n, "word").groupBy("name", "pattern").agg(F.min_by("word", F.struct("n", "word")).alias("word"))


def captured(lines: DataFrame, compiled: DataFrame, line: str = "line") -> DataFrame:
    """The columns of lines, name and captured (map of id and text): a row for each script that a whole line fits.

    A line meets only the scripts whose rarest literal word it has, or that want its number of words;
    scripts of nothing but captures of any length meet every line. Null lines fit none.
    """
    from pyspark.sql import types as T

    scripts = anchored(compiled)
    if scripts.count() <= FEW_SCRIPTS:
        scripts = F.broadcast(scripts)
    inside = [f for f in lines.schema.fields]
    own = lines.select(F.struct(*lines.columns).alias("_row"), F.col(line).alias("_line"))
    found = tokens_of(F.col("_line"))
    met = own.select("_row", "_line", F.explode(F.array_union(F.array_distinct(found), F.array(F.concat(F.lit("#"), F.size(found).cast("string")), F.lit("*")))).alias("word")).join(scripts, "word")
    schema = T.StructType([T.StructField("_row", T.StructType(inside)), T.StructField("name", T.StringType()), T.StructField("captured", T.MapType(T.StringType(), T.StringType()))])

    def run(batches):
        import pyarrow as pa

        known: dict[str, re.Pattern] = {}
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            keep, maps = [], []
            for k, (text, p) in enumerate(zip(batch.column("_line").to_pylist(), batch.column("pattern").to_pylist())):
                if (m := (known.get(p) or known.setdefault(p, re.compile(p))).fullmatch(text)) is not None:
                    keep.append(k)
                    maps.append(list(m.groupdict().items()))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(at), batch.column("name").take(at), pa.array(maps, kind)], ["_row", "name", "captured"])

    return met.select("_row", "_line", "name", "pattern").mapInArrow(run, schema).select("_row.*", "name", "captured")
