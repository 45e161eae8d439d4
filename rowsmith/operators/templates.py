"""Templates: readable snippets compiled to line rules, and rules applied to documents.

A template has values and states; a state has rules that are tried in order on each line, and the
first that matches decides. Documents are independent, so they are parsed as rows, without a shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import PATTERN
from ..sources.documents import LINE_END, Texts, pieces_of

#: Records that a task hands out at once, and lines after which it looks for such.
AT_ONCE = 10_000

OPTIONS = ("Filldown", "Fillup", "Key", "List", "Required")
_LINE_OPS, _RECORD_OPS = ("Next", "Continue", "Error"), ("NoRecord", "Record", "Clear", "Clearall")
_ELEMENT = re.compile(r"([a-z][a-z_]*)\(([^()]*)\)")
_SPACES = {"": "", "space": " *", "spaces": " +", "whitespace": r"\s*", "whitespaces": r"\s+"}


class SnippetError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    pattern: str  # with ${name} for values
    line_op: str = "Next"
    record_op: str = "NoRecord"
    state: str = ""

    def text(self) -> str:
        op = ".".join([*([self.line_op] if self.line_op != "Next" else []), *([self.record_op] if self.record_op != "NoRecord" else [])])
        right = " ".join(x for x in (op, self.state) if x)
        return f"  {self.pattern}" + (f" -> {right}" if right else "")


@dataclass
class Template:
    values: dict[str, tuple[str, frozenset[str]]] = field(default_factory=dict)  # name: pattern, options
    states: dict[str, list[Rule]] = field(default_factory=dict)

    def text(self) -> str:
        out = [" ".join(["Value", *([",".join(sorted(o))] if o else []), n, f"({p})"]) for n, (p, o) in self.values.items()]
        for state, rules in self.states.items():
            out += ["", state, *(r.text() for r in rules)]
        return "\n".join(out)

    def regex(self, rule: Rule) -> str:
        p = rule.pattern.replace("$$", "$")
        for n, (v, _) in self.values.items():
            p = p.replace(f"${{{n}}}", f"(?P<{n}>{v})")
        if p.startswith("^(?i)"):  # flags stand first
            p = "(?i)^" + p[5:]
        return p


def _class_pattern(name: str, options: list[str]) -> str:
    if name == "something":
        p = ".*"
    elif name in PATTERN:
        p = PATTERN[name]
    else:
        raise SnippetError(f"unknown class {name}")
    for o in options:
        if m := re.fullmatch(r"at_most_([0-9]+)_(phrase|group)_occurrences", o):
            base = re.sub(r"\((?: \+?| )?.*", "", PATTERN[name]) if "( " in PATTERN[name] else p
            p = f"{base}({' +' if m[2] == 'group' else ' '}{base}){{0,{m[1]}}}"
    return p + "|" if name == "something" and "or_empty" in options else f"({p}|)" if "or_empty" in options else p


def _literal(text: str) -> str:
    """Literal text: blanks one or many, white space with a tab, runs of one mark twice or more, all else as it is."""
    out = []
    for part in re.finditer(r"[ \t]+|([!-/:-@\[-`{-~])\1+|[^ \t]", text):
        s = part[0]
        if s[0] in " \t":
            out.append(" " if s == " " else " +" if "\t" not in s else r"\s+")
        elif part[1]:
            out.append(f"{_mark(s[0])}{{2,}}")
        else:
            out.append(_mark(s))
    return "".join(out)


def _mark(c: str) -> str:
    return r"\x24" if c == "$" else re.escape(c) if c in r".^*+?{}[]\|()" else c


def _operation(text: str) -> tuple[str, str, str]:
    line_op, record_op, state = "Next", "NoRecord", ""
    for word in text.split():
        known = [next((k for k in (*_LINE_OPS, *_RECORD_OPS) if k.lower() == w.lower()), None) for w in word.split(".")]
        if all(known):
            for k in known:
                line_op, record_op = (k, record_op) if k in _LINE_OPS else (line_op, k)
        elif state:
            raise SnippetError(f"two states in '{text}'")
        else:
            state = word
    return line_op, record_op, state


def compile_line(line: str, values: dict[str, tuple[str, frozenset[str]]]) -> Rule:
    """One snippet line as a rule; its variables are added to values."""
    flags = ""
    if m := re.match(r"(ignore_case|keep|comment)__ +", line):
        line = line[m.end() :]
        if m[1] == "comment":
            raise SnippetError("a comment is no rule")
        if m[1] == "keep":
            body, _, op = line.partition(" -> ")
            return Rule(body.strip() if body.strip().startswith("^") else "^" + body.strip(), *_operation(op))
        flags = "(?i)"
    body, arrow, op = line.rstrip().partition(" -> ")
    if not arrow and body.endswith("->"):
        raise SnippetError("no operation after ->")
    out, at, end = [], 0, ""
    for m in _ELEMENT.finditer(body):
        name, args = m[1], [a.strip() for a in m[2].split(",") if a.strip()]
        if name not in PATTERN and name not in {"start", "end", "something", "space", "zero_or_spaces", "zero_or_whitespaces"}:
            # Words before a parenthesis are text, unless they look like a class with arguments.
            if any(a.startswith("var_") for a in args):
                raise SnippetError(f"unknown class {name}")
            continue
        text = body[at : m.start()]
        # The blank between the first or last element and the rest belongs to the notation.
        text = text.lstrip() if at and body[:at].startswith("start(") and "(" not in body[6:at] else text
        out.append(_literal(text.rstrip() if name == "end" else text))
        at = m.end()
        if name == "start":
            out.append(_SPACES[args[0] if args else ""])
        elif name == "end":
            end = _SPACES[args[0] if args else ""] + "$$"
        elif name == "zero_or_spaces":
            out.append(" *")
        elif name == "zero_or_whitespaces":
            out.append(r"\s*")
        elif name == "space":
            found = re.fullmatch(r"repetition_([0-9]*)_([0-9]*)", args[0] if args else "")
            out.append(f" {{{found[1] or 0},{found[2]}}}" if found else " ")
        else:
            variable = next((a[4:] for a in args if a.startswith("var_")), None)
            p = _class_pattern(name, args)
            if variable is None:
                out.append(f"({p})" if "|" in p else p)
                continue
            options = frozenset(o for a in args if a.startswith("meta_data_") for o in OPTIONS if o.lower() in a[10:].lower().split("_"))
            if variable in values and values[variable] != (p, options):
                variable = next(f"{variable}_{k}" for k in range(1, 99) if values.get(f"{variable}_{k}", (p, options)) == (p, options))
            values[variable] = (p, options)
            out.append(f"${{{variable}}}")
    out.append(_literal(body[at:].rstrip() if not end else ""))
    return Rule("^" + flags + "".join(out) + end, *_operation(op))


def compile_snippet(snippet: str) -> Template:
    """The template of a snippet; SnippetError if it has no variable or a line cannot be read."""
    t, state = Template(), "Start"
    for line in re.split(LINE_END, snippet):
        if not line.strip() or line.startswith("comment__ "):
            continue
        if re.fullmatch(r"[A-Za-z]\w*", line.strip()):
            state = line.strip()
            t.states.setdefault(state, [])
            continue
        t.states.setdefault(state, []).append(compile_line(line, t.values))
    if not t.values:
        raise SnippetError("the snippet has no variable")
    t.states = {"Start": t.states.pop("Start", []), **t.states}
    return t


def regexes(template: Template) -> list[str]:
    """The rules of a template as regular expressions with named groups, in their order: alternatives for the
    rows of a table, lines in a row for a block of pairs."""
    return [template.regex(r) for rules in template.states.values() for r in rules]


def compile_all(snippets: DataFrame) -> DataFrame:
    """snippets(name, snippet) to name, template, error: a snippet that fails has its error as a value.

    A task keeps what the last different snippets gave, as many names share one.
    """

    def compiled(snippet: str | None) -> tuple[str | None, str | None]:
        try:
            return compile_snippet(snippet or "").text(), None
        except (SnippetError, KeyError, re.error) as e:
            return None, str(e)

    def build(batches):
        known = lru_cache(10_000)(compiled)
        for pdf in batches:
            rows = [known(s) for s in pdf["snippet"]]
            yield pdf[["name"]].assign(template=[r[0] for r in rows], error=[r[1] for r in rows])

    return snippets.select("name", "snippet").mapInPandas(build, "name string, template string, error string")


class Machine:
    """Applies a template to texts."""

    def __init__(self, template: Template):
        self.t = template
        self.rules = {s: [(re.compile(template.regex(r)), r) for r in rules] for s, rules in template.states.items()}
        self.has = {o: {n for n, (_, own) in template.values.items() if o in own} for o in OPTIONS}

    def _blank(self, kept: dict | None = None) -> dict:
        """Values before a record; None has not been captured, which an empty text has."""
        return {n: kept[n] if kept and n in self.has["Filldown"] else [] if n in self.has["List"] else None for n in self.t.values}

    def records(self, text: str) -> tuple[list[dict], str | None]:
        """The records in order, and the error that stopped the document, if one did."""
        rows: list[dict] = []
        now, state = self._blank(), "Start"

        def record():
            nonlocal now
            if any(not now[n] for n in self.has["Required"]):
                now = self._blank(now)
                return
            if any(v is not None and v != [] for v in now.values()):
                rows.append({n: list(v) if isinstance(v, list) else v or "" for n, v in now.items()})
            now = self._blank(now)

        for line in re.split(LINE_END, text):
            for regex, rule in self.rules.get(state, []):
                m = regex.match(line)
                if not m:
                    continue
                for n, v in m.groupdict().items():
                    if n in self.has["List"]:
                        now[n] = [*now[n], v or ""]
                    else:
                        now[n] = v
                    if v and n in self.has["Fillup"]:
                        for r in reversed(rows):
                            if r[n]:
                                break
                            r[n] = v
                if rule.line_op == "Error":
                    return [], f"error rule matched: {line}"
                if rule.record_op == "Record":
                    record()
                elif rule.record_op == "Clear":
                    now = self._blank(now)
                elif rule.record_op == "Clearall":
                    now = self._blank()
                if rule.line_op != "Continue":
                    state = rule.state or state
                    break
            if state in ("EOF", "End"):
                break
        if state != "End" and "EOF" not in self.rules:
            record()
        return rows, None


def record_schema(lines: DataFrame, template: Template, key: str) -> T.StructType:
    lists = {n for n, (_, o) in template.values.items() if "List" in o}
    own = [T.StructField(n, T.ArrayType(T.StringType()) if n in lists else T.StringType()) for n in template.values]
    return T.StructType([T.StructField(key, lines.schema[key].dataType), T.StructField("record_no", T.LongType()), T.StructField("error", T.StringType()), *own])


class Run:
    """A template on the lines of one document, fed one after the other; hands out records as soon as nothing can change them."""

    def __init__(self, machine: Machine):
        self.m, self.now, self.state, self.rows, self.given, self.error = machine, machine._blank(), "Start", [], 0, None
        #: With an Error rule nothing is sure before the end.
        self.hold = any(r.line_op == "Error" for rules in machine.t.states.values() for r in rules)

    def _record(self) -> None:
        if any(not self.now[n] for n in self.m.has["Required"]):
            pass
        elif any(v is not None and v != [] for v in self.now.values()):
            self.rows.append({n: list(v) if isinstance(v, list) else v or "" for n, v in self.now.items()})
        self.now = self.m._blank(self.now)

    @property
    def over(self) -> bool:
        return self.error is not None or self.state in ("EOF", "End")

    def feed(self, line: str) -> None:
        for regex, rule in [] if self.over else self.m.rules.get(self.state, []):
            found = regex.match(line)
            if not found:
                continue
            for n, v in found.groupdict().items():
                self.now[n] = [*self.now[n], v or ""] if n in self.m.has["List"] else v
                if v and n in self.m.has["Fillup"]:
                    for r in reversed(self.rows):
                        if r[n]:
                            break
                        r[n] = v
            if rule.line_op == "Error":
                self.rows, self.error = [], f"error rule matched: {line}"
                return
            if rule.record_op == "Record":
                self._record()
            elif rule.record_op != "NoRecord":
                self.now = self.m._blank(self.now if rule.record_op == "Clear" else None)
            if rule.line_op != "Continue":
                self.state = rule.state or self.state
                return

    def sure(self, end: bool = False) -> list[tuple[int, dict]]:
        """Records that have not been handed out and will not change, with their numbers."""
        if end and self.error is None and self.state != "End" and "EOF" not in self.m.rules:
            self._record()
        n = len(self.rows)
        if not end:
            if self.hold:
                return []
            # A record waits for each value that fills up until it, or one after it, has it.
            for name in self.m.has["Fillup"]:
                n = min(n, next((k + 1 for k in range(len(self.rows) - 1, -1, -1) if self.rows[k][name]), 0))
        out = [(self.given + k, r) for k, r in enumerate(self.rows[:n])]
        self.rows, self.given = self.rows[n:], self.given + n
        return out


def record_batch(pa, keys: list, kind, rows: list, kinds, key: str):
    columns = list(zip(*rows)) if rows else [[] for _ in range(2 + len(kinds))]
    arrays = [pa.array(keys, kind), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), *(pa.array(c, f.type) for c, f in zip(columns[2:], kinds))]
    return pa.RecordBatch.from_arrays(arrays, [key, "record_no", "error", *kinds.names])


def parse(docs: DataFrame, template: Template, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, record_no, error and a column a value: the records of each document, in order.

    A document whose Error rule matches has one row with the error. Values not captured are ''. Documents
    arrive in pieces and leave in batches of AT_ONCE records: Python holds neither many nor long ones whole.
    """
    schema = record_schema(docs, template, key)
    names = list(template.values)

    def run(batches):
        import pyarrow as pa

        machine, texts = Machine(template), Texts(batches)
        kinds = pa.schema([pa.field(f.name, pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.string()) for f in schema.fields[3:]])
        keys, rows = [], []
        for k, lines in texts:
            now, n = Run(machine), 0
            for line in lines:
                now.feed(line)
                n += 1
                if n % AT_ONCE == 0:
                    rows += [(i, None, *(r[name] for name in names)) for i, r in now.sure()]
                    keys += [k] * (len(rows) - len(keys))
                    if len(rows) >= AT_ONCE:
                        yield record_batch(pa, keys, texts.kind, rows, kinds, key)
                        keys, rows = [], []
            rows += [(i, None, *(r[name] for name in names)) for i, r in now.sure(True)]
            if now.error:
                rows.append((0, now.error, *([] if name in machine.has["List"] else "" for name in names)))
            keys += [k] * (len(rows) - len(keys))
            if len(rows) >= AT_ONCE:
                yield record_batch(pa, keys, texts.kind, rows, kinds, key)
                keys, rows = [], []
        if rows:
            yield record_batch(pa, keys, texts.kind, rows, kinds, key)

    return pieces_of(docs, key, text).mapInArrow(run, schema)


def always_captures(pattern: str) -> bool:
    """Whether a line that matches the rule captures all its values: none stands in an option or a choice."""
    p = re.sub(r"\\.|\[[^]]*\]", "x", re.sub(r"\$\{\w+\}", "\0", pattern.replace("$$", "")))
    holds, choice = [False], [False]
    for i, ch in enumerate(p):
        if ch == "(":
            holds.append(False)
            choice.append(False)
        elif ch == "\0":
            holds[-1] = True
        elif ch == "|":
            choice[-1] = True
        elif ch == ")" and len(holds) > 1:
            held, chosen = holds.pop(), choice.pop()
            if held and (chosen or p[i + 1 : i + 2] in ("?", "*", "{")):
                return False
            holds[-1] |= held
    return not (holds[0] and choice[0])


def is_stateless(template: Template) -> bool:
    """One state, every rule of which ends a record of its own on its line."""
    rules = template.states.get("Start", [])
    own = all(r.record_op == "Record" and r.line_op == "Next" and not r.state and always_captures(r.pattern) for r in rules)
    return len(template.states) == 1 and own and not any(o for _, o in template.values.values())


def parse_lines(lines: DataFrame, template: Template, line: str = "line") -> DataFrame:
    """The native path for stateless templates: the columns of lines and one a value.

    Rules are tried in order; values that the rule which matched does not capture are ''.
    """
    if not is_stateless(template):
        raise ValueError("the template keeps state between lines")
    rules = []
    for r in template.states["Start"]:
        regex = re.compile(template.regex(r))
        rules.append((re.sub(r"\(\?P<\w+>", "(", template.regex(r)), regex.groupindex))
    which = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        which = F.when(F.col(line).rlike(rules[i][0]), i).otherwise(which)
    # A rule without values ends no record, as nothing is captured.
    bare = [i for i, (_, groups) in enumerate(rules) if not groups]
    found = lines.withColumn("_rule", which).where(F.col("_rule").isNotNull() & ~F.col("_rule").isin(bare))
    columns = []
    for n in template.values:
        value = F.lit("")
        for i, (p, groups) in enumerate(rules):
            if n in groups:
                value = F.when(F.col("_rule") == i, F.regexp_extract(line, p, groups[n])).otherwise(value)
        columns.append(value.alias(n))
    return found.select(*lines.columns, *columns)
