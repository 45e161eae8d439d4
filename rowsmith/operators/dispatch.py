"""Documents parsed by the templates of a registry: by name, or by the one that fits best.

A template needs certain words in a text: those that stand as they are in the rules that capture, or in those that
capture a Required value. Of each such rule the word that the fewest templates need is its key, and a document is
tried with those templates alone of which it has a key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.documents import LINE_END
from .templates import _LINE_OPS, _RECORD_OPS, OPTIONS, Machine, Rule, SnippetError, Template

#: Characters of templates that are broadcast at once; a larger registry is gone through in blocks of as much.
BLOCK = 32_000_000
#: Compiled templates that a task keeps.
KEPT = 1000
WORD = re.compile(r"[A-Za-z0-9_]+")
_VALUE = re.compile(r"Value(?: ([A-Za-z,]+))? (\w+) \((.*)\)\Z")
_RULE = re.compile(r"\s+(\^.*?)(?: -> ([A-Za-z.]*)(?: ?(\w+))?)?\s*\Z")


def read_template(text: str) -> Template:
    """The template of its own text, as Template.text() writes it; SnippetError where a line cannot be read."""
    t, state = Template(), None
    for line in re.split(LINE_END, text):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if state is None and (m := _VALUE.fullmatch(line)):
            options = frozenset((m[1] or "").split(",")) - {""}
            if not options <= set(OPTIONS):
                raise SnippetError(f"unknown option in '{line}'")
            t.values[m[2]] = (m[3], options)
        elif re.fullmatch(r"\w+", line.rstrip()) and not line[0].isspace():
            state = line.rstrip()
            t.states.setdefault(state, [])
        elif state is not None and (m := _RULE.fullmatch(line)):
            line_op, record_op, target = "Next", "NoRecord", m[3] or ""
            parts = [p for p in (m[2] or "").split(".") if p]
            if parts and not all(p in (*_LINE_OPS, *_RECORD_OPS) for p in parts):
                if target or len(parts) > 1:
                    raise SnippetError(f"unknown operation in '{line}'")
                target, parts = parts[0], []
            for p in parts:
                line_op, record_op = (p, record_op) if p in _LINE_OPS else (line_op, p)
            t.states[state].append(Rule(m[1], line_op, record_op, target))
        else:
            raise SnippetError(f"cannot read '{line}'")
    if not t.values or "Start" not in t.states:
        raise SnippetError("a template has values and a state Start")
    for rules in t.states.values():
        for r in rules:
            try:
                re.compile(t.regex(r))
            except re.error as e:
                raise SnippetError(f"{e} in '{r.pattern}'") from e
    return t


def needed_words(pattern: str) -> set[str]:
    """Whole words that every line which a rule matches has. Anything but plain characters cuts a word off."""
    if not pattern.startswith("^") or pattern.startswith("^(?"):
        return set()
    known: list[str | None] = [" "]  # the start of the line ends a word like a blank
    i, depth = 1, 0
    ends = pattern.endswith("$$")
    body = pattern[:-2] if ends else pattern
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            known.append(body[i + 1 : i + 2] if not body[i + 1 : i + 2].isalnum() and depth == 0 else None)
            i += 2
            continue
        if ch == "[":
            close = body.find("]", i + 2)
            known.append(None)
            i = (close if close > 0 else len(body)) + 1
            continue
        if body.startswith("${", i):
            known.append(None)
            i = body.find("}", i) + 1
            continue
        if ch == "(":
            depth += 1
            known.append(None)
        elif ch == ")":
            depth -= 1
            known.append(None)
        elif ch == "|" and depth == 0:
            return set()
        elif depth or ch in ".^$|":
            known.append(None)
        elif ch in "*?{":
            if known[-1] is not None:
                known[-1] = None
            if ch == "{":
                i = body.find("}", i)
        elif ch == "+":
            # Once or more: the character is there, and more of it only where no word goes on.
            known[-1] = known[-1] if known[-1] is not None and not WORD.fullmatch(known[-1]) else None
        else:
            known.append(ch)
        i += 1
    known.append(" " if ends else None)
    out, word, whole = set(), "", False
    for ch in known:
        if ch is not None and WORD.fullmatch(ch):
            word += ch
        else:
            if word and whole and ch is not None:
                out.add(word)
            word, whole = "", ch is not None
    return out


def template_words(t: Template) -> list[list[list[str]]] | None:
    """Groups of rules of each of which one has to match for a record, as the words that each rule needs: all rules that
    capture, and for each Required value those that capture it. None if every group has a rule that needs none, so that any text may fit."""
    patterns = [r.pattern for rules in t.states.values() for r in rules]
    groups = [["${" in p for p in patterns], *([f"${{{n}}}" in p for p in patterns] for n, (_, o) in t.values.items() if "Required" in o)]
    each = [[sorted(needed_words(p)) for p, is_in in zip(patterns, group) if is_in] for group in groups]
    return [rules for rules in each if rules and all(rules)] or None


class Registry:
    """Templates by name, and which of them a text can be tried with."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.texts, self.compiled, self.errors = dict(rows), {}, {}
        words, counts = {}, {}
        for name, text in rows:
            try:
                words[name] = template_words(read_template(text or ""))
            except SnippetError as e:
                self.errors[name] = str(e)
                continue
            for w in {w for group in words[name] or [] for rule in group for w in rule}:
                counts[w] = counts.get(w, 0) + 1
        self.always = sorted(n for n, w in words.items() if w is None)
        self.by_word: dict[str, set[str]] = {}
        rarest = lambda rule: min(rule, key=lambda w: (counts[w], w))
        for name, groups in words.items():
            # The group whose words the fewest templates need: a template of which a text has none of these gives it no record.
            for rule in min(groups, key=lambda g: sum(counts[rarest(r)] for r in g)) if groups else []:
                self.by_word.setdefault(rarest(rule), set()).add(name)

    def machine(self, name: str) -> Machine:
        if name not in self.compiled:
            if len(self.compiled) >= KEPT:
                self.compiled.clear()
            self.compiled[name] = Machine(read_template(self.texts[name]))
        return self.compiled[name]

    def candidates(self, text: str) -> list[str]:
        found = set(self.always)
        for w in set(WORD.findall(text)):
            found |= self.by_word.get(w, set())
        return sorted(found)

    def fit(self, text: str) -> tuple[str | None, int, int, int]:
        """The template with the most records, then the most filled values, then by name; both numbers, and how many were tried."""
        best, tried = (0, 0, None), self.candidates(text)
        for name in tried:
            rows, error = self.machine(name).records(text)
            filled = sum(bool(v) for r in rows for v in r.values())
            if not error and filled and (len(rows), filled) > best[:2]:
                best = (len(rows), filled, name)
        return best[2], best[0], best[1], len(tried)


def _blocks(registry: DataFrame, block: int) -> list[tuple[int, int]]:
    """(number of blocks, block): rows go to blocks by the hash of their name."""
    size = registry.agg(F.sum(F.length("template") + F.length("name")).alias("n")).first()["n"] or 0
    n = max(1, -(-2 * int(size) // block))
    return [(n, b) for b in range(n)] if size > block else [(1, 0)]


def _part(registry: DataFrame, n: int, b: int):
    rows = registry.where(F.pmod(F.xxhash64("name"), F.lit(n)) == b).select("name", "template").collect()  # about `block` characters
    return registry.sparkSession.sparkContext.broadcast([(r["name"], r["template"]) for r in rows])


def best_fit(docs: DataFrame, registry: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key, name, n_records, n_values, n_tried: of each document the template with the most records (then values, then
    the least name); null and zeros where none gives a record.

    registry(name, template): a template that cannot be read fits nothing. Null texts fit nothing. Each row of docs is
    a document, with no shuffle while the registry is one block; else the blocks' answers meet by row.
    """
    kind = docs.schema[key].dataType.simpleString()
    parts = [_part(registry, n, b) for n, b in _blocks(registry, block)]
    if len(parts) > 1:
        # Each pass has to name the same row in the same way.
        from ..sources.documents import kept

        docs = kept(docs.select(key, text).withColumn("_row", F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn("_row", F.lit(0).cast("long"))

    def fitted(shared):
        own: list[Registry] = []

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                if not own:
                    own.append(Registry(shared.value))
                found = [own[0].fit(t) if t is not None else (None, 0, 0, 0) for t in batch.column("_x").to_pylist()]
                columns = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_k"), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["_row", key, "name", "n_records", "n_values", "n_tried"])

        return docs.select("_row", F.col(key).alias("_k"), F.col(text).alias("_x")).mapInArrow(run, f"_row long, `{key}` {kind}, name string, n_records long, n_values long, n_tried long")

    out = fitted(parts[0])
    if len(parts) == 1:
        return out.drop("_row")
    for shared in parts[1:]:
        out = out.union(fitted(shared))
    best = F.min_by(F.struct("name", "n_records", "n_values"), F.struct((-F.col("n_records")).alias("a"), (-F.col("n_values")).alias("b"), F.coalesce("name", F.lit("")).alias("c")))
    return out.groupBy("_row").agg(F.first(key).alias(key), best.alias("b"), F.sum("n_tried").alias("n_tried")).select(key, "b.name", "b.n_records", "b.n_values", "n_tried")


def parse_by_name(docs: DataFrame, registry: DataFrame, name: str = "name", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, name, record_no, error, values (map), lists (map): the records of each document by the template that it names.

    Documents and templates meet by name, so that a registry of any size will do; a name that many documents
    have is split by Spark. A name that the registry lacks, a template that cannot be read and an Error rule
    give one row with the error. Null texts and names without records give no row.
    """
    named = docs.select(F.col(key).alias("_k"), F.col(name).alias("_n"), F.col(text).alias("_x")).where("_x IS NOT NULL")
    met = named.join(registry.select(F.col("name").alias("_n"), "template"), "_n", "left")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        machines: dict[str, Machine | str] = {}
        for batch in batches:
            keys, rows = [], []
            for k, n, x, t in zip(*(batch.column(c).to_pylist() for c in ("_k", "_n", "_x", "template"))):
                if t is None:
                    keys.append(k)
                    rows.append((n, 0, f"no template '{n}'", [], []))
                    continue
                if t not in machines:
                    if len(machines) >= KEPT:
                        machines.clear()
                    try:
                        machines[t] = Machine(read_template(t))
                    except SnippetError as e:
                        machines[t] = str(e)
                m = machines[t]
                found, error = ([], m) if isinstance(m, str) else m.records(x)
                if error:
                    keys.append(k)
                    rows.append((n, 0, error, [], []))
                for i, r in enumerate(found):
                    keys.append(k)
                    rows.append((n, i, None, [(a, v) for a, v in r.items() if not isinstance(v, list)], [(a, v) for a, v in r.items() if isinstance(v, list)]))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("_k").type), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], [key, "name", "record_no", "error", "values", "lists"])

    return met.mapInArrow(run, f"`{key}` {kind}, name string, record_no long, error string, values map<string,string>, lists map<string,array<string>>")
