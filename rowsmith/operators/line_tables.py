"""Templates over tables of lines, in any order on disk: key, place of the line in its document, line.

Three ways to the same records. `parse_ordered` sorts each document's lines within a task and carries the
state of the template from one Arrow batch to the next. Where one document is too long for one task,
`steps_of_chunks` cuts it: what each chunk does to every state that it may be entered in is composed
over the chunks, and then each chunk runs from the state that it is really entered in. Templates of a single state
need no Python: `steps_of_rules` is expressions. Both give steps, a row for each rule that a line
matches; `records_of` makes them records by window functions, chunk by chunk with what one chunk hands to the next.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.documents import dealt, kept
from .templates import Machine, Run, Template, always_captures, record_batch, record_schema

#: Lines of a chunk, by their places.
CHUNK = 20_000


def parse_ordered(lines: DataFrame, template: Template, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """key, record_no, error and a column a value, as parse() of the joined lines.

    One shuffle by key; lines come in order by Spark's sort, which spills, and a document is never held
    whole: only its open record, and records that a value may still fill up. Lines of one place go by
    their text; null lines are skipped; lines without a key are one document.
    """
    schema = record_schema(lines, template, key)
    names = list(template.values)

    def run(batches):
        import pyarrow as pa

        machine, now, last = Machine(template), None, object()
        kinds = pa.schema([pa.field(f.name, pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.string()) for f in schema.fields[3:]])
        keys, rows = [], []

        def take(end: bool) -> None:
            if now is None:
                return
            for k, r in now.sure(end):
                keys.append(last)
                rows.append((k, None, *(r[n] for n in names)))
            if end and now.error:
                keys.append(last)
                rows.append((0, now.error, *([] if n in machine.has["List"] else "" for n in names)))

        for batch in batches:
            kind = batch.column("_k").type
            for k, x in zip(batch.column("_k").to_pylist(), batch.column("_x").to_pylist()):
                if now is None or k != last:
                    take(True)
                    now, last = Run(machine), k
                now.feed(x)
            take(False)
            yield record_batch(pa, keys, kind, rows, kinds, key)
            keys, rows = [], []
        take(True)
        if rows:
            yield record_batch(pa, keys, kind, rows, kinds, key)

    own = lines.where(F.col(line).isNotNull()).select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(line).alias("_x"))
    return dealt(own, "_k").sortWithinPartitions("_k", "_o", "_x").select("_k", "_x").mapInArrow(run, schema)


# --- Steps: one row for each rule that a line matches -------------------------------------------------


def is_single_state(template: Template) -> bool:
    """One state whose rules always capture all their values: its steps need no Python."""
    rules = template.states.get("Start", [])
    return set(template.states) <= {"Start", "EOF"} and all(r.line_op in ("Next", "Continue", "Error") and r.state in ("", "Start", "EOF") and always_captures(r.pattern) for r in rules)


def can_be_steps(template: Template) -> bool:
    """Whether records_of() makes the template's records; some options of one value exclude each other."""
    mixed = [{"List", "Filldown"}, {"List", "Fillup"}, {"Filldown", "Fillup"}]
    return not any(m <= o for _, o in template.values.values() for m in mixed)


def _own(lines: DataFrame, key: str, order: str, line: str, chunk_lines: int | None, chunk: str | None = None) -> DataFrame:
    """_k (a struct, so that null is a key like others), chunk, line_no, line."""
    chunk = F.col(chunk) if chunk else F.floor(F.col(order) / chunk_lines) if chunk_lines else F.lit(0)
    return lines.where(F.col(line).isNotNull()).select(F.struct(F.col(key).alias("k")).alias("_k"), chunk.cast("long").alias("chunk"), F.col(order).cast("long").alias("line_no"), F.col(line).alias("line"))


def steps_of_rules(lines: DataFrame, template: Template, key: str = "doc_id", order: str = "line_no", line: str = "line", chunk_lines: int | None = None) -> DataFrame:
    """The steps of a template of one state, by expressions alone: no shuffle, no Python."""
    if not is_single_state(template):
        raise ValueError("the template has several states, or rules that do not always capture their values")
    rules = []
    for r in template.states["Start"]:
        named = template.regex(r)
        java = re.sub(r"\(\?P<\w+>", "(", named)
        # Java's $ also stands before a last line end; (?d) leaves other line ends than \n to the dot.
        java = java[:-1] + r"\z" if java.endswith("$") and not java.endswith(r"\$") else java
        rules.append((r, rf"(?d)\A(?:{java})", re.compile(named).groupindex))
    x = F.col("line")
    reached, steps = F.lit(True), []
    for r, pattern, groups in rules:
        # A rule is tried on a line that no rule before it has ended.
        hit = reached & x.rlike(pattern)
        caps = F.array(*(F.struct(F.regexp_extract(x, pattern, groups[n]).alias("v")) if n in groups else F.lit(None).cast("struct<v:string>") for n in template.values))
        op = "Error" if r.line_op == "Error" else r.record_op if r.record_op != "NoRecord" else ""
        step = F.struct(F.lit(op).alias("op"), F.lit(r.state == "EOF" and r.line_op == "Next").alias("ends"), caps.alias("caps"), (x if op == "Error" else F.lit(None).cast("string")).alias("note"))
        steps.append(F.when(hit, step))
        if r.line_op != "Continue":
            reached = reached & ~hit
    own = _own(lines, key, order, line, chunk_lines)
    s = own.select("_k", "chunk", "line_no", "line", F.posexplode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("sub", "s")).select("_k", "chunk", F.struct("line_no", "line", "sub").alias("at"), "s.*")
    if any(r.state == "EOF" for r, _, _ in rules):
        s = _counted(s, F.col("ends"), "_over").where("_over = 0").drop("_over")
    return s.drop("ends")


def steps_of_chunks(lines: DataFrame, template: Template, key: str = "doc_id", order: str = "line_no", line: str = "line", chunk_lines: int = CHUNK, chunk: str | None = None) -> DataFrame:
    """The steps of any template, a task for each chunk of a document: chunk_lines places, or where lines have a column
    for it the lines of one number, which stand in the order of these numbers and then of their places.

    First each chunk is run from every state at once: which state does each lead to? These maps, a row a
    chunk, are composed by doubling: after k rounds a row holds what the 2 ** k chunks up to it do. Then each chunk
    runs from the state that all chunks before it lead to.
    """
    states = list(dict.fromkeys([*template.states, "Start", "EOF", "End", "*error", *(r.state for rules in template.states.values() for r in rules if r.state)]))
    place = {s: i for i, s in enumerate(states)}
    stops = {place[s] for s in ("EOF", "End", "*error")}
    own = _own(lines, key, order, line, chunk_lines, chunk)
    spread = dealt(own, "_k", "chunk").sortWithinPartitions("_k", "chunk", "line_no", "line")
    kind = own.schema["_k"].dataType

    def step(machine: Machine, state: int, text: str):
        """The state behind a line, and the rules that it matches."""
        hits = []
        for regex, rule in [] if state in stops else machine.rules.get(states[state], []):
            m = regex.match(text)
            if m:
                hits.append((rule, m))
                if rule.line_op == "Error":
                    return place["*error"], hits
                if rule.line_op != "Continue":
                    return place[rule.state] if rule.state else state, hits
        return state, hits

    def effects(batches):
        import pyarrow as pa

        machine, last, now = Machine(template), None, None
        for batch in batches:
            done = []
            for k, c, text in zip(batch.column("_k").to_pylist(), batch.column("chunk").to_pylist(), batch.column("line").to_pylist()):
                if (k, c) != last:
                    done += [(*last, now)] if last else []
                    last, now = (k, c), list(range(len(states)))
                moved = {s: step(machine, s, text)[0] for s in set(now)}
                now = [moved[s] for s in now]
            yield _effects(pa, done, batch.column("_k").type)
            at = batch.column("_k").type
        if last:
            yield _effects(pa, [(*last, now)], at)

    def _effects(pa, done, at):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], at), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.int32()))], ["_k", "chunk", "does"])

    maps = spread.select("_k", "chunk", "line").mapInArrow(effects, T.StructType([T.StructField("_k", kind), T.StructField("chunk", T.LongType()), T.StructField("does", T.ArrayType(T.IntegerType()))]))
    in_order = Window.partitionBy("_k").orderBy("chunk")
    maps = kept(maps.withColumn("n", F.row_number().over(in_order)))
    most, reach = maps.agg(F.max("n").alias("n")).first()["n"] or 0, 1
    composed = maps
    while reach < most:
        before = F.lag("does", reach).over(in_order)
        composed = composed.withColumn("does", F.when(before.isNull(), F.col("does")).otherwise(F.transform(before, lambda s: F.get("does", s)))).select("_k", "chunk", "does")
        reach *= 2
    entered = composed.select("_k", "chunk", F.coalesce(F.get(F.lag("does").over(in_order), F.lit(place["Start"])), F.lit(place["Start"])).alias("state"), F.get("does", F.lit(place["Start"])).alias("leaves"), F.lead("chunk").over(in_order).isNull().alias("final"))
    entered = entered.where(~F.col("state").isin(*stops))
    # The state goes ahead of the lines of its chunk, as a row of its own: no join, and one shuffle of the lines.
    ahead = entered.select("_k", "chunk", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"), "state")
    known = dealt(own.withColumn("state", F.lit(None).cast("int")).union(ahead), "_k", "chunk").sortWithinPartitions("_k", "chunk", F.col("state").isNull(), "line_no", "line")
    names = list(template.values)

    def run(batches):
        import pyarrow as pa

        machine, last, state, at_kind = Machine(template), None, None, None
        caps = pa.list_(pa.struct([("v", pa.string())]))
        spot = pa.struct([("line_no", pa.int64()), ("line", pa.string()), ("sub", pa.int32())])
        for batch in batches:
            out = []
            for k, c, i, text, enters in zip(*(batch.column(n).to_pylist() for n in ("_k", "chunk", "line_no", "line", "state"))):
                if enters is not None:
                    last, state = (k, c), enters
                    continue
                # A chunk without a state is one that the document does not come to.
                if (k, c) != last or state in stops:
                    continue
                state, hits = step(machine, state, text)
                for sub, (rule, m) in enumerate(hits):
                    groups = m.groupdict()
                    op = "Error" if rule.line_op == "Error" else rule.record_op if rule.record_op != "NoRecord" else ""
                    out.append((k, c, {"line_no": i, "line": text, "sub": sub}, op, [{"v": groups[n]} if n in groups else None for n in names], text if op == "Error" else None))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (batch.column("_k").type, pa.int64(), spot, pa.string(), caps, pa.string()))], ["_k", "chunk", "at", "op", "caps", "note"])

    at = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("line", T.StringType()), T.StructField("sub", T.IntegerType())])
    captured = T.ArrayType(T.StructType([T.StructField("v", T.StringType())]))
    schema = T.StructType([T.StructField("_k", kind), T.StructField("chunk", T.LongType()), T.StructField("at", at), T.StructField("op", T.StringType()), T.StructField("caps", captured), T.StructField("note", T.StringType())])
    steps = known.select("_k", "chunk", "line_no", "line", "state").mapInArrow(run, schema)
    # A document that ends in the state End has no record of its open values: it is dropped with them.
    ended = entered.where(F.col("final") | F.col("leaves").isin(*stops)).where(F.col("leaves") == place["End"]).select("_k", "chunk")
    if "End" in [r.state for rules in template.states.values() for r in rules]:
        close = ended.select("_k", "chunk", F.struct(F.lit((1 << 63) - 2).alias("line_no"), F.lit("").alias("line"), F.lit(0).alias("sub")).alias("at"), F.lit("Clearall").alias("op"), F.array(*(F.lit(None).cast("struct<v:string>") for _ in names)).alias("caps"), F.lit(None).cast("string").alias("note"))
        steps = steps.union(close)
    return steps


# --- Records out of steps -----------------------------------------------------------------------------

_WITHIN = ("_k", "chunk")


def _handed(df: DataFrame, total: Column, over: Column, name: str) -> DataFrame:
    """df with what the chunks before each one hand to it; a row a chunk is all that goes over a whole document."""
    chunks = df.groupBy(*_WITHIN).agg(total.alias("_t")).select(*_WITHIN, over.alias(name))
    return df.join(chunks, list(_WITHIN))


def _counted(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """df with how many rows of the document before each one have the flag."""
    n = F.coalesce(F.sum(flag.cast("long")).over(Window.partitionBy(*_WITHIN).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("_t").over(Window.partitionBy("_k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = _handed(df.withColumn("_own", n), F.sum(flag.cast("long")), before, "_before")
    return df.withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before")


def _latest(df: DataFrame, event: Column, name: str) -> DataFrame:
    """df with the last event, of this row or one before it in the document, that is not null."""
    df = df.withColumn("_e", event)
    own = F.last("_e", True).over(Window.partitionBy(*_WITHIN).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    before = F.last("_t", True).over(Window.partitionBy("_k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    df = _handed(df.withColumn("_own", own), F.max_by("_e", F.when(F.col("_e").isNotNull(), F.col("at"))), before, "_before")
    return df.withColumn(name, F.coalesce("_own", "_before")).drop("_own", "_before", "_e")


def _next(df: DataFrame, event: Column, name: str) -> DataFrame:
    """df with the first event, of a row behind this one in the document, that is not null."""
    df = df.withColumn("_e", event)
    own = F.first("_e", True).over(Window.partitionBy(*_WITHIN).orderBy("at").rowsBetween(1, Window.unboundedFollowing))
    after = F.first("_t", True).over(Window.partitionBy("_k").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing))
    df = _handed(df.withColumn("_own", own), F.min_by("_e", F.when(F.col("_e").isNotNull(), F.col("at"))), after, "_after")
    return df.withColumn(name, F.coalesce("_own", "_after")).drop("_own", "_after", "_e")


def records_of(steps: DataFrame, template: Template, key: str = "doc_id") -> DataFrame:
    """key, record_no, error and a column a value: the records of steps, by window functions.

    Steps up to one that ends a record are a segment, whose last captures are the record's. Values that fill down
    are the last captures before, those that fill up the next ones behind. No chunk needs another's rows.
    """
    if not can_be_steps(template):
        raise ValueError("a value's options exclude each other here")
    names = list(template.values)
    has = {o: [n for n in names if o in template.values[n][1]] for o in ("Filldown", "Fillup", "List", "Required")}
    cap = {n: F.get("caps", F.lit(i)) for i, n in enumerate(names)}
    errors = None
    if any(r.line_op == "Error" for rules in template.states.values() for r in rules):
        errors = steps.where("op = 'Error'").groupBy("_k").agg(F.min_by("note", F.struct("chunk", "at")).alias("note"))
        steps = steps.join(errors.select("_k"), "_k", "left_anti")
    if "EOF" not in template.states:
        # What is open at the end of a document is a record as well.
        none = F.array(*(F.lit(None).cast("struct<v:string>") for _ in names))
        end = steps.groupBy("_k").agg(F.max("chunk").alias("chunk")).select("_k", "chunk", F.struct(F.lit((1 << 63) - 1).alias("line_no"), F.lit("").alias("line"), F.lit(0).alias("sub")).alias("at"), F.lit("Record").alias("op"), none.alias("caps"), F.lit(None).cast("string").alias("note"))
        steps = steps.union(end)
    s = _counted(steps, F.col("op") != "", "seg")
    for n in has["Filldown"]:
        s = _latest(s, F.when(F.col("op") == "Clearall", F.struct(F.lit(None).cast("string").alias("v"))).otherwise(cap[n]), f"_down_{n}")
    for n in has["Fillup"]:
        s = _next(s, F.when(F.coalesce(cap[n]["v"], F.lit("")) != "", cap[n]["v"]), f"_up_{n}")
    columns = []
    for n in names:
        if n in has["List"]:
            found = F.array_sort(F.collect_list(F.when(cap[n].isNotNull(), F.struct("chunk", "at", F.coalesce(cap[n]["v"], F.lit("")).alias("v")))))
            columns.append(F.transform(found, lambda x: x["v"]).alias(n))
        elif n in has["Filldown"]:
            columns.append(F.max_by(F.col(f"_down_{n}")["v"], F.struct("chunk", "at")).alias(n))
        else:
            # What a rule did not capture although it names the value counts as nothing.
            columns.append(F.max_by(cap[n]["v"], F.when(cap[n].isNotNull(), F.struct("chunk", "at"))).alias(n))
    # A segment may begin in one chunk and end in another: its last step is that with the greatest place.
    ups = [F.max_by(f"_up_{n}", F.struct("chunk", "at")).alias(f"_up_{n}") for n in has["Fillup"]]
    last = F.max(F.struct("chunk", "at", "op"))
    r = s.groupBy("_k", "seg").agg(last.alias("_last"), *columns, *ups).where("_last.op = 'Record'")
    any_ = reduce(lambda a, b: a | b, [F.size(n) > 0 if n in has["List"] else F.col(n).isNotNull() for n in names])
    for n in has["Required"]:
        any_ = any_ & (F.size(n) > 0 if n in has["List"] else F.coalesce(F.col(n), F.lit("")) != "")
    r = r.where(any_).select("_k", F.col("_last.chunk").alias("chunk"), F.col("_last.at").alias("at"), *names, *(f"_up_{n}" for n in has["Fillup"]))
    r = _counted(r, F.lit(True), "record_no")
    value = {n: F.col(n) if n in has["List"] else F.coalesce(F.when(F.col(n) != "", F.col(n)), F.col(f"_up_{n}"), F.lit("")) if n in has["Fillup"] else F.coalesce(n, F.lit("")) for n in names}
    out = r.select(F.col("_k.k").alias(key), "record_no", F.lit(None).cast("string").alias("error"), *(value[n].alias(n) for n in names))
    if errors is not None:
        empty = [F.array().cast("array<string>") if n in has["List"] else F.lit("") for n in names]
        out = out.union(errors.select(F.col("_k.k").alias(key), F.lit(0).cast("long"), F.concat(F.lit("error rule matched: "), "note"), *empty))
    return out


def parse_table(lines: DataFrame, template: Template, key: str = "doc_id", order: str = "line_no", line: str = "line", chunk_lines: int | None = None) -> DataFrame:
    """The records of a table of lines by the way that suits: expressions for templates of one state, chunks where
    their size is given, else lines in order."""
    if can_be_steps(template) and is_single_state(template):
        return records_of(steps_of_rules(lines, template, key, order, line, chunk_lines), template, key)
    if chunk_lines and can_be_steps(template):
        return records_of(steps_of_chunks(lines, template, key, order, line, chunk_lines), template, key)
    return parse_ordered(lines, template, key, order, line)
