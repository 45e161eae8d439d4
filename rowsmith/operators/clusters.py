"""Line templates of many clusters at once: clusters are found by the lines' classes, and everything about a
cluster stays in Spark, one row for each.

A row holds a cluster's sample; its candidates come from pairs of that and meet all lines of the cluster by
a join, where each task hands on what fails and what the slots hold. Clusters whose candidates all fail go
on with the lines they failed on. The driver only asks whether any cluster is left.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes as c
from ..sources.documents import kept
from . import mining
from .tokens import tokens_of

#: What a task holds about candidates before it hands it on.
HELD = 50_000
_BLANK = r"[ \t\n\x0b\f\r]"


def class_sequence(line: Column) -> Column:
    """The classes of a line's tokens, in order; a token of letters that begins it stands as it is."""
    # Step by step, as what a lambda is given is worked out once.
    found = tokens_of(line)
    names = F.transform(found, c.class_of_token)
    return F.array_join(F.transform(names, lambda k, i: F.when((i == 0) & k.isin("letter", "letters"), F.get(found, F.lit(0))).otherwise(F.coalesce(k, F.lit("other")))), " ")


def _test(batches):
    """Rows _c, line, patterns to what each task found: see mining._tested()."""
    import pyarrow as pa

    names = ["_c", "k", "part", "i", "masks", "kind", "length", "line"]
    compiled: dict[str, re.Pattern] = {}
    memo: dict[str, int] = {}
    fails: dict = {}
    slots: dict = {}
    gaps: dict = {}

    def handed(at):
        rows = [({"k": x}, k, "fail", -1, None, None, n, text) for (x, k), (n, text) in fails.items()]
        rows += [({"k": x}, k, "slot", i, m, None, None, None) for (x, k, i), m in slots.items() if (x, k) not in fails]
        rows += [({"k": x}, k, "gap", i, None, g, None, None) for (x, k, i), g in gaps.items() if (x, k) not in fails]
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [at, pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        for held in (fails, slots, gaps):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(columns, kinds)], names)

    at = None
    for batch in batches:
        at = batch.column("_c").type
        for key, x, patterns in zip(batch.column("_c").to_pylist(), batch.column("line").to_pylist(), batch.column("patterns").to_pylist()):
            key, size = key["k"], (len(x), x)
            for k, p in enumerate(patterns):
                if (key, k) in fails and fails[key, k] <= size:
                    continue
                m = (compiled.get(p) or compiled.setdefault(p, re.compile(p))).fullmatch(x)
                if m is None:
                    fails[key, k] = size
                elif (key, k) not in fails:
                    for name, v in m.groupdict().items():
                        if not v:
                            continue
                        spot = (key, k, int(name[1:]))
                        if name[0] == "g":
                            gaps[spot] = max(gaps.get(spot, mining.ONE), mining.gap_kind(v))
                        else:
                            if v not in memo:
                                if len(memo) > 100_000:
                                    memo.clear()
                                memo[v] = mining.value_mask(v)
                            slots[spot] = slots.get(spot, -1) & memo[v]
            if len(compiled) > HELD:
                compiled.clear()
            if len(fails) + len(slots) + len(gaps) > HELD:
                yield handed(at)
    if at is not None:
        yield handed(at)


def _candidates(batches):
    import pyarrow as pa

    for batch in batches:
        patterns, parts = [], []
        for sample in batch.column("sample").to_pylist():
            got = mining.candidates(sorted(set(sample), key=lambda s: (len(s), s)))
            patterns.append(list(got))
            parts.append([json.dumps(p) for p in got.values()])
        yield pa.RecordBatch.from_arrays([batch.column("_c"), pa.array(patterns, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.string()))], ["_c", "patterns", "parts"])


def _settled(sample: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fails, seen = {}, {}
                for f in r["found"] or []:
                    if f["part"] == "fail":
                        fails.setdefault(f["k"], f["line"])
                    else:
                        seen[f["k"], f["part"], f["i"]] = f["masks"] if f["part"] == "slot" else f["kind"]
                if not r["patterns"]:
                    out.append((None, None, mining.NO_PATTERN, r["sample"]))
                    continue
                first = next((k for k in range(len(r["patterns"])) if k not in fails), None)
                if first is None:
                    more = sorted(set(fails.values()) - set(r["sample"]), key=lambda s: (len(s), s))
                    out.append((None, None, None if more else mining.NO_PATTERN, r["sample"] + more[:sample]))
                    continue
                parts = [tuple(p) for p in json.loads(r["parts"][first])]
                masks = [seen.get((first, "slot", i), 0) for i in range(sum(o is not None for _, o in parts))]
                gaps = [seen.get((first, "gap", i), mining.ONE) for i in range(r["patterns"][first].count("(?P<g"))]
                done = mining.finished(mining.refined(parts, masks), gaps, (r["all_lead"], r["lead"], r["tabs"]), (r["all_trail"], r["trail"], r["tabs"]))
                out.append((*done, None, r["sample"]))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _STATE), *(pa.array(list(x), t) for x, t in zip(columns, kinds))], [*_STATE, "pattern", "snippet", "error", "sample"])

    return run


_STATE = ["_c", "n", "all_lead", "lead", "all_trail", "trail", "tabs"]


def patterns(lines: DataFrame, cluster: str, line: str = "line", sample: int = 12, rounds: int = 32) -> DataFrame:
    """cluster, n (lines that are not blank), pattern, snippet, error: for each cluster the first candidate that matches all its lines.

    As mining.matching_patterns(), but nothing of a cluster reaches the driver, so that there may be any number
    of clusters. A round takes the clusters that are left through all their lines once; a cluster with neither
    a pattern nor further lines to learn from has an error, as has one of fewer than two different lines.
    Lines of a null cluster are a cluster; null and blank lines do not count.
    """
    raw = F.col(line)
    x = F.regexp_replace(raw, rf"\A{_BLANK}+|{_BLANK}+\z", "")
    own = lines.select(F.struct(F.col(cluster).alias("k")).alias("_c"), raw.alias("raw"), x.alias("line")).where("line <> ''")
    lead, trail = F.col("raw").rlike(rf"\A{_BLANK}"), F.col("raw").rlike(rf"{_BLANK}\z")
    around = own.groupBy("_c").agg(
        F.count("*").alias("n"), F.bool_and(lead).alias("all_lead"), F.bool_or(lead).alias("lead"), F.bool_and(trail).alias("all_trail"), F.bool_or(trail).alias("trail"), F.bool_or(F.col("raw").rlike(r"[\t\n\x0b\f\r]")).alias("tabs"), (F.min("line") < F.max("line")).alias("several"),
    )
    samples = mining._samples(own, "_c", "line", sample).groupBy("_c").agg(F.array_sort(F.collect_list("line")).alias("sample"))
    none = F.lit(None).cast("string")
    state = around.join(samples, "_c").select(*_STATE, none.alias("pattern"), none.alias("snippet"), F.when(~F.col("several"), mining.TOO_FEW).alias("error"), "sample")
    state = kept(state)
    kind = state.schema["_c"].dataType.simpleString()
    for _ in range(rounds):
        left = state.where("pattern IS NULL AND error IS NULL")
        if not left.head(1):
            break
        tried = kept(left.select("_c", "sample").mapInArrow(_candidates, f"_c {kind}, patterns array<string>, parts array<string>"))
        met = own.select("_c", "line").join(tried.where(F.size("patterns") > 0).select("_c", "patterns"), "_c")
        tested = met.mapInArrow(_test, f"_c {kind}, k int, part string, i int, masks long, kind int, length int, line string")
        seen = tested.groupBy("_c", "k", "part", "i").agg(F.bit_and("masks").alias("masks"), F.max("kind").alias("kind"), F.min(F.when(F.col("line").isNotNull(), F.struct("length", "line"))).alias("fail"))
        # As many rows for each cluster as it has candidates and these have slots.
        found = seen.groupBy("_c").agg(F.collect_list(F.struct("k", "part", "i", "masks", "kind", F.col("fail.line").alias("line"))).alias("found"))
        both = left.join(tried, "_c").join(found, "_c", "left").select(*_STATE, "sample", "patterns", "parts", "found")
        settled = both.mapInArrow(_settled(sample), ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in _STATE) + ", pattern string, snippet string, error string, sample array<string>")
        state = kept(state.where("pattern IS NOT NULL OR error IS NOT NULL").union(settled.select(*state.columns)))
    error = F.when(F.col("pattern").isNull(), F.coalesce("error", F.lit(mining.NO_PATTERN)))
    return state.select(F.col("_c.k").alias(cluster), "n", "pattern", "snippet", error.alias("error"))
