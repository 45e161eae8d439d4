"""Exact similarity join of word-shingle sets, with what related sets have in common done once.

Two sets link when their Jaccard similarity is 0.75 or more; documents come out with the connected
component of their links. The index is a list of sets for each shingle of a prefix:

* Equal sets are one set from the start.
* Prefixes. In one order of all shingles, two sets that link share at least l of their first
  s - ceil(3 s / 4) + l shingles, l being a tenth of the size. Sets with too few shared shingles in that
  prefix have no link; of the others, the rarest shared shingles but for l - 1 make the final prefix.
* Answers by relation. In rounds each set is compared with one leader of its lists that is not of its
  component. What is linked so has the leader's component as answer, and lists whose sets have all
  one component are skipped as wholes: no pair inside them can change the result.
* Differences. Two sets compared with one leader, of which one has no link to it, mostly can link only
  if they share shingles that the leader lacks. Such pairs meet by those shingles alone.
* Blocks. In the remaining lists, sets stand in blocks by size and by the position that the shingle has
  in them. Two blocks meet only if their sizes, positions and components leave a link possible; blocks
  that cannot are skipped as wholes, from their bounds alone.

The bounds are those of the similarity itself, so no link is lost. Shingles that are very common
come last in the order; which ones those are changes the cost, not the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discarded, documents, keyed, mapped, slices, table, written
from .components import components
from .shingles import mix, shingle_sets

#: Share of all shingles that estimates how common each is. A shingle is common with LEAST of them, and
#: with a COMMON-th of them all, so that there are no more than COMMON such shingles; each part that the
#: list of one is dealt into, while shared shingles are sought, holds about PART times less than that.
SHARE, LEAST, COMMON, PART = 64, 16, 50_000, 8
COMMON_COUNT = 1 << 40
#: Rounds of leaders at most, and the share of its pairs that a round has to link for another to follow.
ROUNDS, WORTH = 8, 0.2
#: Sets that are compared with one copy of a leader's set.
AT_ONCE = 500
#: Size classes of blocks have this ratio; position classes are so many to a whole size.
SIZE_RATIO, POSITIONS = 8 / 7, 14


def shared_least(size):
    """Least shingles that two linked sets share in their first prefixes; size is that of the smaller."""
    return np.maximum(1, size // 10)


def first_prefix(size):
    return size - (3 * size + 3) // 4 + shared_least(size)


def signed(h: np.ndarray):
    return h.view(np.int64)


def set_id(members: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def sizes(rows: DataFrame) -> DataFrame:
    """key, doc_id, n_shingles and the id of its set (with the size, equal for equal sets only)."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], ["key", "doc_id", "n_shingles", "sid"])

    return mapped(rows, of, "key long, doc_id long, n_shingles long, sid long")


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of very common shingles and the number of parts of each; an order, never a filter."""

    def some(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                for key, s in zip(part.column("key").to_pylist(), shingle_sets(part.column("text"))):
                    s = s[mix(s ^ mix(np.array([key], dtype=np.int64).view(np.uint64))) % np.uint64(SHARE) == 0]
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array(signed(s))], ["h"])

    counts = written(mapped(rows, some, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1), "common")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(LEAST, total / COMMON)
    found = {r["h"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}  # COMMON rows at most
    discarded(counts)
    h = np.sort(np.array(list(found), dtype=np.int64).view(np.uint64))
    return h, np.array([-(-PART * found[x] // least) for x in signed(h).tolist()], dtype=np.int64)


def in_order(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set in the order of all shingles, and the number of parts of each, 0 if not common."""
    last, parts = common
    if not len(last):
        return s, np.zeros(len(s), dtype=np.int64)
    at = np.searchsorted(last, s).clip(max=len(last) - 1)
    often = last[at] == s
    return np.concatenate([s[~often], s[often]]), np.concatenate([np.zeros(len(s) - often.sum(), dtype=np.int64), parts[at[often]]])


def prefix_rows(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h, salt, sid for the first prefix of every set; salt is above 0 for common shingles only."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def prefixes(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                hs, salts, sids = [], [], []
                done = set()
                for s in shingle_sets(part.column("text")):
                    n = len(s)
                    if not n or (sid := set_id(s)) in done:
                        continue
                    done.add(sid)
                    s, parts = in_order(s, shared.value)
                    p = int(first_prefix(n))
                    hs.append(s[:p])
                    salts.append(np.where(parts[:p] > 0, 1 + (sid & 0x7FFFFFFF) % np.maximum(parts[:p], 1), 0).astype(np.int32))
                    sids.append(np.full(min(p, n), sid, dtype=np.int64))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hs))), pa.array(np.concatenate(salts)), pa.array(np.concatenate(sids))], ["h", "salt", "sid"])

    return mapped(rows, prefixes, "h long, salt int, sid long")


def final_prefixes(found: DataFrame, sets: DataFrame) -> DataFrame:
    """sid, key, size, c (shared shingles), least, prefix (the shingles of the final prefix) of sets that may link."""
    of = Window.partitionBy("h", "salt")
    counted = found.select("h", "sid", F.when(F.col("salt") > 0, F.lit(COMMON_COUNT)).otherwise(F.count("*").over(of)).alias("df"), ((F.col("salt") > 0) | (F.min("sid").over(of) < F.max("sid").over(of))).alias("shared"))
    least = F.greatest(F.lit(1).cast("long"), F.floor(F.floor((3 * F.col("size") + 3) / 4) / 10))
    # The shingles of one set make one list.
    by_set = counted.where("shared").groupBy("sid").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("all"))
    kept = by_set.join(sets.select("sid", "key", F.col("n_shingles").alias("size")), "sid").select("sid", "key", "size", "all", F.size("all").cast("long").alias("c"), least.alias("least")).where("c >= least")
    return kept.select("sid", "key", "size", "c", "least", F.transform(F.slice("all", F.lit(1), (F.col("c") - F.col("least") + 1).cast("int")), lambda x: x["h"]).alias("prefix"))


def indexed(prefixes: DataFrame, rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """sid, size, c, least, members (ascending), index: for each shingle of the final prefix its place
    there (pos) and in the whole set (at)."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 500_000):
                members, index = [], []
                for s, prefix in zip(shingle_sets(part.column("text")), part.column("prefix").to_pylist()):
                    ordered, _ = in_order(s, shared.value)
                    by = np.argsort(ordered, kind="stable")
                    at = by[np.searchsorted(ordered[by], np.array(prefix, dtype=np.int64).view(np.uint64))]
                    members.append(signed(s))
                    index.append([{"h": h, "pos": i, "at": a} for i, (h, a) in enumerate(zip(prefix, at.tolist()))])
                item = pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("at", pa.int64())])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("sid", "size", "c", "least")), pa.array(members, pa.list_(pa.int64())), pa.array(index, pa.list_(item))], ["sid", "size", "c", "least", "members", "index"])

    return mapped(rows.select("key", "text").join(prefixes, "key"), look, "sid long, size long, c long, least long, members array<long>, index array<struct<h:long,pos:long,at:long>>")


def compared(pairs: DataFrame, sets: DataFrame, novel: bool = False) -> DataFrame:
    """For pairs (a, b) of set ids: size_a, size_b, both (shingles in common), by their whole sets; with
    novel also the shingles of a that are not in b.

    Pairs of one b meet in parts of about AT_ONCE, each of which gets the set of b once.
    """

    def test(batches):
        import pyarrow as pa

        leader = None
        for batch in batches:
            out = []
            for role, a, b, x in zip(*(batch.column(c).to_pylist() for c in ("role", "sid", "b")), _arrays(batch.column("members"))):
                if role == 0:
                    leader = x.copy()
                    continue
                own = np.searchsorted(leader, x).clip(max=len(leader) - 1)
                own = leader[own] == x
                out.append((a, b, len(x), len(leader), int(own.sum()), signed(x[~own]) if novel else []))
            if out:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["a", "b", "size_a", "size_b", "both", "novel"])

    n = pairs.groupBy("b").agg(F.count("*").alias("n"))
    dealt = pairs.join(n, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / AT_ONCE)).alias("part"))
    asked = dealt.select(F.col("a").alias("sid"), "b", "part", F.lit(1).alias("role")).union(dealt.select(F.col("b").alias("sid"), "b", "part", F.lit(0).alias("role")).distinct())
    rows = asked.join(sets.select("sid", "members"), "sid").repartition("b", "part").sortWithinPartitions("b", "part", "role")
    return mapped(rows, test, "a long, b long, size_a long, size_b long, both long, novel array<long>")


def _arrays(column):
    """The arrays of a column of lists, as views. Members are in unsigned order and so stay unsigned."""
    values, at = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:]))


def linked(tests: DataFrame) -> DataFrame:
    """a, b of the compared() pairs that link."""
    return tests.where("100 * both >= 75 * (size_a + size_b - both)").select("a", "b")


def _surplus() -> Column:
    """For two sets compared with one leader: 14 times the novel shingles that they must have in common.

    Let each lack some of the leader's shingles and add novel ones. They differ in what they lack and add
    but for what is the same in both, and link if 7 times that difference is not above the sum of their
    sizes. What both lack is no more than the smaller lack; the rest must be novel shingles of both.
    """
    parts = F.col("lacks_a") + F.col("adds_a") + F.col("lacks_b") + F.col("adds_b")
    return 7 * parts - (F.col("size_a") + F.col("size_b")) - 14 * F.least("lacks_a", "lacks_b")


def block_of(size: Column, at: Column) -> Column:
    """Block of a set in a list: its size class and the class of the position that the shingle has in it."""
    return (F.floor(F.log(size.cast("double")) / float(np.log(SIZE_RATIO)) + 1e-9) * (POSITIONS + 1) + F.floor(POSITIONS * at / size)).cast("int")


def meeting(lists: DataFrame) -> DataFrame:
    """Pairs of list rows of different components whose sizes and positions allow a link: every column
    of lists (h, sid, size, at, component, ...) as _a and _b, b not larger than a.

    First blocks meet, by their bounds; rows follow only where their blocks do. A list has no more blocks
    than there are classes, whatever the number of its rows.
    """
    rows = lists.withColumn("block", block_of(F.col("size"), F.col("at")))
    bounds = rows.groupBy("h", "block").agg(*(f(c).alias(f"{n}_{c}") for c in ("size", "at", "component") for n, f in (("least", F.min), ("most", F.max))))
    of = lambda side: bounds.select("h", *(F.col(c).alias(f"{c}_{side}") for c in bounds.columns if c != "h"))
    c = F.col
    # Shared shingles stand before the common one, at most as many as the smaller position, or behind it.
    behind = lambda size, at: size - at
    possible = F.least("most_at_a", "most_at_b") + F.least(behind(c("most_size_a"), c("least_at_a")), behind(c("most_size_b"), c("least_at_b")))
    may = (c("most_size_a") >= c("least_size_b")) & (4 * c("most_size_b") >= 3 * c("least_size_a")) & (7 * possible >= 3 * (c("least_size_a") + c("least_size_b")))
    several = (F.least("least_component_a", "least_component_b") < F.greatest("most_component_a", "most_component_b"))
    blocks = of("a").join(of("b"), "h").where(may & several).select("h", "block_a", "block_b")
    side = lambda s: rows.select("h", *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "h"))
    met = blocks.join(side("a"), ["h", "block_a"]).join(side("b"), ["h", "block_b"])
    # Of two of one size the one with the smaller id is b.
    ordered = (c("size_b") < c("size_a")) | ((c("size_b") == c("size_a")) & (c("sid_b") < c("sid_a")))
    possible = F.least("at_a", "at_b") + F.least(behind(c("size_a"), c("at_a")), behind(c("size_b"), c("at_b")))
    return met.where((c("component_a") != c("component_b")) & ordered & (4 * c("size_b") >= 3 * c("size_a")) & (7 * possible >= 3 * (c("size_a") + c("size_b"))))


def with_leaders(lists: DataFrame, star: DataFrame | None, k: int) -> DataFrame:
    """The rows of lists whose sets are of several components, with the component of each set and the
    leader of each list: (sid, component).

    In the first round that is the set with the largest share of shared shingles, which stands in the
    middle of its near copies; then some member of the largest component.
    """
    if star is None:
        named, order = lists.withColumn("component", F.col("sid")), F.struct("share", "sid")
    else:
        named = lists.join(star, "sid", "left").withColumn("component", F.coalesce("component", "sid")).withColumn("members", F.coalesce("members", F.lit(1)))
        order = F.struct("members", F.xxhash64("sid", F.lit(k)))
    leaders = named.groupBy("h").agg(F.min("component").alias("_least"), F.max("component").alias("_most"), F.max_by(F.struct("sid", "component"), order).alias("leader")).where("_least < _most").select("h", "leader")
    return named.join(leaders, "h").select(*lists.columns, "component", "leader")


def without_known(pairs: DataFrame, tests: list[DataFrame]) -> DataFrame:
    """Different pairs a > b that none of the tests have."""
    out = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for t in tests:
        out = out.join(t.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    return out


def set_components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sizes() of all keyed() rows, and sid, component for the sets that have a link."""
    all_sizes = written(sizes(rows), "sizes")
    first = all_sizes.where("n_shingles > 0").groupBy("sid", "n_shingles").agg(F.min("key").alias("key"))
    common = common_shingles(rows)
    sets = written(indexed(final_prefixes(prefix_rows(rows, common), first), rows, common), "sets")
    # behind: shared shingles from this one on.
    lists = sets.select("sid", "size", "c", (F.col("c") / F.col("size")).alias("share"), F.explode("index").alias("x")).select("x.h", "sid", "size", "x.at", (F.col("c") - F.col("x.pos")).alias("behind"), "share")

    # Lists whose sets have come to be of one component are left behind from round to round.
    star, tests, kept = None, [], None
    for k in range(ROUNDS):
        now = written(with_leaders(lists if kept is None else kept.select(*lists.columns), star, k), "lists")
        discarded(kept)
        kept = now
        asks = kept.where(F.col("component") != F.col("leader.component")).groupBy("sid", F.col("leader.sid").alias("leader")).agg(F.count("*").alias("n"))
        pairs = written(asks.groupBy("sid").agg(F.max_by("leader", F.struct("n", "leader")).alias("b")).select(F.col("sid").alias("a"), "b"), "pairs")
        tests.append(written(compared(pairs, sets, novel=k == 0), "tests"))
        discarded(pairs)
        links = written(linked(tests[-1]), "linked")
        n_pairs, n_links = tests[-1].count(), links.count()
        found = components(links if star is None else links.union(star.select(F.col("sid").alias("a"), F.col("component").alias("b")))).select(F.col("node").alias("sid"), "component")
        found = found.join(found.groupBy("component").agg(F.count("*").cast("int").alias("members")), "component").select("sid", "component", "members")
        found = written(found, "star")
        discarded(links, star)
        star = found
        if n_links < WORTH * n_pairs or not n_links:
            break

    by_leader = tests[0].select(F.col("a").alias("sid"), F.col("b").alias("leader"), (F.col("size_b") - F.col("both")).alias("lacks"), (F.col("size_a") - F.col("both")).alias("adds"))
    left = written(with_leaders(kept.select(*lists.columns), star, ROUNDS).drop("leader", "share").join(by_leader, "sid", "left"), "left")
    enough = F.least("behind_a", "behind_b") >= F.greatest(*(F.greatest(F.lit(1), F.floor(F.floor((3 * F.col(s) + 3) / 4) / 10)) for s in ("size_a", "size_b")))
    # Pairs under one leader that have to share novel shingles meet by these instead, in lists of their
    # own in which a shingle has no position.
    elsewhere = F.coalesce((F.col("leader_a") == F.col("leader_b")) & (_surplus() > 0), F.lit(False))
    met = meeting(left).where(enough & ~elsewhere).select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b"))
    novel = tests[0].select(F.explode("novel").alias("h"), F.col("b").alias("leader"), F.col("a").alias("sid"), F.col("size_a").alias("size")).select(F.xxhash64("leader", "h").alias("h"), "sid", "size", F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("share"))
    novel = written(with_leaders(novel, star, ROUNDS).drop("leader", "share").join(by_leader, "sid"), "novel")
    share = meeting(novel).where((F.col("leader_a") == F.col("leader_b")) & (_surplus() > 0)).groupBy(F.greatest("sid_a", "sid_b").alias("a"), F.least("sid_a", "sid_b").alias("b")).agg(F.count("*").alias("n"), F.max(_surplus()).alias("surplus")).where("14 * n >= surplus").select("a", "b")

    further = written(without_known(met.union(share), tests), "further")
    across = written(linked(compared(further, sets)), "linked")
    discarded(kept, left, novel, further, *tests, sets)
    found = written(components(star.select(F.col("sid").alias("a"), F.col("component").alias("b")).union(across)).select(F.col("node").alias("sid"), "component"), "components")
    discarded(star, across)
    return all_sizes, found


def _named(rows: DataFrame) -> DataFrame:
    """key, doc_id, n_shingles, component_id, component_key (the least key) for every one of keyed() rows."""
    all_sizes, found = set_components(rows)
    # Equal sets first, then components: each step combines before it shuffles. Written, so that the
    # joins with it are plain ones that Spark splits where an id is hot.
    by_set = written(all_sizes.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("component_id"), F.min("key").alias("component_key")), "least-of-sets")
    lowest = written(found.join(by_set, "sid").groupBy("component").agg(F.min("component_id").alias("component_id"), F.min("component_key").alias("component_key")), "least")
    named = written(found.join(lowest, "component").select("sid", "component_id", "component_key").union(by_set.join(found, "sid", "left_anti").select("sid", "component_id", "component_key")), "named-sets")
    discarded(by_set, lowest, found)
    full = all_sizes.where("n_shingles > 0").join(named, "sid").select("key", "doc_id", "n_shingles", "component_id", "component_key")
    return full.union(all_sizes.where("n_shingles = 0").select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("key").alias("component_key")))


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Without words or with null text: n_shingles 0, a component of its own. Equal rows are linked.
    A null doc_id is never the id of a component that has another. Other columns are not read.
    """
    return _named(keyed(documents(docs), "key")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; all columns stay.

    Of rows that repeat this doc_id the first stays, in the order of keyed(); a row without a doc_id
    stays only if no row of its component has one. Rows without words all stay.
    """
    rows = keyed(docs, "_row")
    found = _named(documents(rows, F.col("_row").alias("key")))
    gone = found.where("key <> component_key").select(F.col("key").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


# DuckDB: overlaps of all sets that share a shingle, then labels that spread along the links.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
reach AS (
  SELECT a, a AS b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT reach.a AS r, min(doc_id) AS c FROM reach JOIN w ON w.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM w LEFT JOIN n USING (r) LEFT JOIN lowest USING (r)
"""
