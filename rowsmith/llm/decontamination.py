"""Benchmark decontamination by a generalised suffix automaton over the words of test items.

The automaton of all items accepts every run of consecutive item words. Document words stream
through it; the longest match that ends at each word tells whether a window of an item ends there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keyed, mapped, slices, table, with_n_chars, written

WINDOW = 10
#: Bytes of the items of one automaton, about; more items go in further blocks, one after another.
BLOCK_BYTES = 500_000
#: Share of a document's words inside hits above which the whole document goes, instead of the spans.
MOST_HIT = 0.8

# A-Z lower-cased; ASCII other than letters and digits becomes a blank; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, and what occurs at each of its states."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, words in items:
            if words:
                sequences.append((item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.shortest = min((min(len(ids), window) for _, ids in sequences), default=window)
        self._mark(sequences)

    def _extend(self, last: int, w: int) -> int:
        """Appends a word to the sequence that ends in state last; returns the state of its end."""
        def split(p: int, q: int) -> int:
            """A state for the shorter strings of q, those that p reaches by w."""
            copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = copy
            while p >= 0 and self.next[p].get(w) == q:
                self.next[p][w] = copy
                p = self.link[p]
            return copy

        if (q := self.next[last].get(w)) is not None:  # an earlier item holds this string already
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return new

    def _state(self, length: int, link: int, transitions: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(transitions)
        return len(self.link) - 1

    def _mark(self, sequences: list[tuple[int | None, list[int]]]) -> None:
        """at[v]: the state of the window that ends a long match at v; items: those that hold a window;
        short[v]: (words, item) of the items under a window's length that end a match at v."""
        n, k = len(self.link), self.window
        self.items: dict[int, set] = {}
        own_short: dict[int, list[tuple[int, int | None]]] = {}
        up = list(range(n))
        for v in sorted(range(1, n), key=self.length.__getitem__):
            parent = self.link[v]
            if self.length[parent] >= k:
                up[v] = up[parent]
        self.at = up
        for item, ids in sequences:
            v, length = 0, 0
            for w in ids:
                v, length = self.next[v][w], length + 1
                if length >= k:
                    self.items.setdefault(up[v], set()).add(item)
            if length < k:
                own_short.setdefault(v, []).append((length, item))
        self.short: dict[int, list[tuple[int, int | None]]] = {}
        if own_short:
            for v in sorted(range(1, n), key=self.length.__getitem__):
                if all_ := own_short.get(v, []) + self.short.get(self.link[v], []):
                    self.short[v] = all_

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged ranges [first, last] of words inside windows, and the items that own these windows."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        ranges: list[list[int]] = []
        items: set = set()
        nxt, link, length, at, short, k = self.next, self.link, self.length, self.at, self.short, self.window
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a < self.shortest:
                continue
            v = l = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while v and w not in nxt[v]:
                    v = link[v]
                    l = length[v]
                v = nxt[v].get(w, 0)
                l = l + 1 if v else 0
                first = i + 1
                if l >= k:
                    first = i - l + 1
                    items |= self.items.get(at[v], set())
                if v in short:
                    for n, item in short[v]:
                        if n <= l:
                            items.add(item)
                            first = min(first, i - n + 1)
                if first <= i:
                    while ranges and ranges[-1][1] >= first - 1:
                        first = min(first, ranges.pop()[0])
                    ranges.append([first, i])
        return ranges, items


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """item_id, text, block of the items, and the number of blocks; items go to blocks by their hash."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n = -(-(items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // block_bytes) or 1
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")), n


def automaton(items: DataFrame, block: int, window: int = WINDOW) -> Broadcast:
    """The automaton of one block of items, for all tasks."""
    rows = items.where(F.col("block") == block).select("item_id", "text").collect()  # about BLOCK_BYTES
    return items.sparkSession.sparkContext.broadcast(Automaton([(r["item_id"], words_of(r["text"])) for r in rows], window))


def _cut(text: str, ranges: list[list[int]]) -> str:
    """The text without the hit words and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
    kept, at = [], 0
    for a, b in ranges:
        kept.append(data[at : places[a][0]])
        at = places[b][1]
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def _merged(ranges: list[list[int]]) -> list[list[int]]:
    """The union of ranges of words, ascending."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _scanned(rows: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, finish: Callable, schema) -> DataFrame:
    """finish(batch, words, ranges, items) for every batch of rows, over the hits of all blocks of items.

    Each block is a pass of its own over the texts, so that a task holds one automaton, whatever the
    number of items. All passes but the last write the hits that they find; the last one reads them.
    rows has doc_id and text.
    """
    items, n = item_blocks(benchmark, block_bytes)
    if n > 1:
        rows = keyed(rows, "_key")
    earlier = None
    for block in range(n - 1):
        found = automaton(items, block, window)

        def scan(batches, found=found):
            import pyarrow as pa

            for batch in batches:
                for part in slices(batch):
                    out = []
                    for key, text in zip(part.column("_key").to_pylist(), part.column("text").to_pylist()):
                        ranges, own = found.value.scan(words_of(text))
                        if ranges:
                            out.append((key, ranges, list(own)))
                    if out:
                        kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["_key", "_ranges", "_items"])

        hits = written(mapped(rows.select("_key", "text"), scan, "_key long, _ranges array<array<long>>, _items array<long>"), "hits")
        found.destroy()
        earlier = hits if earlier is None else earlier.union(hits)
    if earlier is None:
        rows = rows.withColumn("_ranges", F.lit(None).cast("array<array<long>>")).withColumn("_items", F.lit(None).cast("array<long>"))
    else:
        # The hits of one text make one list.
        rows = rows.join(earlier.groupBy("_key").agg(F.flatten(F.collect_list("_ranges")).alias("_ranges"), F.flatten(F.collect_list("_items")).alias("_items")), "_key", "left")
    last = automaton(items, n - 1, window)

    def end(batches):
        for batch in batches:
            for part in slices(batch):
                words, ranges, items = [], [], []
                for text, r, i in zip(*(part.column(c).to_pylist() for c in ("text", "_ranges", "_items"))):
                    own = words_of(text)
                    more, others = last.value.scan(own)
                    words.append(len(own))
                    ranges.append(_merged((r or []) + more))
                    items.append(others | set(i or ()))
                yield finish(part, words, ranges, items)

    return mapped(rows, end, schema)


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, ids of the items that occur.

    Every row of docs gives one row. Null or empty texts have no words; null or empty items match
    nothing; an item with null item_id marks words but is not listed. Items of one id count once.
    """

    def rows(part, words, ranges, items):
        import pyarrow as pa

        hit = [sum(b - a + 1 for a, b in r) for r in ranges]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(i - {None}) for i in items], pa.list_(pa.int64()))], ["doc_id", "n_words", "n_hit", "items"])

    return _scanned(documents(docs), benchmark, window, block_bytes, rows, "doc_id long, n_words long, n_hit long, items array<long>")


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_hit: float = MOST_HIT) -> DataFrame:
    """docs without the hit words and what stands between them; n_chars follows, if there is one.

    A document goes where more than most_hit of its words are hit. All other rows and columns stay.
    """
    names = docs.columns

    def rows(part, words, ranges, _):
        import pyarrow as pa

        part = part.select(names)
        at = part.schema.get_field_index("text")
        keep = [sum(b - a + 1 for a, b in r) <= most_hit * n for n, r in zip(words, ranges)]
        if any(r and k for r, k in zip(ranges, keep)):
            texts = [_cut(t, r) if r and k else t for t, r, k in zip(part.column(at).to_pylist(), ranges, keep)]
            part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
        return part.filter(pa.array(keep, pa.bool_()))

    return with_n_chars(_scanned(docs, benchmark, window, block_bytes, rows, docs.schema))


def item_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), item_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM grams),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
doc_grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hits AS (SELECT r, d.n, i, item_id FROM doc_grams d JOIN grams USING (n, g)),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""
