"""Removal of repeated passages: every byte inside a 100-byte string that also starts earlier.

A longest-previous-factor array says for each position how long a string starts there that also starts
earlier. It follows from the suffix order: of all earlier positions, the one with the longest string in
common is the nearest smaller position before it or behind it in that order. Bytes go where the array
reaches 100, so suffixes are ordered by their first 100 bytes, ties by position.

One order of a whole corpus does not fit a task, so suffixes are dealt by content. The bucket of a
100-byte window is the smallest hashed 24-byte string in it, so that equal windows share a bucket
wherever they stand, and windows in a row with one bucket form a block. Equal blocks are named first, as
in prefix-free parsing: in each bucket the first of equal blocks stays, later copies are repeats as
wholes. The array is then computed over the windows of all different blocks of each bucket.

Buckets are not alike. Their sizes are estimated from one block in 64 of all texts; copies in frequent
buckets meet within salted parts first. Windows of buckets with very many different blocks are dealt
once more, each by its own content, so that equal ones still meet in one array.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, discarded, documents, keyed, mapped, slices, table, written
from .shingles import _BYTE, mix, powers

LENGTH, GRAM = 100, 24
#: Windows whose hashes are computed at once; a longer text is cut there, and blocks with it.
PIECE = 1 << 18
#: Share of blocks that estimate the sizes of buckets. A bucket is frequent with LEAST of them, and with
#: a FREQUENT-th of them all, so that there are no more than FREQUENT such buckets; a salted part of one
#: holds about PART times less than that.
SHARE, LEAST, FREQUENT, PART = 64, 16, 50_000, 8
#: Different blocks of one bucket that make one array as they are; with more, windows are dealt by content.
BUCKET_BLOCKS, WINDOW_PARTS = 10_000, 1 << 20
#: Bytes of blocks whose arrays are computed at once, whole buckets each.
CHUNK = 600_000


def nearest_smaller(order: np.ndarray) -> np.ndarray:
    """For each place of the order the nearest place before it with a smaller value, -1 if there is none.

    Each place starts at its neighbour and jumps to where that one points, as long as values are larger.
    """
    before = np.arange(-1, len(order) - 1)
    open_ = np.flatnonzero(before >= 0)
    open_ = open_[order[before[open_]] > order[open_]]
    while len(open_):
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
        open_ = open_[order[before[open_]] > order[open_]]
    return before


def _in_common(windows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes in common at the start of rows a and b, 0 where b is -1."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(0, len(a), 20_000):
        own = np.flatnonzero(b[k : k + 20_000] >= 0) + k
        differ = windows[a[own]] != windows[b[own]]
        first = differ.argmax(1)
        out[own] = np.where(differ[np.arange(len(own)), first], first, windows.shape[1])
    return out


def longest_previous_factors(windows: np.ndarray) -> np.ndarray:
    """The array of suffixes that are cut to the width of the rows; rows stand by position."""
    width = windows.shape[1]
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{width}").ravel(), kind="stable")
    factors = np.zeros(len(order), dtype=np.int64)
    before = nearest_smaller(order)
    after = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    for near in (before, np.where(after < len(order), after, -1)):
        other = np.where(near >= 0, order[near], -1)
        factors[order] = np.maximum(factors[order], _in_common(windows, order, other))
    return factors


def _blocks(column) -> tuple[np.ndarray, ...]:
    """For all blocks of the texts: number of the text, first window, last window (in the text), bucket, name."""
    data, at = bytes_of(column)
    found = []
    a = 0
    while a < len(data):
        b = a + PIECE
        edge = int(at[np.searchsorted(at, b, "right") - 1])
        b = len(data) if b >= len(data) else edge if edge > a else b
        if (own := _blocks_between(data, at, a, b)) is not None:
            found.append(own)
        a = b
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _blocks_between(data: np.ndarray, at: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...] | None:
    """_blocks() of the windows that start from a to before b."""
    x = data[a : b + LENGTH - 1]
    n = min(b - a, len(x) - LENGTH + 1)
    if n <= 0:
        return None
    power, inverse = powers(len(x) + 1)
    running = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[x] * power[: len(x)], out=running[1:])
    grams = mix((running[GRAM:] - running[:-GRAM]) * inverse[: len(x) - GRAM + 1])
    least, place, width = grams, np.arange(len(grams), dtype=np.int32), 1
    full = LENGTH - GRAM + 1
    while width < full:
        step = min(width, full - width)
        later = least[step:] < least[:-step]
        least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    texts = np.searchsorted(at, [a, b], "right") - 1
    edges = np.clip(at[texts[0] : texts[1] + 2] - a, 0, n)
    text = np.repeat(np.arange(texts[0], texts[0] + len(edges) - 1), np.diff(edges))
    valid = np.arange(a + LENGTH, a + LENGTH + n) <= at[text + 1]
    turns = place[1:n] != place[: n - 1]
    first = np.flatnonzero(valid & np.concatenate([[True], turns | ~valid[: n - 1]]))
    last = np.flatnonzero(valid & np.concatenate([turns | ~valid[1:n], [True]]))
    if not len(first):
        return None
    name = mix((running[last + LENGTH] - running[first]) * inverse[first] + (last - first).astype(np.uint64))
    offset = a - at[text[first]]
    return text[first], first + offset, last + offset, least[first].view(np.int64), name.view(np.int64)


def _dealt(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the place of each block."""
    return mix(key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64))


def frequent_buckets(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending frequent buckets and the number of parts of each; only how they are dealt depends on it."""

    def some(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                text, first, _, h, _ = _blocks(part.column("text"))
                key = part.column("key").to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays([pa.array(h[_dealt(key, first) % np.uint64(SHARE) == 0])], ["h"])

    counts = written(mapped(rows, some, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1), "frequent")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(LEAST, total / FREQUENT)
    found = {r["h"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}  # FREQUENT rows at most
    discarded(counts)
    h = np.sort(np.array(list(found), dtype=np.int64))
    return h, np.array([-(-PART * found[x] // least) for x in h.tolist()], dtype=np.int64)


def blocks(rows: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """h (bucket), salt (above 0 in frequent ones), g (name), key, first, last window of each block."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def each(batches):
        import pyarrow as pa

        hot, parts = shared.value
        for batch in batches:
            for part in slices(batch):
                text, first, last, h, g = _blocks(part.column("text"))
                key = part.column("key").to_numpy(zero_copy_only=False)[text]
                salt = np.zeros(len(h), dtype=np.int32)
                if len(hot) and len(h):
                    k = np.searchsorted(hot, h).clip(max=len(hot) - 1)
                    salt = np.where(hot[k] == h, 1 + (_dealt(key, first) >> np.uint64(8)) % parts[k].astype(np.uint64), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(salt), pa.array(g), pa.array(key.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["h", "salt", "g", "key", "first", "last"])

    return mapped(rows, each, "h long, salt int, g long, key long, first int, last int")


def marked(found: DataFrame) -> DataFrame:
    """Blocks that matter, with later (an equal block starts earlier) or else to be compared in their bucket.

    Copies meet within their part first; what is first there meets across the parts.
    """
    place = ["key", "first"]
    # One order serves both windows.
    part = Window.partitionBy("h", "salt").orderBy("g", *place).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = found.withColumn("differs", (F.col("salt") > 0) | (F.min("g").over(part) < F.max("g").over(part))).withColumn("k", F.row_number().over(Window.partitionBy("h", "salt", "g").orderBy(*place)))
    one = written(one.where("differs OR k > 1").select("h", "salt", "g", *place, "last", (F.col("k") > 1).alias("later")), "marked-in-part")
    settled = one.where("salt = 0 OR later").select("h", *place, "last", "later")
    across = one.where("salt > 0 AND NOT later").withColumn("k", F.row_number().over(Window.partitionBy("h", "g").orderBy(*place)))
    out = written(settled.union(across.select("h", *place, "last", (F.col("k") > 1).alias("later"))), "marked")
    discarded(one)
    return out


def with_bytes(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """h, part, key, first, data: the bytes of the wanted blocks (h, wide, key, first, last).

    Of wide ones each window is a row of its own, with the hash of its bytes as part.
    """

    def cut(batches):
        import pyarrow as pa

        names = ["h", "part", "key", "first", "data"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for run in slices(batch, 500_000):
                data, at = bytes_of(run.column("text"))
                data, out, size = data.tobytes(), [], 0
                for a, key, own in zip(at.tolist(), run.column("key").to_pylist(), run.column("own").to_pylist()):
                    for b in own:
                        spans = ((p, p) for p in range(b["first"], b["last"] + 1)) if b["wide"] else ((b["first"], b["last"]),)
                        for first, last in spans:
                            x = data[a + first : a + last + LENGTH]
                            out.append((b["h"], int.from_bytes(hashlib.blake2b(x, digest_size=4).digest(), "little") % WINDOW_PARTS + 1 if b["wide"] else 0, key, first, x))
                            size += len(x)
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    # The blocks of one text make one list.
    own = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "wide", "first", "last")).alias("own"))
    return mapped(rows.select("key", "text").join(own, "key"), cut, "h long, part int, key long, first int, data binary")


def _spans(key: np.ndarray, first: np.ndarray, seen: np.ndarray, owner: np.ndarray, window: np.ndarray):
    """key, start, end of the runs of seen windows; owner is the block of each window."""
    import pyarrow as pa

    joint = np.concatenate([[False], (owner[1:] == owner[:-1]) & seen[:-1]])
    starts = np.flatnonzero(seen & ~joint)
    follows = np.concatenate([joint[1:] & seen[1:], [False]])
    ends = np.flatnonzero(seen & ~follows)
    own = owner[starts]
    return pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array((first[own] + window[starts]).astype(np.int64)), pa.array((first[own] + window[ends] + LENGTH).astype(np.int64))], ["key", "start", "end"])


def _repeats_of(batch):
    """key, start, end of the windows of whole buckets whose factor reaches LENGTH."""
    import pyarrow as pa

    key, first = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "first"))
    _, offsets, data = batch.column("data").buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[batch.column("data").offset :][: batch.num_rows + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)
    by = np.lexsort((first, key))
    key, first, start = key[by], first[by], at[:-1][by]
    n = np.diff(at)[by] - LENGTH + 1
    owner = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[np.repeat(start, n) + window]
    return _spans(key, first, longest_previous_factors(windows) >= LENGTH, owner, window)


def compared(found: DataFrame) -> DataFrame:
    """key, start, end of windows that an earlier block of their bucket has."""

    def compare(batches):
        import pyarrow as pa

        pending = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if pending is None else [pending, batch]).combine_chunks().to_batches()[0]
            h, part = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("h", "part"))
            groups = np.concatenate([[0], np.flatnonzero((h[1:] != h[:-1]) | (part[1:] != part[:-1])) + 1])
            at = np.frombuffer(rows.column("data").buffers()[1], dtype=np.int32)[rows.column("data").offset :][: rows.num_rows + 1]
            cell = (at[groups] - at[0]) // CHUNK
            cuts = [0, *groups[np.flatnonzero(np.diff(cell)) + 1].tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield _repeats_of(rows.slice(a, b - a))
            pending = rows.slice(cuts[-1])
        if pending is not None:
            yield _repeats_of(pending)

    return mapped(found.repartition("h", "part").sortWithinPartitions("h", "part"), compare, "key long, start long, end long")


def repeated(rows: DataFrame, bucket_blocks: int = BUCKET_BLOCKS) -> DataFrame:
    """key, start, end: byte spans of keyed() rows that repeat earlier ones; spans of a row may overlap."""
    found = marked(blocks(rows, frequent_buckets(rows)))
    later = found.where("later").select("key", F.col("first").cast("long").alias("start"), (F.col("last") + LENGTH).cast("long").alias("end"))
    open_ = found.where("NOT later").select("h", "key", "first", "last")
    large = written(open_.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > bucket_blocks).select("h", F.lit(True).alias("wide")), "large")
    wanted = open_.join(large, "h", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    out = written(later.union(compared(with_bytes(wanted, rows))), "spans")
    discarded(found, large)
    return out


def removed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each of rows."""

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for run in slices(batch):
                data, at = bytes_of(run.column("text"))
                data, out = data.tobytes(), []
                for k, (doc_id, own) in enumerate(zip(run.column("doc_id").to_pylist(), run.column("own").to_pylist())):
                    text, kept, end, gone, n = data[at[k] : at[k + 1]], hashlib.sha256(), 0, 0, 0
                    for s in sorted((s["start"], s["end"]) for s in own or []):
                        a, b = max(s[0], end), min(s[1], len(text))
                        if b <= end:
                            continue
                        if a > end or n == 0:
                            kept.update(text[end:a])
                            n += 1
                        gone += b - a
                        end = b
                    kept.update(text[end:])
                    out.append((doc_id, len(text), gone, n, kept.hexdigest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # The spans of one text make one list.
    own = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    return mapped(rows.join(own, "key", "left"), cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, bucket_blocks: int = BUCKET_BLOCKS) -> DataFrame:
    """Every document with what is removed of it. Earlier is a smaller doc_id, or an earlier start.

    Null text is empty; texts under 100 bytes stay whole. Of rows with one doc_id the first keeps its
    passages, in the order of keyed(); rows without a doc_id come after all others. Other columns are
    not read.
    """
    rows = keyed(documents(docs), "key")
    return removed(rows, repeated(rows, bucket_blocks))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
