"""Packing of tokenised documents into sequences: dominance reduction, then best fit.

Lengths are small integers, so the packing is planned over the histogram of lengths: at most
`capacity` counts, whatever the number of documents. The plan says how many sequences hold which
lengths at which offsets; documents take their places by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import documents, mapped, slices, table, written

CAPACITY = 1024
END = 2


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that Martello and Toth's dominance fixes, and the lengths that remain.

    For a length a with room r beside it, the largest available b <= r dominates every other company
    of a, if no sum of available lengths lies in (b, r]: what else stood beside a could change places
    with b. Then a and b are fixed together, as often as both are there; a alone, if nothing fits.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: list[tuple[tuple[int, ...], int]] = []
    changed = True
    while changed:
        changed = False
        for a in sorted(left, reverse=True):
            while left.get(a):
                room = capacity - a
                b = max((n for n in left if n <= room and (n != a or left[a] > 1)), default=0)
                if b and b < room:
                    sums, within = 1, (1 << (room + 1)) - 1
                    for n in left:
                        if n <= room:
                            grown = sums
                            while (more := (grown | grown << n) & within) != grown:
                                grown = more
                            sums = grown
                    if sums >> (b + 1):
                        break
                times = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
                fixed.append(((a, b) if b else (a,), times))
                for n in (a, b) if b else (a,):
                    left[n] -= times
                left = {n: c for n, c in left.items() if c}
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for many equal lengths at once: (lengths of a sequence, how many such)."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by the room that is left
    for n in sorted(counts, reverse=True):
        todo = counts[n]
        for room in sorted(r for r in open_ if r >= n):
            if not todo:
                break
            groups, open_[room] = open_[room], []
            for pattern, times in groups:
                full, some = divmod(min(todo, times * (room // n)), room // n)
                if full:
                    open_[room - n * (room // n)].append((pattern + (n,) * (room // n), full))
                if some:
                    open_[room - n * some].append((pattern + (n,) * some, 1))
                if rest := times - full - bool(some):
                    open_[room].append((pattern, rest))
                todo -= full * (room // n) + some
        if todo:
            full, some = divmod(todo, capacity // n)
            if full:
                open_[capacity - n * (capacity // n)].append(((n,) * (capacity // n), full))
            if some:
                open_[capacity - n * some].append(((n,) * some, 1))
    return [g for groups in open_.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ascending first ranks, and for each the first sequence and the offset in it.

    From one first rank to the next, ranks and sequences rise together.
    """
    fixed, left = reduced(counts, capacity)
    taken: dict[int, int] = defaultdict(int)
    places = defaultdict(list)
    sequence = 0
    for pattern, times in [*fixed, *best_fit(left, capacity)]:
        at = 0
        for n in pattern:
            places[n].append((taken[n], sequence, at))
            taken[n] += times
            at += n
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for n, rows in places.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each document, with its rank among the pieces of its length in its task.

    Null text: the end id alone. Rows of one doc_id, and rows without one, are documents each of their
    own. The rows are written once, so ranks stay as they are.
    """

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 4_000_000):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), Encoder.of(tokenizer, True).encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += last
                    total = len(ids) // 4
                    start, length, k = 0, (total - 1) % capacity + 1, 0
                    while start < total:
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                        seen[length] += 1
                        start, length, k = start + length, capacity, k + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return written(mapped(documents(docs), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"), "pieces")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces()."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length):
                own = length == n
                first, seq, at = places.value[int(n)]
                k = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = seq[k] + rank[own] - first[k], at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = cut.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), byte_tokenizer()))
