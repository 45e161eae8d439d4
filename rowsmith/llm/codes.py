"""Compression of vectors to codes: a codebook for each part of a vector, searched by equal averages.

Vectors become integers and are cut into equal parts. A part's nearest entry of its codebook is found
among entries sorted by the sum of their components: the search starts at the part's own sum and goes
outward, and ends where the squared gap of the sums over the dimension exceeds the best distance
strictly (no entry beyond can be nearer, by Cauchy and Schwarz; one that is as near may have a lower
index, so equal gaps are still looked at).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, mapped, table, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x).
SCALE = 256
#: Integer components below this, either way, keep squared sums and distances of vectors within a long.
LARGEST = 1 << 22
#: Labels, at most so many, whose sums are broadcast; beyond, Spark joins them by a shuffle.
FEW_LABELS = 100_000
#: Vectors that a task works on at a time.
RUN = 8192


class Codebooks:
    """entries: parts x entries x dimension, integers."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, size, self.dim = entries.shape
        sums = entries.sum(axis=2)
        # Stable: entries of one sum keep the order of their indexes.
        order = np.argsort(sums, axis=1, kind="stable")
        self.order = (order + np.arange(parts)[:, None] * size).ravel()
        self.sums = np.take_along_axis(sums, order, axis=1)
        self.flat = entries.reshape(parts * size, self.dim)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry for each part of each vector; of equally near ones the lowest."""
        n, (parts, size, dim) = len(vectors), self.entries.shape
        x = vectors.reshape(n * parts, dim)
        part = np.tile(np.arange(parts), n)
        total = x.sum(axis=1)
        # The first entry whose sum is not below the part's own; from there one side goes up, the other down.
        up = np.empty(n * parts, dtype=np.int64)
        for p in range(parts):
            up[p::parts] = np.searchsorted(self.sums[p], total[p::parts])
        down = up - 1
        best = np.full(n * parts, np.iinfo(np.int64).max)
        index = np.full(n * parts, size, dtype=np.int64)
        far = np.iinfo(np.int64).max
        sums = self.sums.ravel()
        live = np.arange(n * parts)
        while len(live):
            base = part[live] * size
            gap_up = np.where(up[live] < size, np.abs(sums[base + np.minimum(up[live], size - 1)] - total[live]), far)
            gap_down = np.where(down[live] >= 0, np.abs(total[live] - sums[base + np.maximum(down[live], 0)]), far)
            rises = gap_up <= gap_down
            gap = np.where(rises, gap_up, gap_down)
            # The squared gap over the dimension against the best distance, in integers.
            beyond = (gap == far) | ((best[live] != far) & (gap * gap > best[live] * dim))
            keep = ~beyond
            live, rises = live[keep], rises[keep]
            if not len(live):
                break
            at = np.where(rises, up[live], down[live])
            up[live[rises]] += 1
            down[live[~rises]] -= 1
            entry = self.order[part[live] * size + at]
            apart = ((x[live] - self.flat[entry]) ** 2).sum(axis=1)
            number = entry - part[live] * size
            better = (apart < best[live]) | ((apart == best[live]) & (number < index[live]))
            won = live[better]
            best[won], index[won] = apart[better], number[better]
        return index.reshape(n, parts), best.reshape(n, parts)


def _whole(x: Column) -> Column:
    return F.floor(x.cast("double") * SCALE)


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v, the integer components, of the rows whose vector and all its components are there and finite.

    v is null where a component is LARGEST or more, or where there are no components: such a vector has no code.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("label"))
    finite = e.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    fits = F.forall("x", lambda c: F.abs(c) < LARGEST / SCALE) & (F.size("x") > 0)
    return finite.select("vec_id", "label", F.when(fits, F.transform("x", _whole)).alias("v"))


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _first_entries(vectors: DataFrame, parts: int, size: int) -> tuple[int, np.ndarray]:
    """The dimension, and the codebooks that the first round starts from; 0 where there is no vector."""
    order = [F.asc_nulls_last("vec_id"), F.col("v")]
    some = vectors.where(F.col("v").isNotNull() & (F.size("v") % parts == 0))
    first = some.orderBy(*order).select(F.size("v").alias("n")).first()
    if first is None:
        return 0, np.empty((parts, 0, 0), dtype=np.int64)
    rows = some.where(F.size("v") == first["n"]).orderBy(*order).limit(size).select("v").collect()  # size rows
    start = np.array([r["v"] for r in rows], dtype=np.int64)
    return first["n"], np.ascontiguousarray(start.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries at the floored means of the parts that are nearest to them; unused ones stay.

    A task sends one row for each component of the codebooks at most; the driver gets as many.
    """
    parts, size, dim = books.shape

    def sums(batches):
        import pyarrow as pa

        own = Codebooks(books)
        total, count = np.zeros((parts, size, dim), dtype=np.int64), np.zeros((parts, size), dtype=np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, RUN):
                v = _matrix(batch.column("v").slice(a, RUN))
                index, _ = own.nearest(v)
                for p in range(parts):
                    np.add.at(total[p], index[:, p], v[:, p * dim : (p + 1) * dim])
                    count[p] += np.bincount(index[:, p], minlength=size)
        part, entry = np.nonzero(count)
        flat = np.repeat((part * size + entry) * dim, dim) + np.tile(np.arange(dim), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(total[part, entry].ravel()), pa.array(np.repeat(count[part, entry], dim))], ["at", "total", "n"])

    rows = mapped(vectors.select("v"), sums, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = books.copy().ravel()
    for r in rows:
        out[r["at"]] = r["total"] // r["n"]  # Python's division goes down for either sign
    return out.reshape(books.shape)


def coded(embeddings: DataFrame, parts: int = PARTS, size: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that is there and finite.

    The dimension is that of the smallest vec_id whose vector can be cut into the parts. Vectors of
    another dimension, and those with components beyond LARGEST, keep their row with a null code and
    error and add nothing to label_error. Rows of one vec_id, and rows without (which come last), are
    vectors of their own; where they begin a codebook they go by their components. Fewer vectors than
    entries: as many entries. No vector: no row. Further columns play no part.
    """
    vectors = integers(embeddings)
    n, books = _first_entries(vectors, parts, size)
    fits = F.coalesce(F.size("v") == n, F.lit(False)) if n else F.lit(False)
    for _ in range(rounds if n else 0):
        books = _moved(vectors.where(fits), books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def code(batches):
        import pyarrow as pa

        own = Codebooks(books) if n else None
        for batch in batches:
            for a in range(0, batch.num_rows, RUN):
                run = batch.slice(a, RUN)
                fit = np.flatnonzero(run.column("fits").to_numpy(zero_copy_only=False))
                codes, errors = [None] * run.num_rows, [None] * run.num_rows
                if len(fit):
                    index, apart = own.nearest(_matrix(run.column("v").take(pa.array(fit))))
                    for k, c, e in zip(fit.tolist(), index.astype(np.uint8), apart.sum(axis=1).tolist()):
                        codes[k], errors[k] = c.tobytes().hex(), e
                yield pa.RecordBatch.from_arrays([run.column("vec_id"), run.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = dict(vectors.dtypes)["label"]
    out = written(mapped(vectors.select("vec_id", "label", "v", fits.alias("fits")), code, f"vec_id long, label {kind}, code string, error long"), "codes")
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = written(sums, "label-errors")
    joined = out.alias("v").join(F.broadcast(few.alias("l")) if few.count() <= FEW_LABELS else few.alias("l"), F.col("v.label").eqNullSafe(F.col("l.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings"))


def _assigned(books: str, name: str) -> str:
    return f"""{name} AS (
  SELECT vec_id, part, arg_min(entry, dist * 64 + entry) AS entry, min(dist) AS dist
  FROM (SELECT x.vec_id, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c))::BIGINT AS dist FROM x JOIN {books} b ON x.part = b.part AND x.pos = b.pos GROUP BY x.vec_id, x.part, b.entry)
  GROUP BY vec_id, part)"""


def _moved_sql(books: str, near: str, name: str) -> str:
    return f"""{name} AS (
  SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c
  FROM {books} b LEFT JOIN (
    SELECT x.part, a.entry, x.pos, sum(x.c)::BIGINT AS s, count(*) AS n FROM x JOIN {near} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY x.part, a.entry, x.pos
  ) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS v, len(embedding) // 16 AS d FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (
  SELECT vec_id, (i - 1) // d AS part, (i - 1) % d AS pos, floor(256 * v[i]::DOUBLE)::BIGINT AS c
  FROM (SELECT vec_id, v, d, unnest(range(1, len(v) + 1)) AS i FROM kept)),
b0 AS (SELECT x.part, k.entry, x.pos, x.c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) k ON x.vec_id = k.vec_id),
{_assigned("b0", "a0")},
{_moved_sql("b0", "a0", "b1")},
{_assigned("b1", "a1")},
{_moved_sql("b1", "a1", "b2")},
{_assigned("b2", "a2")},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM kept k JOIN codes c ON k.vec_id = c.vec_id
"""
