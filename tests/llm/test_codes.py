import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm import codes

from .helpers import clashing

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def brute(rows, parts=16, size=64, rounds=2):
    """Every part against every entry."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * dim : (p + 1) * dim]
    books = [[cut(v, p) for _, v, _ in kept[:size]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(xs) for c in zip(*xs)] if xs else e for xs, e in zip(own, books[p])]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted((i is None, i or 0, c, e, total[label], digest) for i, c, e, label in out)


def got(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("n, wide, step", [(150, 32, 1 / 256), (150, 16, 1 / 64), (40, 64, 0.013), (1, 16, 1.0)])
def test_brute_force(spark, n, wide, step):
    """Coarse values, so that distances and sums tie; repeated ids and vectors, ids and labels that lack."""
    rng = random.Random(n + wide)
    rows = [(k if k % 9 else None, [rng.randrange(-6, 7) * step for _ in range(wide)], rng.choice([None, 1, 2])) for k in range(n)]
    rows += [(3, r[1], 1) for r in rows[:5]] + rows[:3]
    rows += [(-1, None, 1), (-2, [None] * wide, 1), (-3, [math.nan] * wide, 1), (-4, [math.inf] + [0.0] * (wide - 1), 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(codes.coded(df)) == brute(rows)
    assert got(codes.coded(clashing(df).withColumn("v", F.lit("x")).withColumn("fits", F.lit("y")).repartition(7))) == brute(rows)


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    for low, high, dim in ((-3, 4, 1), (-3, 4, 4), (-200, 200, 4), (-codes.LARGEST + 1, codes.LARGEST, 8)):
        books = rng.integers(low, high, (3, 64, dim))
        v = rng.integers(low, high, (500, 3 * dim))
        index, apart = codes.Codebooks(books).nearest(v)
        for p in range(3):
            d = ((v[:, None, p * dim : (p + 1) * dim] - books[p][None]) ** 2).sum(axis=2)
            assert (index[:, p] == d.argmin(axis=1)).all() and (apart[:, p] == d.min(axis=1)).all()


def test_vectors_without_code(spark):
    rows = [(1, [0.5] * 32, 1), (2, [0.5] * 16, 1), (3, [0.5] * 5, 1), (4, [], 2), (5, [1e30] * 32, 1), (6, [0.25] * 32, 1)]
    out = {r.vec_id: r for r in codes.coded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6]
    assert [out[k].code for k in (2, 3, 4, 5)] == [None] * 4 and out[1].code == "00" * 16 and out[6].code == "01" * 16
    assert out[4].label_error is None and out[5].label_error == 0
    assert codes.coded(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.coded(spark.createDataFrame([(1, None, None), (2, [None], 1)], SCHEMA)).collect() == []
