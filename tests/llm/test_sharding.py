import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsmith.llm import sharding

from .helpers import ODD, SMALL, clashing, docs


def jump(key, n):
    """The published algorithm."""
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def check(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        key = 0 if r.doc_id is None else r.doc_id
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25)) and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    check(sharding.op7_sharding(spark, SMALL).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()})


def test_odd_rows(spark):
    ids = [-(1 << 63), (1 << 63) - 1, -1, None, *range(len(ODD) - 4)]
    check(sharding.deal(clashing(docs(spark, ODD, ids))).collect(), dict(zip(ids, ODD)))
    assert sharding.deal(docs(spark, [])).count() == 0
    same = sharding.deal(docs(spark, ["a"] * 5, [7] * 5)).collect()
    assert len({r.shard for r in same}) == 1 and sorted(r.slot for r in same) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("shards", [1, 2, 100])
def test_hash(spark, shards):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 12345678901, -(1 << 62), 10863919174838991, 2016238256797177309]
    d = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), shards).alias("j"))
    assert {r.k: (r.j.shard, r.j.grown) for r in d.collect()} == {k: (jump(k, shards), jump(k, shards + 1)) for k in keys}


@settings(max_examples=20, deadline=None)
@given(st.integers(-(1 << 63), (1 << 63) - 1))
def test_monotone(key):
    assert all(jump(key, n + 1) in (jump(key, n), n) for n in range(1, 30))
