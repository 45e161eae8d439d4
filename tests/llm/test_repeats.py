import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowsmith.llm import repeats as r
from rowsmith.llm.common import documents, keyed

from .helpers import ODD, SMALL, clashing, docs


def brute(texts):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, k in zip(b, mark) if not k)
        out[i] = (len(b), sum(mark), sum(m and (not j or not mark[j - 1]) for j, m in enumerate(mark)), hashlib.sha256(kept).hexdigest())
    return out


def check(frame, texts, **k):
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.deduplicated(frame, **k).collect()} == brute(texts)


def test_query(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    check(d, {x.doc_id: x.text for x in d.collect()})


@pytest.mark.parametrize("frequent, bucket_blocks, piece", [(False, r.BUCKET_BLOCKS, r.PIECE), (True, 2, r.PIECE), (True, 10, 150), (False, 1, 64)])
def test_passages(spark, monkeypatch, frequent, bucket_blocks, piece):
    """Shared passages, near copies, periodic text; all buckets frequent, all wide, texts cut into many pieces."""
    if frequent:
        monkeypatch.setattr(r, "SHARE", 1)
        monkeypatch.setattr(r, "LEAST", 1)
        monkeypatch.setattr(r, "FREQUENT", 1 << 30)
    monkeypatch.setattr(r, "PIECE", piece)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(6))
    common = "".join(word() for _ in range(40))
    texts = []
    for _ in range(30):
        t = "".join(word() for _ in range(rng.randrange(60)))
        a, b = sorted(rng.sample(range(len(common)), 2))
        texts.append(t[: len(t) // 2] + common[a:b] + t[len(t) // 2 :])
    texts += ["x" * 500, "ab" * 300, "x" * 99, "x" * 100, texts[0], texts[1][5:], *[t for t in ODD if len(t or "") < 10_000]]
    check(clashing(docs(spark, texts)), dict(enumerate(texts)), bucket_blocks=bucket_blocks)


def test_long_texts(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    texts = [long, long[300_000:300_500] + "z" * 50 + long[:120], *ODD]
    check(docs(spark, texts), dict(enumerate(texts)))


def test_empty_table(spark):
    assert r.deduplicated(docs(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    """The first of rows that share a doc_id keeps its text; rows without one come last."""
    a, b = "y" * 150 + "end", "".join(chr(97 + i * 7 % 23) + str(i) for i in range(100))
    got = r.deduplicated(docs(spark, [b, b, b, a, None, None], [7, 7, None, None, 7, None])).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.n_removed) for x in got) == [(False, 7, 0, 0), (False, 7, len(b), 0), (False, 7, len(b), len(b)), (True, 0, 0, 0), (True, 0, len(a), 149), (True, 0, len(b), len(b))]
    got = r.deduplicated(docs(spark, [b + a, a + b], [3, 3])).collect()
    assert sorted(x.n_removed for x in got)[1] == len(a + b) and sum(x.n_spans for x in got) == 2


def test_frequent_buckets_are_found_over_all_texts(spark, monkeypatch):
    """A passage that is rare in every task, and frequent in the table, is dealt into parts."""
    monkeypatch.setattr(r, "SHARE", 1)
    monkeypatch.setattr(r, "LEAST", 30)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(150))
    texts = ["".join(rng.choice("klmnopq ") for _ in range(300)) + passage for _ in range(60)]
    rows = keyed(documents(docs(spark, texts).repartition(30)), "key")
    hot, parts = r.frequent_buckets(rows)
    assert 0 < len(hot) < 20 and all(parts >= r.PART)
    found = r.blocks(rows, (hot, parts))
    assert found.where("salt > 0").select("h").distinct().count() == len(hot) and found.where("salt > 0").groupBy("h").agg({"salt": "max"}).count() == len(hot)
    check(docs(spark, texts).repartition(30), dict(enumerate(texts)))


@settings(max_examples=300, deadline=None)
@given(st.permutations(list(range(12))))
def test_nearest_smaller(values):
    got = r.nearest_smaller(np.array(values))
    assert got.tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(len(values))]
    assert r.nearest_smaller(np.arange(50)[::-1]).tolist() == [-1] * 50


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=4, max_size=60).map(str.encode), st.integers(1, 4))
def test_longest_previous_factors(data, width):
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), width)
    common = lambda i, j: next((k for k in range(width) if data[i + k] != data[j + k]), width)
    assert r.longest_previous_factors(windows).tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(len(windows))]
