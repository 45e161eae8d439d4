import random
import re

import pytest

from rowsmith.llm import jaccard

from .helpers import ODD, SMALL, clashing, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    lists = {}
    for k, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(k)
    for a, b in {(a, b) for ks in lists.values() for a in ks for b in ks if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: (len(sets[k]), root(k)) for k in texts}


def check(spark, texts, frame=None):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(frame or docs(spark, list(texts.values()), list(texts))).collect()}
    assert got == brute(texts)


def test_given_documents(spark):
    check(spark, {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_near_copies_at_the_threshold(spark):
    """Chains and groups around 0.75, with passages that many documents share."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([4, 6, 12, 40, 90]))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.4:
                at = rng.randrange(len(t))
                t[at:at] = common[: rng.choice([8, 15, 30])]
            texts.append(" ".join(t))
            base = t if rng.random() < 0.5 else base
    texts += [texts[0], texts[5].upper()]
    rng.shuffle(texts)
    check(spark, dict(enumerate(texts)))


@pytest.mark.parametrize("rounds, at_once", [(3, 1), (1, 500)])
def test_order_rounds_and_parts_change_nothing(spark, monkeypatch, rounds, at_once):
    """Every shingle common and dealt into parts; one round of leaders or many; leaders copied to many parts."""
    monkeypatch.setattr(jaccard, "SHARE", 1)
    monkeypatch.setattr(jaccard, "LEAST", 2)
    monkeypatch.setattr(jaccard, "COMMON", 1 << 30)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "WORTH", 0.0)
    monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
    test_near_copies_at_the_threshold(spark)


def test_blocks_that_cannot_link_do_not_meet(spark):
    """Rows meet just where two sets of these sizes, with a common shingle at these places, may link."""
    rng = random.Random(8)
    rows = [(1, i, size, rng.randrange(1 + size // 3), i) for i, size in enumerate(rng.choice([10, 40, 50, 60, 200]) for _ in range(80))]
    got = jaccard.meeting(spark.createDataFrame(rows, "h long, sid long, size long, at long, component long"))
    want = {(a[1], b[1]) for a in rows for b in rows if (a[2], a[1]) > (b[2], b[1]) and 4 * b[2] >= 3 * a[2] and 7 * (min(a[3], b[3]) + min(a[2] - a[3], b[2] - b[3])) >= 3 * (a[2] + b[2])}
    assert {(r.sid_a, r.sid_b) for r in got.collect()} == want and want
    one = spark.createDataFrame([(*r[:4], 0) for r in rows], "h long, sid long, size long, at long, component long")
    assert jaccard.meeting(one).count() == 0


def test_odd_rows(spark):
    check(spark, dict(enumerate(ODD)), clashing(docs(spark, ODD)))
    assert jaccard.join_components(docs(spark, [])).count() == 0
    rows = jaccard.join_components(docs(spark, ["a b", "a b", "", None], [3, 3, None, 9])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(False, 3, 1, 3), (False, 3, 1, 3), (False, 9, 0, 9), (True, None, 0, None)]


def test_repeated_and_null_ids(spark):
    """Texts under one doc_id, or under none, keep their own sets and links."""
    rng = random.Random(9)
    a, b, c = ([f"w{rng.randrange(1000)}" for _ in range(60)] for _ in range(3))
    near = lambda t: " ".join([*t[:30], "new", *t[31:]])
    rows = [(1, " ".join(a)), (5, near(b)), (5, near(a)), (None, " ".join(b)), (None, near(c)), (None, " ".join(c)), (9, " ".join(b))]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    got = jaccard.join_components(d).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (1, 1), (5, 1), (5, 5), (9, 5)]
    assert sorted((r.doc_id or 0, r.text[:4]) for r in jaccard.one_of_each(clashing(d)).collect())[1:] == [(1, rows[0][1][:4]), (5, rows[1][1][:4])]
    twice = jaccard.one_of_each(docs(spark, ["a b c d e f"] * 4 + ["", ""], [3, 3, 2, 2, 8, 8]))
    assert sorted(r.doc_id for r in twice.collect()) == [2, 8, 8]
    assert jaccard.one_of_each(docs(spark, [])).count() == 0
