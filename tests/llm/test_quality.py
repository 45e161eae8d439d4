import re

from rowsmith.llm import quality as q

from .helpers import ODD, SMALL, clashing, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measurements(spark):
    texts = [*ODD, "a b c a b c a", "x y z", "one one one one", "l1 a\nl1 a\n\nl1 a\n b", "#*$%&|<> # word", "a b a b a b c d e a b"]
    got = {r.doc_id: r for r in q.ledger(clashing(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), t
        n, _, _, _, rep = brute(t)
        assert bool(r.failures & q.BASE) == (n < 50 or 100 * rep > 50 * n)
    assert q.ledger(docs(spark, [])).count() == 0
    twice = q.ledger(docs(spark, ["a b", "a b"], [1, 1])).collect()
    assert twice[0] == twice[1]


def test_ablation(spark):
    book = spark.createDataFrame([(0,), (1,), (3,), (4,), (6,)], "failures long")
    got = {r.rule: (r.failed, r.alone, r.kept_without) for r in q.ablation(book, 7).collect()}
    assert got == {"too_few_words": (2, 1, 2), "repeated_windows": (2, 0, 1), "symbols": (2, 1, 2)}


def test_policies_grow_with_their_version():
    assert q.POLICIES["base"] & q.POLICIES["v1"] == q.POLICIES["base"] and q.POLICIES["v1"] & q.POLICIES["v2"] == q.POLICIES["v1"]


def test_policies_and_ablation_agree(spark):
    """What one rule alone rejects is what its ablation keeps more."""
    rows = q.op10_quality_rules(spark, SMALL).collect()
    book = q.ledger(spark.read.parquet(f"{SMALL}/documents.parquet"))
    for r in q.ablation(book, q.POLICIES[q.POLICY]).collect():
        assert r.alone == sum(x.sole_failure == q.BIT[r.rule] for x in rows) and r.kept_without == sum(x.kept for x in rows) + r.alone
    assert all(x.kept == x.kept_v2 and x.base_failed != x.kept_base and x.kept_base >= x.kept_v1 >= x.kept_v2 for x in rows)
