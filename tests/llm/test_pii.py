import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rowsmith.llm import pii

from .helpers import ODD, SMALL, clashing, docs

# The contract's patterns, without the bounds that make the operator's own linear.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


MIXED = [
    "a@b.c, x.y+z@host.example.com. @none a@b a@@b.c aé@b.c a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000000", "+1 (784) 555-8120, +12, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +33.1.23.45.67.89)",
    'token = "3f76bb46f51625a07193ae74d1cc485f188b9b5d" password=49b0203a9cc466e6ee', "call (784) 555-8120", "1" * 5000, "a." * 3000 + "@", "+" + "(" * 5000, "9.9." * 2000,
]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.9@+-() é", max_size=40))
def test_base(text):
    assert pii.base_spans(text) == brute(text)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check(pii.op3_pii(spark, SMALL).collect(), texts)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        own = r.spans.split(",") if r.spans else []
        assert set(base.split(",") if base else []) <= set(own) and len(own) == len(want) + r.n_added
        places = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in own)]
        assert places == sorted(places) and all(a < b <= len(texts[r.doc_id]) for a, _, b in places)


def test_odd_rows(spark):
    texts = dict(enumerate([*ODD, *MIXED]))
    check(pii.detected(clashing(docs(spark, list(texts.values())))).collect(), texts)
    assert pii.detected(docs(spark, [])).count() == 0


def test_redaction_leaves_no_base_span_and_clean_texts_alone(spark):
    got = {r.doc_id: r for r in pii.redacted(docs(spark, [*MIXED[:5], "clean text", None])).collect()}
    assert got[5].text == "clean text" and got[6].text is None
    assert all(not pii.base_spans(got[i].text) for i in range(5))
    assert pii.redacted_text("x a@b.c y", frozenset()) == "x [EMAIL] y"


def test_expectation_maximisation_finds_the_reliable_labelers():
    """Votes drawn from two classes: posteriors recover them better than the majority does."""
    import random

    rng, counts, truth = random.Random(1), {}, {}
    right = (0.95, 0.9, 0.55, 0.55, 0.9)
    for _ in range(4000):
        y = rng.random() < 0.4
        p = "".join("+-"[(rng.random() < q) != y] for q in right)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    post, _, prior = pii.reliabilities(counts)
    got = sum((post[p] >= 0.5) == y for p, ys in truth.items() for y in ys) / 4000
    majority = sum((p.count("+") >= 3) == y for p, ys in truth.items() for y in ys) / 4000
    assert got > 0.93 and got > majority and abs(prior - 0.4) < 0.06


def test_secrets_are_added(spark):
    rows = [f'text token = "{hashlib.sha1(bytes([i])).hexdigest()}" text' for i in range(30)] + [f"number {10**15 + 7 * i} here" for i in range(30)]
    added = [r.n_added for r in pii.detected(docs(spark, rows)).orderBy("doc_id").collect()]
    assert sum(added[:30]) >= 28 and sum(added[30:]) <= 3


def test_recall_of_planted_kinds(spark):
    """Of each kind that stands in the given documents nine in ten are found; others are left alone."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    got = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.detected(d).collect()}
    planted = {"email": r"[a-z]+\.[0-9]+@mail[0-9]+\.example\.com", "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "secret": r"(?i)(?<=token = \")[0-9a-f]{40}(?=\")"}
    for kind, pattern in planted.items():
        want = [(k, m.start(), m.end()) for k, t in texts.items() for m in re.finditer(pattern, t or "")]
        found = [any(s[0] == kind and int(s[1]) <= a and b <= int(s[2]) for s in got[k]) for k, a, b in want]
        assert len(want) >= 5 and sum(found) >= 0.9 * len(found), kind
    clean = [k for k, t in texts.items() if not re.search("[0-9@]", t or "")]
    assert len(clean) > 500 and not any(got[k] for k in clean)


def test_repeated_ids_and_long_secrets(spark):
    texts = ["a@b.c", "x 1.2.3.4", "a@b.c", None]
    rows = pii.detected(clashing(docs(spark, texts, [4, 4, None, None]))).collect()
    assert sorted((r.doc_id or 0, r.spans) for r in rows) == [(0, ""), (0, "email:0:5"), (4, "email:0:5"), (4, "ip:2:9")]
    long = "0123456789abcdef" * 40
    assert [(a, pii.KINDS[k], b) for a, k, b, _ in pii.candidates(f"key {long} end", [])] == [(4, "secret", 4 + len(long))]
    kept = pii.redacted(clashing(docs(spark, texts, [4, 4, None, None])))
    assert sorted(r.text or "" for r in kept.collect()) == ["", "[EMAIL]", "[EMAIL]", "x [IP]"] and "rank" in kept.columns
    assert pii.redacted(docs(spark, [])).count() == 0
