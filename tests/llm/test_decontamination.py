import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rowsmith.llm import decontamination as d

from .helpers import ODD, SMALL, clashing, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items, window=10):
    """For each text: words, hit words, items."""
    grams = {}
    for k, t in items.items():
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = {}
    for k, t in texts.items():
        w = words(t)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= {*range(i, i + n)}
                    found |= grams[tuple(w[i : i + n])]
        out[k] = (len(w), len(hit), sorted(found))
    return out


text = st.lists(st.sampled_from("abc"), max_size=14).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(text, max_size=5), st.lists(text, min_size=1, max_size=3), st.integers(2, 5))
def test_automaton(items, texts, window):
    a = d.Automaton([(k, d.words_of(t)) for k, t in enumerate(items)], window)
    want = brute(dict(enumerate(texts)), dict(enumerate(items)), window)
    for k, t in enumerate(texts):
        ranges, found = a.scan(d.words_of(t))
        assert (sum(y - x + 1 for x, y in ranges), sorted(found)) == want[k][1:]


def test_query(spark):
    t = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = brute(t, items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in d.op8_decontamination(spark, SMALL).collect()}
    assert got == {k: (n, h, len(i), h > 0) for k, (n, h, i) in want.items()}


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_odd_rows_and_blocks(spark):
    items = {1: "tab and vt", 2: ODD[12][:300], 3: None, 4: "", 5: "Naïve CAFÉ — ß"}
    rows = clashing(bench(spark, list(items.items())))
    for most in (d.BLOCK_BYTES, 150):
        got = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in d.scanned(clashing(docs(spark, ODD)), rows, block_bytes=most).collect()}
        assert got == brute(dict(enumerate(ODD)), items)
    assert d.scanned(docs(spark, []), rows).count() == 0
    assert [r.n_hit for r in d.scanned(docs(spark, ["a b"]), bench(spark, [])).collect()] == [0]
    assert [(r.n_hit, r["items"]) for r in d.scanned(docs(spark, ["a b"]), bench(spark, [(None, "a"), (7, "b"), (7, "b")])).collect()] == [(2, [7])]


def test_cleaned(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d0 = docs(spark, [f"Before, here. {item}! After it all.", item, "clean", None])
    got = {r.doc_id: (r.text, r.n_chars) for r in d.cleaned(d0, bench(spark, [(1, item)])).collect()}
    assert got == {0: ("Before, here. ! After it all.", 29), 2: ("clean", 5), 3: (None, None)}


def test_many_blocks_and_repeated_ids(spark):
    """Items in several blocks, rows that share a doc_id or have none: each row has its own hits."""
    items = {i: " ".join(f"w{i}x{k}" for k in range(12)) for i in range(20)}
    rows = bench(spark, list(items.items()))
    assert d.item_blocks(rows, 200)[1] > 4
    texts = [items[3] + " and " + items[15], "clean", items[4], f"{items[7]} {items[7]} x", None]
    want = brute(dict(enumerate(texts)), items)
    for ids in ([0, 1, 2, 3, 4], [5, 5, None, 5, None]):
        got = d.scanned(clashing(docs(spark, texts, ids)), rows, block_bytes=200).collect()
        assert sorted((r.n_words, r.n_hit, r["items"]) for r in got) == sorted((n, h, i) for n, h, i in want.values())
        kept = d.cleaned(clashing(docs(spark, texts, ids)), rows, block_bytes=200, most_hit=0.97)
        assert sorted((r.text or "").strip() for r in kept.collect()) == ["", "and", "clean", "x"]
        assert "rank" in kept.columns
    assert d.cleaned(clashing(docs(spark, [])), rows, block_bytes=200).count() == 0
