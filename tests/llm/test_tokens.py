import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowsmith.llm import packing, token_files
from rowsmith.llm.bpe import Encoder
from rowsmith.llm.common import shared_path

from .helpers import ODD, SMALL, clashing, docs


@pytest.mark.parametrize("path, blanks", [(packing.byte_tokenizer(), True), (token_files.word_tokenizer(), False)])
def test_ids_are_the_librarys(path, blanks):
    whole = Tokenizer.from_file(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="ab' \n\t.,9é\x85 　s\0", max_size=20), max_size=5))
    def same(texts):
        assert Encoder.of(path, blanks).encode(texts) == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]

    same()
    odd = [t or "" for t in ODD]
    assert Encoder.of(path, blanks).encode(odd) == [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in odd]


@pytest.mark.parametrize("path, blanks", [(packing.byte_tokenizer(), True), (token_files.word_tokenizer(), False)])
def test_ids_are_the_librarys_over_all_of_unicode(path, blanks):
    """Letters whose lower case holds a mark, letters before punctuation, and any code point at all."""
    import random

    whole, rng = Tokenizer.from_file(path), random.Random(7)
    letters = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x250))]

    def one():
        x = rng.random()
        if x < 0.4:
            return rng.choice("İſŉĳǅÅéßΣK'\".,_$ \n\t1\u0307\u0301\xa0")
        return rng.choice(letters) if x < 0.8 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)]))

    texts = ["ALİ.", "23 İ'", "日本Å\nİ_", *("".join(one() for _ in range(rng.randrange(15))) for _ in range(5000))]
    assert Encoder.of(path, blanks).encode(texts) == [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, texts):
    whole = Tokenizer.from_file(packing.byte_tokenizer())
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*whole.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert all(r.length == 1024 for r in own[1:])
    return len(places), sum(r.length for r in rows)


def test_packing(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.op1_best_fit_packing(spark, SMALL).collect()
    n, ids = check_packing(rows, {r.doc_id: r.text for r in d.collect()})
    assert n <= 1.02 * -(-ids // 1024) + 1
    check_packing(packing.pack(packing.pieces(clashing(docs(spark, ODD)), packing.byte_tokenizer())).collect(), dict(enumerate(ODD)))
    assert packing.pack(packing.pieces(docs(spark, []), packing.byte_tokenizer())).count() == 0
    twice = packing.pack(packing.pieces(docs(spark, ["a b", "a b"], [None, None]), packing.byte_tokenizer())).collect()
    assert sorted(r.offset for r in twice) == [0, twice[0].length]


def least(lengths, capacity):
    """The least number of bins, by search."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5))
def test_reduction_keeps_the_least_number(counts):
    fixed, left = packing.reduced(counts, 12)
    all_ = [n for n, c in counts.items() for _ in range(c)]
    rest = [n for n, c in left.items() for _ in range(c)]
    assert sorted(all_) == sorted([*rest, *(n for p, t in fixed for n in p * t)])
    if len(all_) <= 9:
        assert sum(t for _, t in fixed) + least(rest, 12) == least(all_, 12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_best_fit_places_everything(counts):
    bins = packing.best_fit(counts, 64)
    got = defaultdict(int)
    for pattern, times in bins:
        assert times > 0 and sum(pattern) <= 64
        for n in pattern:
            got[n] += times
    assert got == counts


def test_token_files(spark):
    whole = Tokenizer.from_file(token_files.word_tokenizer())
    for d in (spark.read.parquet(f"{SMALL}/documents.parquet"), clashing(docs(spark, ODD)), docs(spark, []), docs(spark, ["b", None, "a"], [5, None, -3])):
        texts = {r.doc_id: r.text for r in d.collect()}
        got = {r.doc_id: r for r in token_files.read(token_files.write(d, token_files.word_tokenizer(), shared_path(spark, "t"))).collect()}
        start = 0
        for k in sorted(texts, key=lambda k: (k is not None, k)):
            ids = np.array([*whole.encode(texts[k] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        assert len(got) == len(texts)


def test_reader_takes_single_documents_and_finds_damage(tmp_path):
    path = str(tmp_path / "x.zst")
    fs, where = token_files.file_system(path)
    with fs.open_output_stream(where, compression=None) as out:
        w = token_files.Writer(out)
        for k in range(300):
            w.add(k, np.full(1000, k, dtype="<u4").tobytes())
        w.close()
    with fs.open_input_file(where) as f:
        r = token_files.Reader(f)
        seen = []
        r.frame, whole = lambda k: (seen.append(k), whole(k))[1], r.frame
        assert [(k, len(ids)) for k, ids in r.read({7, 200})] == [(7, 4000), (200, 4000)] and len(seen) == 2 < len(r.sizes)
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(data)
    with fs.open_input_file(where) as f, pytest.raises(Exception):
        list(token_files.Reader(f).read())
