import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowsmith.llm import alignment
from rowsmith.llm.alignment import Aligner, BytePairs, Pieces

from .helpers import ODD, SMALL, clashing, docs

A, B = alignment.byte_tokenizer(), alignment.piece_tokenizer()


class Brute:
    """All by the libraries, one text and one pair of tokens at a time."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}

    def tokens(self, text):
        if not text:
            return None
        e, ids = self.a.encode(" " + text, add_special_tokens=False), self.b.encode(text)
        a = [(i, bytes(self.back[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, self.b.id_to_piece(i)) for i in ids)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None

    def rows(self, texts):
        out, counts = [], Counter()
        for text in texts:
            found = self.tokens(text)
            if found is None:
                out.append((0, 0, 0, [], ""))
                continue
            spans = []
            for side in found:
                at, own = 0, []
                for i, x in side:
                    own.append((i, at, at + len(x)))
                    at += len(x)
                spans.append(own)
            ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
            groups = [tuple(",".join(str(i) for i, s, e in side if x <= s and e <= y) for side in spans) for x, y in zip([0, *ends], ends)]
            links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
            counts.update(set(links))
            out.append((len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()))
        most = {}
        for (i, _), n in counts.items():
            most[i] = max(most.get(i, 0), n)
        return [(a, b, g, len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), d) for a, b, g, x, d in out]


@pytest.fixture(scope="module")
def brute():
    return Brute()


def some_text(rng):
    words = ["the", "and", "Überraschung", "naïve", "x=1;", "don't", "   ", "\n\n", "3.14", "日本語", "🙂", "<s>", "<|endoftext|>", "▁", "\t", "re-use", "\0", "I'LL", "a" * 60, "<0x41>", "é"]
    return rng.choice(["", " "]) + rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " ", "  ", ",", ".\n"]) for _ in range(rng.randrange(1, 25)))


def test_pieces_are_the_librarys(brute):
    own = Pieces(B)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet="ab' \n\t.,9é\x85 　s\0▁<s>日", max_size=20), max_size=5))
    def same(texts):
        texts = [t for t in texts if t]
        assert own.encode([" " + t for t in texts]) == [np.array(brute.b.encode(t), dtype="<u4").tobytes() for t in texts]

    same()
    rng = random.Random(3)
    texts = [t for t in ODD if t] + [some_text(rng) for _ in range(500)] + [" " * k + "x" + " " * k for k in range(40)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000), 32, 32, 10])) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    assert own.encode([" " + t for t in texts]) == [np.array(x, dtype="<u4").tobytes() for x in brute.b.encode(texts)]


def test_special_tokens_are_text(brute):
    for t in ("<|endoftext|>", "a <|endoftext|>b", "<|endoftext|> <|endoftext|>"):
        assert BytePairs(A).encode([" " + t])[0] == np.array(brute.a.encode(" " + t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_windows(brute):
    own, rng = Aligner(A, B), random.Random(11)
    texts = [some_text(rng) for _ in range(300)]
    out, want = own.align(texts), brute.rows(texts)
    assert [tuple(int(out[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")) + (out["groups_sha256"][k],) for k in range(len(texts))] == [w[:4] + w[6:] for w in want]
    assert int(out["links"].sum()) == sum(w[3] for w in want)
    assert own.align([])["n_a"].tolist() == []


@pytest.mark.parametrize("frequent", [500_000, 40, 0])
def test_counts(spark, brute, frequent):
    """Odd texts, copies, repeated and lacking ids; all pairs broadcast, some, none."""
    rng = random.Random(frequent)
    texts = ODD[:12] + ODD[14:] + [some_text(rng) for _ in range(60)] + ["the same text again and again"] * 20
    ids = [k if k % 5 else (None if k % 2 else 3) for k in range(len(texts))]
    got = alignment.scored(alignment.aligned(clashing(docs(spark, texts, ids)).withColumn("a", F.lit("x")).withColumn("pair", F.lit("y")).repartition(6), A, B), frequent).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted([(r.doc_id, *(r[c] for c in names)) for r in got], key=repr) == sorted([(i, *w) for i, w in zip(ids, brute.rows(texts))], key=repr)


def test_empty_and_long(spark, brute):
    assert alignment.scored(alignment.aligned(docs(spark, []), A, B)).collect() == []
    long = "Rivers run downhill, élan vital.  " * 40_000
    r = alignment.scored(alignment.aligned(docs(spark, [long]), A, B)).collect()[0]
    a, b = brute.tokens(long)
    assert (r.n_a, r.n_b) == (len(a), len(b)) and r.n_best >= 1 and r.count_sum == r.n_links == r.n_a + r.n_b - r.n_groups


def test_given_documents(spark, brute):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    got = alignment.scored(alignment.aligned(docs(spark, [r.text for r in rows], [r.doc_id for r in rows]), A, B)).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert [tuple(r[c] for c in names) for r in sorted(got, key=lambda r: r.doc_id)] == brute.rows([r.text for r in rows])
