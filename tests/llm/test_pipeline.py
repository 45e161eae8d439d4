import importlib

import pytest

from rowsmith.llm import decontamination, jaccard, packing, pii, toxicity
from rowsmith.llm.common import table, written

from .helpers import SMALL
from .test_decontamination import brute as brute_hits
from .test_jaccard import brute as brute_components
from .test_tokens import check_packing

pipeline = importlib.import_module("corpus_pipeline")


def test_stages_match_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        if name == "packing":
            check_packing(out.collect(), {k: r.text for k, r in before.items()})
            break
        assert out.columns == docs.columns
        out = written(out, "stage")
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        if name == "toxicity":
            model = toxicity.fitted(docs, table(spark, SMALL, "labels"))
            assert set(after) == {k for k, r in before.items() if model.likelihoods(r.text)[0] < toxicity.REJECT}
        elif name == "near duplicates":
            found = brute_components({k: r.text for k, r in before.items()})
            assert set(after) == {k for k, (_, c) in found.items() if c == k}
        elif name == "decontamination":
            items = {r.item_id: r.text for r in table(spark, SMALL, "benchmark").collect()}
            hits = brute_hits({k: r.text for k, r in before.items()}, items)
            assert set(after) == {k for k, (n, hit, _) in hits.items() if hit <= decontamination.MOST_HIT * n}
            assert all((after[k].text == before[k].text) == (hits[k][1] == 0) for k in after)
        else:
            accepted = frozenset(p for p, q in pii.trained(pii.extracted(docs)).items() if q >= 0.5)
            assert {k: r.text for k, r in after.items()} == {k: pii.redacted_text(r.text, accepted) for k, r in before.items()}
            assert not any(pii.base_spans(r.text or "") for r in after.values())
        docs = out


def test_run(spark):
    assert pipeline.run(spark, SMALL).columns == packing.pack(packing.pieces(table(spark, SMALL, "documents"), packing.byte_tokenizer())).columns


def test_import_errors_show(monkeypatch):
    """Neither the pipeline nor the operators hide a failed import."""
    import sys

    monkeypatch.setitem(sys.modules, "rowsmith.llm.jaccard", None)
    monkeypatch.delattr("rowsmith.llm.jaccard")
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    with pytest.raises(ImportError):
        importlib.import_module("corpus_pipeline")


def test_one_of_each_takes_rows_with_ids_first(spark):
    from .helpers import docs

    d = docs(spark, ["a b c d e f", "a b c d e f", "a b c d e f"], [1, 2, None])
    assert sorted((r.doc_id is None, r.doc_id) for r in jaccard.one_of_each(d).collect()) == [(False, 1)]


def test_stages_bear_odd_tables(spark):
    """Empty tables, nulls, repeated and missing ids, equal rows, and columns with clashing names."""
    from .helpers import ODD, clashing, docs

    texts = [*[t for t in ODD if len(t or "") < 10_000], "same text here", None, "mail a@b.c"]
    ids = [*range(len(texts) - 4), 3, 3, None, None]
    for frame in (docs(spark, []), clashing(docs(spark, texts, ids))):
        n = frame.count()
        for name, stage in pipeline.STAGES:
            out = written(stage(spark, frame, SMALL), "odd")
            if name == "packing":
                assert {r.doc_id for r in out.collect()} == {r.doc_id for r in frame.collect()}
                break
            assert out.columns == frame.columns and out.count() <= n
            if name != "near duplicates":
                assert out.count() == n  # all these documents are clean
            frame, n = out, out.count()
