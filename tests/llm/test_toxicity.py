import numpy as np

from rowsmith.llm import toxicity as t

from .helpers import ODD, clashing, docs


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs_, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = t.fitted(docs_, labels.where("doc_id % 3 <> 0"))
    test = docs_.join(labels.where("doc_id % 3 = 0"), "doc_id").select("text", "toxic").collect()
    got = np.array([(r.toxic, model.likelihoods(r.text)[0] >= t.REJECT) for r in test])
    # About one label in ten names a document toxic that holds none of the terms.
    assert (got[:, 0] == got[:, 1]).mean() > 0.93
    assert got[got[:, 0] == 0, 1].mean() < 0.05


def labelled(spark, n=200):
    texts = [f"plain words number {chr(97 + i % 20)} here" + (" vile" * (1 + i % 4) if i % 4 == 0 else "") for i in range(n)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels


def test_severity_rises_with_density(spark):
    d, labels = labelled(spark)
    model = t.fitted(d, labels)
    few, many = (model.likelihoods("plain " + "vile " * k).sum() for k in (1, 9))
    assert few < many and model.likelihoods("plain words")[0] < 0.5 < model.likelihoods("so vile")[0]
    assert list(model.thresholds) == sorted(model.thresholds)


def test_rows(spark):
    d, labels = labelled(spark)
    model = t.fitted(clashing(d), clashing(labels))
    rows = t.scored(clashing(docs(spark, [*ODD, "vile vile vile"])), model).orderBy("doc_id").collect()
    assert len(rows) == len(ODD) + 1 and [r.toxic for r in rows] == [False] * len(ODD) + [True]
    assert t.scored(docs(spark, []), model).count() == 0
    kept = t.kept(clashing(docs(spark, ["vile vile", "fine", None])), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and "rank" in kept.columns


def test_no_labels_reject_nothing(spark):
    d, labels = labelled(spark)
    for own in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("cast(null as long) doc_id", "quality", "toxic")):
        model = t.fitted(d, own)
        assert not model.terms and not t.scored(d, model).where("toxic").count()


def test_features():
    assert t.features_of(b"abcdef") == [b"abcdef", b"abcd*", b"abcde*"]
    assert t.words_of("A-b 1c É") == [b"a", b"b", b"c", "É".encode()]


def test_words_with_equal_counts_all_stay(spark):
    texts = [f"calm plain text {chr(97 + i % 26)}{chr(97 + i // 26)}" + [" scum", " disgusting", "", "", "", ""][i % 6] for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 6 < 2)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = t.fitted(docs(spark, texts), labels)
    assert {b"scum", b"disgusting"} <= set(model.terms) and b"disg*" not in model.terms
    assert all(model.likelihoods(w)[0] > 0.5 for w in ("scum", "disgusting")) and model.likelihoods("plain")[0] < 0.5


def test_only_beginnings_in_the_same_documents_go(spark):
    rows = [(b"idiot", 3, 1), (b"idio*", 5, 1), (b"idiots", 3, 1), (b"idiot*", 3, 1), (b"scum", 3, 1), (b"disgustingly", 3, 1), (b"disgustin*", 3, 1), (b"disgusti*", 3, 1), (b"loser", 3, 0), (b"lose*", 3, 1)]
    got = t.without_shorter(spark.createDataFrame([(bytearray(x), a, b) for x, a, b in rows], "term binary, a long, b long")).collect()
    assert {bytes(r.term) for r in got} == {b"idiot", b"idio*", b"idiots", b"scum", b"disgustingly", b"loser", b"lose*"}


def test_query_by_brute_force(spark):
    """Every row of the query from its own text: terms counted one by one, the law of the model written out."""
    from .helpers import SMALL

    d, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = t.fitted(d, labels)
    got = {r.doc_id: r for r in t.op6_toxicity(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in d.collect()}
    assert set(got) == set(texts) and len(model.terms) > 100 and np.all(np.diff(model.thresholds) > 0)
    for k, text in texts.items():
        words = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split()
        score = 0.0
        for term, i in model.terms.items():
            if term.endswith(b"*"):
                n = sum(w.encode().startswith(term[:-1]) and len(w.encode()) > len(term) - 1 for w in words)
            else:
                n = sum(w.encode() == term for w in words)
            score += np.log1p(n) * model.weights[i]
        p = 1 / (1 + np.exp(-np.clip(score - model.thresholds, -30, 30)))
        assert abs(got[k].severity - p.sum()) < 1e-6 and got[k].grade == int((p >= 0.5).sum()) and got[k].toxic == bool(p[0] >= 0.5)


def test_all_grades_occur(spark):
    d = "/root/testdata/sf0.01"
    rows = t.op6_toxicity(spark, d).collect()
    n = np.bincount([r.grade for r in rows], minlength=t.GRADES + 1)
    assert all(n > 0) and n[0] > 0.85 * len(rows)
    severity = [np.mean([r.severity for r in rows if r.grade == g]) for g in range(t.GRADES + 1)]
    assert severity == sorted(severity)


def test_terciles():
    y = np.array([0, 1, 1, 1, 0, 1, 1, 1])
    # Terciles of what differs; equal densities share the grade of the least of them.
    assert t.severity_grades(y, np.array([9, 1, 2, 3, 0, 4, 5, 6.0])).tolist() == [0, 1, 1, 2, 0, 2, 3, 3]
    assert t.severity_grades(y, np.array([9, 1, 1, 1, 0, 1, 1, 5.0])).tolist() == [0, 1, 1, 1, 0, 1, 1, 3]
    assert t.severity_grades(np.zeros(3), np.ones(3)).tolist() == [0, 0, 0]


def test_repeated_and_null_ids(spark):
    d, labels = labelled(spark)
    model = t.fitted(d, labels)
    rows = t.scored(docs(spark, ["vile vile vile", "fine", "vile vile", None], [3, 3, None, None]), model).collect()
    assert sorted((r.doc_id or 0, r.toxic) for r in rows) == [(0, False), (0, True), (3, False), (3, True)]


def test_equal_densities_share_a_grade():
    toxic, density = np.array([1, 0, 1, 1, 1, 1, 1]), np.array([0.0, 9.0, 0.0, 0.0, 2.0, 2.0, 5.0])
    assert t.severity_grades(toxic, density).tolist() == [1, 0, 1, 1, 2, 2, 3]
    assert t.severity_grades(np.array([0]), np.array([1.0])).tolist() == [0] and t.severity_grades(np.array([1, 1]), np.zeros(2)).tolist() == [1, 1]


def test_the_model_does_not_depend_on_partitions(spark):
    """The same rows in one partition and in many: the same weights, to the last bit."""
    from .helpers import SMALL

    d, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    models = [t.fitted(d.repartition(n), labels.repartition(m)) for n, m in ((1, 5), (9, 1))]
    assert models[0].terms == models[1].terms and (models[0].weights == models[1].weights).all() and (models[0].thresholds == models[1].thresholds).all()
