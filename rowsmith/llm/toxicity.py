"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity grades are ordered, and one weight for each term serves all thresholds: the likelihood of a
grade above k is logistic(w . x - threshold k). The model is fitted on a bounded sample of labelled
documents; every document is then scored over its whole text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, documents, mapped, slices, table, written

#: Labelled documents that the model is fitted on, at most about so many; chosen by the hash of doc_id.
SAMPLE = 20_000
#: Terms of the model: those most associated with the label, by G-statistic.
TERMS = 2048
GRADES = 3  # above 0, which is not toxic
REJECT = 0.5  # likelihood of a grade above 0
#: A term's count, and its odds where severity is graded, are scaled by g / (g + DOUBT): the less sure its association
#: with the label (the G-statistic g), the less it can weigh.
DOUBT = 20.0

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, A-Z lower-cased; characters beyond ASCII count as letters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


#: Word beginnings of these many bytes are terms too, so that one stem with many endings is one term.
STEMS = range(4, 10)
#: The terms that the remembered words belong to, and these words with their terms.
_memo: list = [None, {}]


def features_of(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in STEMS if len(word) > k)]


def hits_of(text: str | None, terms: dict[bytes, int]) -> list[int]:
    """Term numbers of all words, each as often as it occurs; words seen before are looked up once."""
    if _memo[0] is not terms or len(_memo[1]) > 100_000:
        _memo[:] = [terms, {}]
    memo = _memo[1]
    out: list[int] = []
    for w in words_of(text):
        found = memo.get(w)
        if found is None:
            found = memo[w] = tuple(terms[f] for f in features_of(w) if f in terms)
        if found:
            out += found
    return out


@dataclass(frozen=True)
class Model:
    terms: dict[bytes, int]
    weights: np.ndarray  # with the scale of each term
    thresholds: np.ndarray

    def likelihoods(self, text: str | None) -> np.ndarray:
        """Of a grade above 0, 1, ..., each."""
        hits = np.bincount(np.array(hits_of(text, self.terms), dtype=np.int64), minlength=len(self.weights))
        return 1 / (1 + np.exp(-np.clip(np.log1p(hits) @ self.weights - self.thresholds, -30, 30)))


def sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, toxic of about `most` labelled documents by the hash of doc_id, all if there are fewer."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = max(1, own.count())
    return own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30)))


def _g(na: int, nb: int) -> Column:
    """G-statistic of a term in a of na toxic and b of nb other documents."""
    a, b, p = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / (na + nb)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (part(a, na * p) + part(b, nb * p) + part(na - a, na * (1 - p)) + part(nb - b, nb * (1 - p)))


def without_shorter(counts: DataFrame) -> DataFrame:
    """Terms with their counts, without beginnings that stand in the same documents as a longer term.

    The documents of a beginning hold those of all its continuations, so equal counts mean equal
    documents, and those of any length between too: one step longer is all that has to be looked at.
    Words, and beginnings of different words, stay whatever their counts.
    """
    n = F.octet_length("term")
    bare = n - F.when(F.expr("substring(term, -1, 1) = X'2A'"), 1).otherwise(0)
    shorter = F.least(bare - 1, F.lit(STEMS[-1]))
    longer = counts.where(bare > STEMS[0]).select(F.concat(F.substring(F.col("term"), F.lit(1), shorter), F.expr("X'2A'")).alias("term"), "a", "b")
    return counts.join(longer, ["term", "a", "b"], "left_anti")


def fit_ordinal(rows: list[np.ndarray], cols: np.ndarray, values: np.ndarray, grades: np.ndarray, terms: int, steps: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient descent on the negative log-likelihood.

    Each threshold separates the grades above it from the others; the weights are shared.
    """
    n, k = len(grades), GRADES
    above = grades[:, None] > np.arange(k)
    balance = np.where(above, 0.5 / np.maximum(above.mean(0), 1e-6), 0.5 / np.maximum(1 - above.mean(0), 1e-6)) / n / k
    w, first, gaps = np.zeros(terms), 1.0, np.zeros(k - 1)
    state = [np.zeros(terms + k), np.zeros(terms + k)]
    for t in range(1, steps + 1):
        cut = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, weights=values * w[cols], minlength=n)
        error = balance * (1 / (1 + np.exp(-np.clip(score[:, None] - cut, -30, 30))) - above)
        by_row = error.sum(1)
        by_cut = -error.sum(0)
        tails = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(cols, weights=values * by_row[rows], minlength=terms) + decay * w, [tails[0]], tails[1:] * np.exp(gaps)])
        state = [0.9 * state[0] + 0.1 * gradient, 0.99 * state[1] + 0.01 * gradient**2]
        step = 0.1 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-10)
        w, first, gaps = w - step[:terms], first - step[terms], np.clip(gaps - step[terms + 1 :], -4, 4)
    return w, first + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """The model from the labelled sample. Without both classes it has no terms and rejects nothing.

    Labels only say toxic or not. Grades of toxic documents come from how dense terms of the toxic class
    stand in them, each weighted by its odds and by how sure these are, cut at the terciles of the sample. The
    sample is put in order by its texts, so that the model is the same however the rows are dealt out.
    """
    nothing = Model({}, np.zeros(0), np.full(GRADES, 30.0))
    # The sample is bounded, so sending its ids to every task is too; its texts are read three times.
    # Equal texts count once, so that a large group of copies with one wrong label does not teach it.
    own = written(documents(docs).join(F.broadcast(sample(labels, most)), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "sample")

    def distinct(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                n = (Counter(), Counter())
                for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    of = n[int(y > 0)]
                    of.update({f for w in set(words_of(text)) for f in features_of(w)})
                    of[b""] += 1  # the empty term stands for the number of documents
                for y in (0, 1):
                    yield pa.RecordBatch.from_arrays([pa.array(list(n[y]), pa.binary()), pa.array([y] * len(n[y]), pa.int32()), pa.array(list(n[y].values()), pa.int64())], ["term", "toxic", "n"])

    counts = mapped(own, distinct, "term binary, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    counts = written(counts.where("a + b > 1 OR octet_length(term) = 0"), "terms")
    total = counts.where("octet_length(term) = 0").first()
    if total is None or not total["a"] or not total["b"]:
        return nothing
    na, nb = total["a"], total["b"]
    top = without_shorter(counts.where("octet_length(term) > 0")).withColumn("g", _g(na, nb)).orderBy(F.desc("g"), "term").limit(TERMS).collect()
    discarded(counts)
    terms = {bytes(r["term"]): k for k, r in enumerate(top)}
    if not terms:
        return nothing
    # How much more often than not a document with the term is toxic; none for terms of the other class.
    scale = np.array([r["g"] / (r["g"] + DOUBT) for r in top])
    odds = scale * np.array([max(0.0, np.log((r["a"] + 0.5) * (nb + 1) / ((r["b"] + 0.5) * (na + 1)))) for r in top])

    def hits(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                rows = []
                for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    k, n = np.unique(np.array(hits_of(text, terms), dtype=np.int64), return_counts=True)
                    rows.append((hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest(), int(y > 0), len(words_of(text)), k.astype(np.int32), n.astype(np.int32)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())])], ["name", "toxic", "n_words", "terms", "times"])

    # A row for each document of the sample, with each of the TERMS at most once.
    seen = sorted(mapped(own, hits, "name binary, toxic int, n_words long, terms array<int>, times array<int>").collect(), key=lambda r: bytes(r["name"]))
    discarded(own)
    grades = severity_grades(np.array([r["toxic"] for r in seen]), np.array([100 * odds[r["terms"]] @ np.array(r["times"], dtype=float) / max(1, r["n_words"]) if r["terms"] else 0.0 for r in seen]))
    rows = np.repeat(np.arange(len(seen)), [len(r["terms"]) for r in seen])
    cols = np.array([k for r in seen for k in r["terms"]], dtype=np.int64)
    values = np.log1p(np.array([n for r in seen for n in r["times"]], dtype=float))
    if not len(rows):
        return nothing
    w, thresholds = fit_ordinal(rows, cols, values * scale[cols], grades, len(terms))
    return Model(terms, w * scale, thresholds)


def severity_grades(toxic: np.ndarray, density: np.ndarray) -> np.ndarray:
    """0 for documents that are not toxic; toxic ones by the terciles of density among them, equal densities alike."""
    grades = np.zeros(len(toxic), dtype=np.int64)
    own = np.flatnonzero(toxic > 0)
    less = np.searchsorted(np.sort(density[own]), density[own])
    grades[own] = 1 + less * GRADES // max(1, len(own))
    return grades


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (the expected grade), grade (the median), toxic (a grade above 0 is as likely as not).

    Null or empty text: no hits. Each row is scored by its text alone, whatever its doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                p = np.array([shared.value.likelihoods(t) for t in part.column("text").to_pylist()]).reshape(-1, GRADES)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p.sum(1)), pa.array((p >= REJECT).sum(1).astype(np.int32)), pa.array(p[:, 0] >= REJECT)], ["doc_id", "severity", "grade", "toxic"])
        _memo[:] = [None, {}]  # the worker goes on to other work

    return mapped(documents(docs), score, "doc_id long, severity double, grade int, toxic boolean")


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array([bool(shared.value.likelihoods(t)[0] < REJECT) for t in part.column("text").to_pylist()], pa.bool_()))
        _memo[:] = [None, {}]  # the worker goes on to other work

    return mapped(docs, keep, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
