"""Personal data: fixed base patterns, and spans that weak supervision adds to them.

Labelers of three kinds vote on candidate spans, for, against or not at all: patterns (the form of the
span, how varied it is, its check digit), gazetteers (prefixes of keys, issuers and countries; words that
name personal data) and contexts (assignments, quotes, what stands around). For each kind of span
expectation-maximisation over the counts of vote patterns in the whole corpus estimates how far each
labeler can be trusted and how likely each pattern is personal; a logistic span classifier is then
trained on these soft labels. Both work on counts by pattern, whose number is fixed by the labelers and
features, not by the corpus.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, documents, mapped, slices, table, with_n_chars, written

KINDS = ["email", "ip", "card", "phone", "secret"]
_RANK = {k: i for i, k in enumerate(KINDS)}
# The base patterns. Where a match could start inside a run of digits, the whole run has
# failed or was taken before, so looking back keeps the matches and makes the search linear.
_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each reaches from an @ back over its local part, not into the match before."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        m = _EMAIL_REST.match(text, at) if a < at else None
        if m:
            found.append((a, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) in code points, ascending."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # A long run of digits is no part of an address, and int() need not read it.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# Candidates beyond the base, each pattern with the rank of its kind.
_ASSIGNED = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)s?\b[\"']?[ ]?[=:][ ]?[\"']?([^\s\"',;]{6,})")
_HEX = re.compile(r"(?i)\b(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}+\b")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_DIGITS = re.compile(r"(?<![0-9.])[0-9]{9,19}(?![0-9.])")
# Gazetteers, fixed values: words that name a secret, a phone or a card; beginnings of known keys, of the
# numbers of card issuers, and of national numbers that are in use.
NAMES = {
    4: frozenset("password passwd passphrase pwd pass token secret key apikey auth credential credentials bearer private access session cookie jwt pin otp".split()),
    3: frozenset("tel telephone phone call fax mobile cell contact whatsapp hotline number portable handy telefon telefono numero".split()),
    2: frozenset("card visa mastercard amex account iban payment credit debit konto carte tarjeta cuenta compte".split()),
}
KEY_BEGINNINGS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "SG.", "-----BEGIN")
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "36", "38", "35", "6011", "65", "62")
NO_AREA = ("0", "1", "37", "96")
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z]{0,4}\Z")
_ASSIGNMENT = re.compile(r"[=:][ ]?[\"']?\Z")
LABELERS = ("shape", "beginnings", "names", "assignment", "variety", "surroundings")


def _vote(text: str, kind: int, a: int, b: int) -> str:
    """A vote of each labeler: + for, - against, 0 none; then the features of the span."""
    span, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 1]
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    variety = len(set(span)) / max(1, min(len(span), 16))
    if kind == 4:
        shape = "+" if digits >= 3 and letters >= 3 and len(span) >= 12 else "-" if digits == 0 else "0"
        known = "+" if span.startswith(KEY_BEGINNINGS) else "0"
        varied = "+" if variety >= 0.5 and digits else "-" if variety < 0.3 else "0"
    elif kind == 3:
        shape = "+" if 9 <= digits <= 15 and len(span) > digits else "-"
        known = "-" if span.lstrip("(").startswith(NO_AREA) else "+"
        varied = "+" if len(set(span)) >= 4 else "-"
    else:
        shape = "+" if 12 <= digits <= 19 else "-"
        known = "+" if span.startswith(ISSUERS) else "-"
        varied = "+" if luhn(span) else "-"
    word = _WORD_BEFORE.search(before)
    named = "+" if word and word[1].lower() in NAMES[kind] else "0"
    assigned = "+" if _ASSIGNMENT.search(before) else "-" if kind == 4 else "0"
    around = "+" if (before[-1:] in {"=", '"', "'", "("} or after in {'"', "'", ")"}) else "-" if after == "." and kind != 3 else "0"
    size = min(len(span) // 8, 6)
    return f"{shape}{known}{named}{assigned}{varied}{around}|{KINDS[kind]}|{size}|{4 * digits // max(1, len(span))}|{int(4 * variety)}"


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, votes and features) of spans that touch no base span nor each other."""
    found = []
    for pattern, kind, group in ((_ASSIGNED, 4, 1), (_HEX, 4, 0), (_NATIONAL, 3, 0), (_DIGITS, 2, 0)):
        if kind == 4 and group and "=" not in text and ":" not in text:
            continue
        found += [(m.start(group), kind, m.end(group)) for m in pattern.finditer(text)]
    out, end = [], -1
    taken = sorted(base)
    i, reach = 0, -1
    for a, kind, b in sorted(found, key=lambda x: (x[0], -x[2])):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][2])
            i += 1
        if a >= end and a >= reach:
            out.append((a, kind, b, _vote(text, kind, a, b)))
            end = b
    return out


def reliabilities(counts: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, float]:
    """Expectation-maximisation over vote patterns: the posterior of each, the vote likelihoods, the prior.

    Two classes; a labeler votes +, - or 0 with its own likelihoods in each. The start takes the
    majority of votes, which also says which class is the personal one.
    """
    patterns = sorted(counts)
    votes = np.array([["+-0".index(v) for v in p] for p in patterns], dtype=int).reshape(len(patterns), -1)
    n = np.array([counts[p] for p in patterns], dtype=float)
    post = 1 / (1 + np.exp(-1.5 * ((votes == 0).sum(1) - (votes == 1).sum(1))))
    likely, prior = np.full((2, votes.shape[1], 3), 1 / 3), 0.5
    for _ in range(rounds):
        for y, weight in enumerate((n * (1 - post), n * post)):
            for j in range(votes.shape[1]):
                own = np.bincount(votes[:, j], weights=weight, minlength=3) + 1.0
                likely[y, j] = own / own.sum()
        prior = float(np.clip((n * post).sum() / max(n.sum(), 1), 0.01, 0.99))
        score = np.log(prior / (1 - prior)) + sum(np.log(likely[1, j, votes[:, j]] / likely[0, j, votes[:, j]]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        done, post = np.abs(new - post).max(initial=0) < 1e-6, new
        if done:
            break
    return dict(zip(patterns, post.tolist())), likely, prior


def _features(label: str) -> list[str]:
    votes, *rest = label.split("|")
    return ["bias", *(f"v{i}{v}" for i, v in enumerate(votes)), *(f"f{i}{v}" for i, v in enumerate(rest)), *(f"k{rest[0]}{i}{v}" for i, v in enumerate(votes))]


def classifier(counts: dict[str, int], steps: int = 400) -> dict[str, float]:
    """The trained span classifier as its probability for each pattern of votes and features."""
    if not counts:
        return {}
    # A labeler may be good for one kind of span and poor for another.
    by_votes: dict[str, dict[str, int]] = {}
    for label, n in counts.items():
        votes, kind = label.split("|")[:2]
        own = by_votes.setdefault(kind, {})
        own[votes] = own.get(votes, 0) + n
    soft = {kind: reliabilities(own)[0] for kind, own in by_votes.items()}
    labels = sorted(counts)
    names = {f: i for i, f in enumerate(sorted({f for p in labels for f in _features(p)}))}
    x = np.zeros((len(labels), len(names)))
    for i, p in enumerate(labels):
        for f in _features(p):
            x[i, names[f]] = 1
    y, n = np.array([soft[p.split("|")[1]][p.split("|")[0]] for p in labels]), np.array([counts[p] for p in labels], dtype=float)
    n = n / n.sum()
    w, m, v = np.zeros(len(names)), 0, 0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (n * (p - y)) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return dict(zip(labels, (1 / (1 + np.exp(-x @ w))).tolist()))


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, candidates with their votes; one pass over the texts, written once."""

    def find(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("votes", pa.string())])
        for batch in batches:
            for part in slices(batch):
                base_rows, more_rows = [], []
                for text in part.column("text").to_pylist():
                    base = base_spans(text or "")
                    base_rows.append([{"start": a, "kind": k, "end": b, "votes": None} for a, k, b in base])
                    more_rows.append([{"start": a, "kind": k, "end": b, "votes": v} for a, k, b, v in candidates(text or "", base)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(base_rows, pa.list_(span)), pa.array(more_rows, pa.list_(span))], ["doc_id", "base", "more"])

    kind = "array<struct<start:long,kind:int,end:long,votes:string>>"
    return written(mapped(documents(docs), find, f"doc_id long, base {kind}, more {kind}"), "candidates")


def trained(found: DataFrame) -> dict[str, float]:
    """The classifier from the candidates of the whole corpus; counts by pattern, bounded by their number."""
    rows = found.select(F.explode("more").alias("m")).groupBy("m.votes").agg(F.count("*").alias("n")).collect()
    return classifier({r["votes"]: r["n"] for r in rows})


def detected(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row a document with its spans. Null or empty text has none.

    Each row counts by its text alone: equal rows, and rows of one doc_id or none, give a row each.
    """
    found = extracted(docs)
    accepted = docs.sparkSession.sparkContext.broadcast(frozenset(p for p, q in trained(found).items() if q >= least))

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, base, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "more"))):
                own = [(s["start"], s["kind"], s["end"]) for s in base]
                added = [(s["start"], s["kind"], s["end"]) for s in more if s["votes"] in accepted.value]
                n = [sum(k == i for _, k, _ in own) for i in range(4)]
                rows.append((doc_id, *n, hashlib.sha256(joined(own).encode()).hexdigest(), joined(sorted(own + added)), len(added)))
            if rows:
                types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return mapped(found, finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted_text(text: str | None, accepted: frozenset[str]) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted(base + [(a, k, b) for a, k, b, v in candidates(text, base) if v in accepted])
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with the personal data of their texts redacted; all rows and columns stay."""
    found = extracted(docs)
    accepted = docs.sparkSession.sparkContext.broadcast(frozenset(p for p, q in trained(found).items() if q >= least))
    discarded(found)

    def redact(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array([redacted_text(t, accepted.value) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    return with_n_chars(mapped(docs, redact, docs.schema))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(table(spark, sf_dir, "documents"))
