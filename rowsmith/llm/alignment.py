"""Alignment of two tokenizers over the same texts.

Both tokenise a text whole. Byte offsets where both have a token's end, and the next tokens of both
begin with a blank, cut it into short windows of token ids. Windows repeat all over a corpus: those of
many texts are numbered by their id tuples, and how one falls into groups, and which of its tokens
overlap, is worked out once for each number and used wherever it stands. In how many documents a pair
of ids is linked is counted over the whole corpus.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _BYTES, _PRINTABLE, KEPT, Encoder
from .common import documents, mapped, slices, table, written
from .lookup import looked_up

#: Pairs of ids, at most so many, whose counts are broadcast: about 16 MB.
FREQUENT = 500_000
#: Bytes of text whose different windows are aligned at a time.
RUN = 2_000_000
#: The longest piece between blanks, in characters, that is kept.
LONGEST = 48
#: A pair of ids is A's id times this, and B's id: B has fewer.
SHIFT = 1 << 20


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class BytePairs(Encoder):
    """A: byte-level pairs; special tokens' strings within a text are text."""

    def __init__(self, path: str):
        super().__init__(path, True)
        self.tokenizer.encode_special_tokens = True

    def token_bytes(self) -> list[bytes]:
        back = {chr(c): b for b, c in _BYTES.items()} | {chr(b): b for b in _PRINTABLE}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            out[k] = bytes(back[c] for c in token)
        return out


class Pieces(Encoder):
    """B: pieces in which a blank only begins a word, so that texts can be cut before blanks.

    Takes texts with the blank before them that the library itself adds.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library, self.blanks = sentencepiece.SentencePieceProcessor(model_file=path), True
        self.known, self.known_before = {}, {}
        pieces = self._names()
        assert not any("▁" in p.lstrip("▁") for p in pieces), "a piece goes on after a blank"
        self.blank = array("I", [pieces.index("▁")]).tobytes()

    def _names(self) -> list[str]:
        return [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]

    def token_bytes(self) -> list[bytes]:
        one = self.library
        return [bytes([int(p[3:5], 16)]) if one.is_byte(k) else b"" if one.is_control(k) or one.is_unknown(k) else p.replace("▁", " ").encode() for k, p in enumerate(self._names())]

    def _marked(self, text: str) -> str | None:
        if "\0" in text or "▁" in text:  # the latter is a blank to the library
            return None
        if "  " not in text:
            return text.replace(" ", "\0 ")
        # Several blanks may be one piece: they are cut before the first only.
        return text.replace(" ", "\0 ").replace(" \0 ", "  ").replace(" \0 ", "  ")

    def _ids(self, texts: list[str]) -> list[bytes]:
        # The library adds a blank, but not to nothing.
        rows = self.library.encode([t[1:] for t in texts], num_threads=1)
        return [array("I", ids).tobytes() if len(t) > 1 else self.blank if t else b"" for t, ids in zip(texts, rows)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > KEPT:
            self.known, self.known_before = {}, self.known
        known, before, hard, out = self.known, self.known_before, [], []
        for p in pieces:
            if (ids := known.get(p)) is None:
                if (ids := before.get(p)) is None:
                    hard.append(len(out))
                    out.append(b"")
                    continue
                known[p] = ids
            out.append(ids)
        for a in range(0, len(hard), 2000):
            some = hard[a : a + 2000]
            for k, ids in zip(some, self._ids([pieces[k] for k in some])):
                out[k] = ids
                if len(pieces[k]) <= LONGEST:
                    known[pieces[k]] = ids
        return out


def _binary(parts: list[bytes]):
    import pyarrow as pa

    return pa.array(parts, pa.large_binary())


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_binary array, and where each value begins and the last ends."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    own = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return own, at - at[0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1 ... for sizes[0] numbers, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Aligner:
    _own: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a: str, b: str):
        self.a, self.b = BytePairs(a), Pieces(b)
        bytes_a, bytes_b = self.a.token_bytes(), self.b.token_bytes()
        assert len(bytes_b) <= SHIFT
        self.table_a, self.table_b = _binary(bytes_a), _binary(bytes_b)
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (bytes_a, bytes_b))
        # Each id as it is written: A's within and at the end of its side of a group, then B's.
        self.numbers = _binary([f"{k}{mark}".encode() for n, last in ((len(bytes_a), "|"), (len(bytes_b), ";")) for k in range(n) for mark in (",", last)])

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        if (a, b) not in cls._own:
            cls._own[a, b] = cls(a, b)
        return cls._own[a, b]

    def _windows(self, keys) -> tuple:
        """What different windows come to, all at once: keys hold the number of A's ids, A's ids and B's ids.

        The text of each one's groups, the pairs that overlap, where each window's pairs begin, and how many
        groups each has.
        """
        import pyarrow as pa

        data, at = _flat(keys)
        flat, at = data.view("<u4"), at // 4
        n_a = flat[at[:-1]].astype(np.int64)
        n_b = np.diff(at) - 1 - n_a
        a, b = flat[_spread(at[:-1] + 1, n_a)], flat[_spread(at[:-1] + 1 + n_a, n_b)]
        length_a, length_b = self.length_a[a], self.length_b[b]
        ends_a, ends_b = np.cumsum(length_a), np.cumsum(length_b)
        ends = np.concatenate([[0], ends_a])[np.cumsum(n_a)]  # of the windows
        both = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, dtype=np.uint8)
        both[ends_a] = 1
        both[ends_b] += 1
        groups = np.cumsum(both == 2)
        # Between one end and the next there is one token of either side: a pair that overlaps.
        bounds = np.flatnonzero(both)
        pairs = a[np.searchsorted(ends_a, bounds)].astype(np.int64) * SHIFT + b[np.searchsorted(ends_b, bounds)]
        pair_at = np.concatenate([[0], np.searchsorted(bounds, ends, "right")])
        n_groups = np.diff(np.concatenate([[0], groups[ends]]))
        # The tokens of a group stand together, A's first; the last of either side has another mark behind it.
        group_a, group_b = groups[ends_a - length_a], groups[ends_b - length_b]
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a.astype(np.int64) + (both[ends_a] == 2)
        codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * (len(self.length_a) + b.astype(np.int64)) + (both[ends_b] == 2)
        text, places = _flat(self.numbers.take(pa.array(codes)))
        cuts = places[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        texts = pa.Array.from_buffers(pa.large_binary(), len(n_a), [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(text)])
        return texts, pairs, pair_at, n_groups

    def _tokens(self, encoder: Encoder, table, texts: list[str]):
        """Ids of all texts, how many each has, and which texts the ids' bytes give back."""
        import pyarrow as pa

        parts = encoder.encode(texts)
        counts = np.array([len(p) // 4 for p in parts], dtype=np.int64)
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        data, at = _flat(table.take(pa.array(ids)))
        cuts = at[np.concatenate([[0], np.cumsum(counts)])].tolist()
        view = memoryview(data)
        same = np.array([view[x:y] == t.encode() for x, y, t in zip(cuts, cuts[1:], texts)], dtype=bool)
        return ids, counts, same

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For texts that are not empty: counts, digests and linked pairs of each; zeros where bytes are not given back."""
        import pyarrow as pa

        n = len(texts)
        texts = [" " + t for t in texts]
        ids_a, count_a, same_a = self._tokens(self.a, self.table_a, texts)
        ids_b, count_b, same_b = self._tokens(self.b, self.table_b, texts)
        same = same_a & same_b
        ids_a, ids_b = ids_a[np.repeat(same, count_a)], ids_b[np.repeat(same, count_b)]
        count_a, count_b = np.where(same, count_a, 0), np.where(same, count_b, 0)
        data = np.frombuffer(b"".join(t.encode() for t, s in zip(texts, same) if s), dtype=np.uint8)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        both = np.zeros(len(data) + 1, dtype=np.uint8)
        both[ends_a] = 1
        both[ends_b] += 1
        shared = np.flatnonzero(both == 2)
        # The text after this one begins with a blank too, so its end is such a place as well.
        anchors = shared[(shared == len(data)) | (data[np.minimum(shared, max(len(data) - 1, 0))] == 32)] if len(data) else shared
        doc_ends_a = np.cumsum(count_a)
        text_ends = np.concatenate([[0], ends_a])[doc_ends_a]
        to_a, to_b = np.searchsorted(ends_a, anchors) + 1, np.searchsorted(ends_b, anchors) + 1
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        sizes = 1 + to_a - from_a + to_b - from_b
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        keys = np.empty(at[-1], dtype="<u4")
        keys[at[:-1]] = to_a - from_a
        keys[_spread(at[:-1] + 1, to_a - from_a)] = ids_a
        keys[_spread(at[:-1] + 1 + to_a - from_a, to_b - from_b)] = ids_b
        numbered = pa.Array.from_buffers(pa.large_binary(), len(anchors), [None, pa.py_buffer(at * 4), pa.py_buffer(keys)]).dictionary_encode()
        which = numbered.indices.to_numpy()
        written_out, window_pairs, pair_at, window_groups = self._windows(numbered.dictionary)
        windows = len(numbered.dictionary)
        # Windows of each text, and text of each window.
        bounds = np.concatenate([[0], np.searchsorted(anchors, text_ends, "right")])
        of = np.repeat(np.arange(n), np.diff(bounds))

        groups, places = _flat(written_out.take(pa.array(which)))
        cuts, view = places[bounds].tolist(), memoryview(groups)
        digests = [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]
        n_groups = np.bincount(of, weights=window_groups[which], minlength=n).astype(np.int64)

        # Each text's different windows and how often; then each text's different pairs and how often.
        seen, times = np.unique(of * max(windows, 1) + which, return_counts=True)
        doc, window = np.divmod(seen, max(windows, 1))
        pairs, local = np.unique(window_pairs, return_inverse=True)
        each = np.diff(pair_at)[window]
        cells = np.repeat(doc, each) * max(len(pairs), 1) + local[_spread(pair_at[:-1][window], each)]
        cells, inverse = np.unique(cells, return_inverse=True)
        links = np.bincount(inverse, weights=np.repeat(times, each), minlength=len(cells)).astype(np.int64)
        doc, pair = np.divmod(cells, max(len(pairs), 1))
        return {"n_a": count_a, "n_b": count_b, "n_groups": n_groups, "n_links": count_a + count_b - n_groups, "groups_sha256": digests, "pairs": pairs[pair], "links": links, "sizes": np.bincount(doc, minlength=n)}


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the pairs of ids that are linked (a, b, how often); a row a document.

    Null or empty text, and one that either tokenizer's bytes do not give back (say, with U+2581 in it):
    zeros, '' and no pairs. Doc_ids may repeat or lack; the key tells rows apart.
    """

    def align(batches):
        import pyarrow as pa

        names = ["n_a", "n_b", "n_groups", "n_links"]
        for batch in batches:
            for part in slices(batch, RUN):
                texts = part.column("text").to_pylist()
                full = [k for k, t in enumerate(texts) if t]
                out = Aligner.of(a, b).align([texts[k] for k in full])
                n = len(texts)
                digests = [""] * n
                for k, d in zip(full, out["groups_sha256"]):
                    digests[k] = d
                columns = []
                for name in [*names, "sizes"]:
                    c = np.zeros(n, dtype=np.int64)
                    c[full] = out[name]
                    columns.append(c)
                offsets = pa.array(np.concatenate([[0], np.cumsum(columns.pop())]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (out["pairs"] // SHIFT, out["pairs"] % SHIFT, out["links"])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns), pa.array(digests, pa.string()), *lists], ["doc_id", *names, "groups_sha256", "a", "b", "times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
    return written(mapped(documents(docs), align, schema).withColumn("key", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of A's id has more)."""
    pairs = rows.select(F.expr("inline(arrays_zip(a, b))")).groupBy("a", "b").agg(F.count("*").alias("n"))
    counts = written(pairs, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each of A's ids at most
    return written(counts.join(F.broadcast(most), "a").select((F.col("a").cast("long") * SHIFT + F.col("b")).alias("pair"), "n", (F.col("n") == F.col("most")).alias("best")), "best-pairs")


def scored(rows: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The rows of aligned() with n_best and count_sum, without their pairs.

    The counts of frequent pairs are broadcast, the rest is joined by pair; each document's sums are
    partial ones before they are shuffled.
    """
    carried = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    pairs = rows.select("key", F.expr("inline(arrays_zip(a, b, times))")).select("key", (F.col("a").cast("long") * SHIFT + F.col("b")).alias("pair"), "times")
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.select(*carried).dtypes]
    sums = [rows.select("key", *carried, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))]
    for part in looked_up(pairs, pair_counts(rows), ["pair"], "n", frequent):
        if part is not None:
            own = part.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
            sums.append(own.select("key", *none, "n_best", "count_sum"))
    united = sums[0]
    for more in sums[1:]:
        united = united.union(more)
    # Whole rows come once a key, sums as often as there are parts.
    return united.groupBy("key").agg(*[F.max(c).alias(c) for c in carried], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).drop("key")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    out = scored(aligned(table(spark, sf_dir, "documents"), byte_tokenizer(), piece_tokenizer()))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
