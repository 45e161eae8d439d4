"""Token ids of whole texts, with the ids of frequent words kept.

The tokenizers library gives every id; this module only cuts a text where the pre-tokenizer surely
cuts it too, and asks the library once for each distinct piece.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

#: A blank whose boundary depends on more than its neighbours: white space before it, and after it white space or the end.
AMBIGUOUS = re.compile(r"\s (?:\s|\Z)")
DOUBLE = re.compile(r"\s\s")
#: Letters of the Latin blocks with ASCII punctuation behind them: the pre-tokenizers cut these in two.
SIMPLE = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")
# Fixed values of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
BLANK = chr(_BYTES[32])
assert array("I").itemsize == 4 and sys.byteorder == "little"
#: Pieces of one generation kept by a worker, two at most, and the longest that is kept.
KEPT, LONGEST = 200_000, 48

_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    blanks: whether the tokenizer keeps white space (a blank then belongs to the word after it).
    """

    def __init__(self, path: str, blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks = Tokenizer.from_file(path), blanks
        self.known, self.stems, self.tails = {}, {}, {"": b""}
        self.known_before, self.stems_before = {}, {}
        self.model = self.tokenizer.model

    @classmethod
    def of(cls, path: str, blanks: bool) -> Encoder:
        if (path, blanks) not in _encoders:
            _encoders[path, blanks] = cls(path, blanks)
        return _encoders[path, blanks]

    def _marked(self, text: str) -> str | None:
        """The text with a mark wherever it is cut; None if it is not cut at all."""
        if not self.blanks:
            return text.replace("\n", " ")
        if "\0" in text or AMBIGUOUS.search(text):
            return None
        if not DOUBLE.search(text):
            text = text.replace("\n", "\0\n\0")
        return text.replace(" ", "\0 ")

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _stem(self, blank: str, stem: str) -> bytes:
        """Ids of letters, one pre-token that goes to the model as it is."""
        if not self.blanks:
            stem = stem.lower()
        mapped = (BLANK + stem if blank else stem) if stem.isascii() else (blank + stem).encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _tail(self, tail: str) -> bytes:
        """Ids of the punctuation after a word."""
        if tail not in self.tails:
            if len(self.tails) > KEPT:
                self.tails = {"": b""}
            self.tails[tail] = self._ids([tail])[0]
        return self.tails[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts are cut into pieces and these numbered all at once; what is asked and
        kept for a piece is done once for each different one."""
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = [self._marked(t) for t in texts]
        cut = pc.split_pattern(pa.array([m for m in marked if m is not None], pa.large_string()), "\0" if self.blanks else " ")
        numbers = pc.dictionary_encode(cut.values)
        of_piece = self._pieces(numbers.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in of_piece], dtype=np.int64)
        flat = np.frombuffer(b"".join(of_piece), dtype="<u4")
        which = numbers.indices.to_numpy()
        each = sizes[which]
        ends = np.cumsum(each)
        # Where the ids of each piece stand in flat, less where they come to stand.
        shift = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - each), each)
        ids = flat[shift + np.arange(len(shift))]
        bounds = np.concatenate([[0], ends])[cut.offsets.to_numpy()]
        done = iter(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        whole = iter(self._ids([t for t, m in zip(texts, marked) if m is None]))
        out = []
        for m in marked:
            if m is None:
                out.append(next(whole))
            else:
                x, y = next(done)
                out.append(ids[x:y].tobytes())
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces."""
        # What is used again moves on from the generation before, so frequent pieces stay known.
        if len(self.known) > KEPT:
            self.known, self.known_before = {}, self.known
        if len(self.stems) > KEPT:
            self.stems, self.stems_before = {}, self.stems
        hard, out = [], []
        known, before, stems, stems_before, match = self.known, self.known_before, self.stems, self.stems_before, SIMPLE.fullmatch
        for p in pieces:
            if (ids := known.get(p)) is None:
                if (ids := before.get(p)) is None:
                    # Some capitals are a letter and a mark in lower case; the mark then belongs to what follows.
                    if len(p) > LONGEST or not (m := match(p)) or not (p.isascii() or m[2].lower().isalpha()):
                        hard.append(len(out))
                        out.append(b"")
                        continue
                    blank, stem, tail = m.groups()
                    key = blank + stem
                    if (ids := stems.get(key)) is None:
                        ids = stems[key] = stems_before.get(key) or self._stem(blank, stem)
                    if tail:
                        ids += self._tail(tail)
                known[p] = ids
            out.append(ids)
        for a in range(0, len(hard), 2000):
            some = hard[a : a + 2000]
            for k, ids in zip(some, self._ids([pieces[k] for k in some])):
                out[k] = ids
                if len(pieces[k]) <= LONGEST:
                    known[pieces[k]] = ids
        return out
