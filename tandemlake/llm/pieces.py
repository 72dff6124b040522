"""Unigram segmentation over the pieces of a SentencePiece model file.

An Aho-Corasick automaton over all pieces reads a text once; at each place it reports the pieces that end
there, longest first (its output links), and each relaxes the best score of that place. This is the model's
own rule on ties: of equal scores the earliest start wins. A character that no piece covers alone is the
unknown piece, ten below the least score, and becomes its UTF-8 bytes where the model has byte pieces.

Scores: a file of unigram type is used as it is. The scores of a BPE file are merge priorities, not
log-probabilities; for such a file piece number r in order of priority gets the Zipf log-probability
-log((r + 1) * H), H the harmonic sum over all pieces, rounded to 1/16. Sums of sixteenths are exact in
floating point, so results depend neither on the length of a text nor on where it is cut.

A text is cut, with the same result, wherever no piece has the two neighbouring characters within it; so words, and parts
of long words, are segmented one by one, and each distinct one once. A part may be of any length.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import SparkSession

#: SentencePiece's mark for a space.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct words kept by a worker; then it starts anew.
CACHE_WORDS = 300_000
#: Longer words are not kept; they are cut into parts, which are.
MEMO_CHARS = 64
#: The setting of a session that names the model file for queries and stages, and the file where it names none.
MODEL_SETTING, DEFAULT_MODEL = "spark.tandemlake.pieceModel", "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class PieceModel:
    """What a model file says: pieces (text, score, kind) by id, and how texts are prepared."""

    pieces: tuple[tuple[str, float, int], ...]
    model_type: int
    byte_fallback: bool
    dummy_prefix: bool
    squeeze_spaces: bool

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2):
            raise ValueError("models with a character map are not supported: texts must be normalised first")
        model = cls(tuple(pieces), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))
        return model.with_zipf_scores() if model.model_type == BPE else model

    def with_zipf_scores(self) -> PieceModel:
        order = sorted((k for k, p in enumerate(self.pieces) if p[2] == NORMAL), key=lambda k: (-self.pieces[k][1], k))
        total = math.log(sum(1 / (r + 1) for r in range(len(order))))
        scores = {k: -round(16 * (math.log(r + 1) + total)) / 16 for r, k in enumerate(order)}
        return PieceModel(tuple((t, scores.get(k, 0.0), kind) for k, (t, _, kind) in enumerate(self.pieces)), UNIGRAM, self.byte_fallback, self.dummy_prefix, self.squeeze_spaces)


def read_model(spark: SparkSession, path: str | None = None) -> PieceModel:
    """The model file (well under a megabyte for usual vocabularies), read by Spark so that any store will do."""
    path = path or spark.conf.get(MODEL_SETTING, DEFAULT_MODEL)
    found = spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").head()
    return PieceModel.parse(bytes(found[0]))


class _Memo(dict):
    """Values of a function, kept for the shorter words until there are CACHE_WORDS of them."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute = compute

    def __missing__(self, word: str):
        value = self.compute(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= MEMO_CHARS:
            self[word] = value
        return value


class Pieces:
    """A model ready for use in a worker."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        normal = [s for _, s, kind in model.pieces if kind == NORMAL]
        least, most = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown_score = least - 10
        self.unknown = next((k for k, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
        usable = [(k, t, s if kind == NORMAL else len(t.encode()) * most - 0.1) for k, (t, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER) and t]
        for k, t, s in usable or [(self.unknown, "\0\0", -math.inf)]:
            self.automaton.add_word(t, (len(t), s, k))
        self.automaton.make_automaton()
        self.singles = {t for _, t, _ in usable if len(t) == 1}
        #: Neighbours within some piece: between any others a text can be cut without changing the best segmentation.
        self.inside = {t[i : i + 2] for _, t, _ in usable for i in range(len(t) - 1)}
        self.bytes = {int(t[3:5], 16): k for k, (t, _, kind) in enumerate(model.pieces) if kind == BYTE} if model.byte_fallback else {}
        self.separable = SPACE in self.singles and all(p[0] == SPACE == p[1] or p[1] != SPACE for p in self.inside)
        self._cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self._part_ids, self._part_counts = _Memo(self._segment), _Memo(self._count)
        self._ids = _Memo(lambda w: self._segment(w) if len(w) <= MEMO_CHARS else b"".join(map(self._part_ids.__getitem__, self._parts(w))))
        self._counts = _Memo(lambda w: self._count(w) if len(w) <= MEMO_CHARS else tuple(map(sum, zip(*map(self._part_counts.__getitem__, self._parts(w)), strict=True))))
        self._texts = [self._shown(t, kind) for t, _, kind in model.pieces]

    def _words(self, text: str) -> list[str]:
        """Parts of a text, prepared, that no piece crosses."""
        if self.model.squeeze_spaces:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        if self.separable and self.model.dummy_prefix:
            words = text.split(" ")
            if "" not in words and SPACE not in text:
                return [SPACE + w for w in words]
        text = (" " + text if self.model.dummy_prefix else text).replace(" ", SPACE)
        return self._cut.findall(text) if self.separable else [text]

    def _parts(self, word: str) -> list[str]:
        """A word cut where no piece has such neighbours; whole if unknown characters have to be merged over cuts."""
        if not self.bytes:
            return [word]
        inside = self.inside
        cuts = [i for i, pair in enumerate(map(str.__add__, word, word[1:]), 1) if pair not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _matches(self, part: str) -> Iterator[tuple[int, tuple[int, float, int]]]:
        """(last place, (length, score, id)) in order of the end, longer ones first. Where no piece is a character alone,
        the unknown piece stands as the last match there."""
        if self.singles.issuperset(part):
            yield from self.automaton.iter(part)
            return
        place = 0
        unknown = (1, self.unknown_score, -1)
        for last, match in self.automaton.iter(part):
            while place < last:
                if part[place] not in self.singles:
                    yield place, unknown
                place += 1
            yield last, match
        for rest in range(place, len(part)):
            if part[rest] not in self.singles:
                yield rest, unknown

    def _segment(self, part: str) -> bytes:
        """Ids of the best segmentation, as packed 32-bit integers."""
        best = [0.0] + [-math.inf] * len(part)
        back: list[tuple[int, float, int]] = [(0, 0.0, 0)] * (len(part) + 1)
        for last, match in self.automaton.iter(part) if self.singles.issuperset(part) else self._matches(part):
            score = best[last + 1 - match[0]] + match[1]
            if score > best[last + 1]:
                best[last + 1] = score
                back[last + 1] = match
        out: list[int] = []
        end = len(part)
        while end:
            size, _, k = back[end]
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(part[end - size : end].encode()))
            elif not (out and out[-1] == self.unknown):  # neighbouring unknown characters are one piece
                out.append(self.unknown)
            end -= size
        out.reverse()
        return array("i", out).tobytes()

    def _count(self, part: str) -> tuple[float, int]:
        """Best score and its number of pieces: these two are carried, no piece is kept and no way walked back."""
        best = [0.0] + [-math.inf] * len(part)
        count = [0] * (len(part) + 1)
        if self.singles.issuperset(part):
            for last, (size, score, _) in self.automaton.iter(part):
                score += best[last + 1 - size]
                if score > best[last + 1]:
                    best[last + 1] = score
                    count[last + 1] = count[last + 1 - size] + 1
            return best[-1], count[-1]
        unknown = [False] * (len(part) + 1)
        for last, (size, score, k) in self._matches(part):
            end, start = last + 1, last + 1 - size
            score += best[start]
            if score > best[end]:
                best[end], unknown[end] = score, k < 0
                more = 1 if k >= 0 else len(part[start:end].encode()) if self.bytes else int(not unknown[start])
                count[end] = count[start] + more
        return best[-1], count[-1]

    def packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        return b"".join(map(self._ids.__getitem__, self._words(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def count(self, text: str) -> tuple[int, float]:
        """Number of pieces and total score."""
        words = self._words(text)
        if not words:
            return 0, 0.0
        scores, counts = zip(*map(self._counts.__getitem__, words), strict=True)
        return sum(counts), sum(scores)

    @staticmethod
    def _shown(text: str, kind: int) -> str | None:
        """What a piece stands for in a text; None for a byte that is no character alone."""
        if kind == BYTE:
            value = int(text[3:5], 16)
            return chr(value) if value < 0x80 else None
        return " \u2047 " if kind == UNKNOWN else "" if kind == CONTROL else text.replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are not UTF-8 become U+FFFD, as the library has it."""
        shown = list(map(self._texts.__getitem__, ids))
        if None in shown:
            held = bytearray()
            for i, k in enumerate(ids):
                if shown[i] is None:
                    held.append(int(self.model.pieces[k][0][3:5], 16))
                    shown[i] = ""
                    if i + 1 == len(ids) or shown[i + 1] is not None:
                        shown[i] = held.decode("utf-8", "replace")
                        held.clear()
        text = "".join(shown)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text
