"""SentencePiece byte-pair encoding and decoding, from a model file.

A text's pieces are what merging neighbours gives: again and again the pair whose joined string has
the highest score, the leftmost of equals, until no pair's string is a piece. Some chain of pieces
is that result exactly if each two neighbours, merged alone from their characters, come out as
these two: up to the first merge across a bound, merges right and left of it happen in the order in
which they would happen without the rest. So each prefix of a text has one last piece: the one that
ends there and goes with the last piece of the prefix before it. An automaton over all pieces finds
those that end at a place, the pair test picks the one, a table keeps its length, and from the
text's end the table is walked backwards. Pieces of a character that is not in the vocabulary become
its bytes.

In most vocabularies a white-space mark stands only at the front of a piece, punctuation never behind
a letter, and some characters in no longer piece at all; that is read from the vocabulary. Texts are
cut there into spans that no merge crosses, and a worker keeps the ids of short spans it has seen,
up to a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise
from pathlib import Path
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import drop_existing, missing
from railside.llm.words import small_batches

#: Stands for a space.
MARK = "▁"
#: What an unknown piece decodes to.
UNKNOWN_SURFACE = " ⁇ "
#: Kinds of pieces in a model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Spans that a worker remembers in each of two generations, the longest of them (characters), and pairs.
REMEMBERED, SHORT, PAIRS = 1 << 18, 64, 1 << 20
#: Characters that are cut into spans at once.
STEP = 1 << 16


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message: number, and a number or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind)
        size = number() if size is None else size
        yield key >> 3, raw[at : at + size]
        at += size


@dataclass(frozen=True)
class Vocabulary:
    """The pieces of a model by id: strings, scores and kinds; and how texts are prepared."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool = True
    begin: int = 1
    end: int = 2
    #: What workers cache by.
    name: str = field(default="", compare=False)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a model file on the driver: byte-pair models with byte fallback and no rewriting of characters."""
        raw = Path(path).read_bytes()
        pieces, scores, kinds, model, trainer, normaliser = [], [], [], 1, {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        model = trainer.get(3, 1)
        if model != 2 or not trainer.get(35, 0) or normaliser.get(2, b"") or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24, 0) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only byte-pair models with byte fallback that keep characters and spaces as they are, without user-defined or unused pieces")
        if BYTE not in kinds:
            raise ValueError("the model has no byte pieces")
        return cls(tuple(pieces), tuple(scores), tuple(kinds), bool(normaliser.get(3, 1)), trainer.get(41, 1), trainer.get(42, 2), hashlib.sha256(raw).hexdigest())


class Pieces:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k == NORMAL}
        self.scores = {p: v.scores[i] for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.bytes = {i: b for b, i in enumerate(self.byte_ids)}
        self.neighbours = [_Neighbours(self, p) for p in sorted({*self.ids, *"".join(self.ids)})]  # characters that are parts of pieces only, too
        self.automaton = ahocorasick.Automaton()
        for n in self.neighbours:
            self.automaton.add_word(n.piece, (n, len(n.piece), n.piece))
        self.automaton.make_automaton()
        self.surfaces = ["" if k == CONTROL else UNKNOWN_SURFACE if k == UNKNOWN else p.replace(MARK, " ") for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.spans = self._span_pattern()
        self.seen = _Seen(self._span_ids)
        self.histories: dict[str, list[tuple[float, str, str]]] = {}
        self.verdicts = 0

    def _span_pattern(self) -> re.Pattern:
        """Spans that no piece crosses, as far as the vocabulary tells.

        They are: marks, then characters that stand behind no other kind of character in any piece (as
        punctuation does), then the other characters that join; or one character that joins nothing.
        """
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        joins = set("".join(pairs))
        fronts = {c for c in joins if not c.isalpha()}
        while late := {y for x, y in pairs if y in fronts and x not in fronts} | {y for x, y in pairs if y == MARK in fronts and x != MARK}:
            fronts -= late
        marks = MARK if MARK in fronts else ""
        several = lambda chars: f"[{''.join(map(re.escape, sorted(chars)))}]" if chars else "(?!)"
        front, rest = several(fronts - {marks}), several(joins - fronts)
        lead = f"{marks}*" if marks else ""
        return re.compile(f"{lead}{front}*{rest}+|{lead}{front}+|{several({marks} - {''})}+|.", re.DOTALL)

    def history(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges that make a piece from its characters, in order: score, and the first and last symbol before it."""
        if (known := self.histories.get(piece)) is not None:
            return known
        symbols, out = list(piece), []
        while len(symbols) > 1:
            pairs = [(self.scores[a + b], -i) for i, (a, b) in enumerate(pairwise(symbols)) if a + b in self.scores]
            if not pairs:
                break
            score, left = max(pairs)
            out.append((score, symbols[0], symbols[-1]))
            symbols[-left : 2 - left] = ["".join(symbols[-left : 2 - left])]
        # a piece that merging does not make goes with nothing
        self.histories[piece] = out = out if len(symbols) == 1 else [(float("inf"), "", "")]
        return out

    def together(self, left: str, right: str) -> bool:
        """Whether the characters of two neighbours, merged alone, come out as these two.

        The merges of both are replayed in their common order, best score first and left before right;
        at each step the symbols at the bound must not be the better pair.
        """
        if left + right in self.scores:  # they would be the next to merge
            return False
        a, b, i, j, verdict = self.history(left), self.history(right), 0, 0, True
        if (a and not a[0][1]) or (b and not b[0][1]):
            verdict = False
        while verdict:
            last = a[i][2] if i < len(a) else left
            first = b[j][1] if j < len(b) else right
            across = self.scores.get(last + first)
            of_a = a[i][0] if i < len(a) else None
            of_b = b[j][0] if j < len(b) else None
            # of equal scores the leftmost merges first
            if across is not None and (of_a is None or across > of_a) and (of_b is None or across >= of_b):
                verdict = False
            elif of_a is None and of_b is None:
                break
            elif of_b is None or (of_a is not None and of_a >= of_b):
                i += 1
            else:
                j += 1
        return verdict

    def forget(self) -> None:
        """Drop all remembered pairs once there are many."""
        self.verdicts = 0
        for n in self.neighbours:
            n.clear()

    def split(self, span: str) -> list[_Neighbours]:
        """The pieces of a span by the table of last pieces."""
        last: list = [_FIRST, *[None] * len(span)]  # by prefix: its last piece
        for end, (here, size, piece) in self.automaton.iter(span):
            end += 1
            if last[end] is None and last[end - size][piece]:
                last[end] = here
        out, at = [], len(span)
        while at:
            here = last[at]
            out.append(here)
            at -= here.size
        out.reverse()
        return out

    def _span_ids(self, span: str) -> bytes:
        if len(span) == 1:
            return self._packed(span)
        return b"".join([here.packed for here in self.split(span)])

    def _packed(self, piece: str) -> bytes:
        """The id of a piece, or the ids of its bytes."""
        known = self.ids.get(piece)
        ids = [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]
        return pack(f"<{len(ids)}I", *ids)

    def _encoded(self, text: str) -> bytes:
        """The ids of a prepared text as little-endian 32-bit numbers, a bounded stretch at a time."""
        out, at = [], 0
        step = STEP
        while at < len(text):
            spans = self.spans.findall(text, at, at + step)
            whole = at + step >= len(text)
            if not whole:
                if len(spans) == 1:  # the span may go on: look further
                    step *= 2
                    continue
                spans.pop()
            out.append(b"".join(map(self.seen.__getitem__, spans)))
            at += sum(map(len, spans))
            step = STEP
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, begin and end ids around them."""
        v = self.vocabulary
        prepared = (MARK if v.dummy_prefix and text else "") + text.replace(" ", MARK)
        return np.concatenate([np.array([v.begin], "<u4"), np.frombuffer(self._encoded(prepared), "<u4"), np.array([v.end], "<u4")])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes become characters, one that they do not make the replacement sign."""
        parts, run, first = [], bytearray(), True
        surfaces, as_bytes = self.surfaces, self.bytes
        for i in ids.tolist():
            if i in as_bytes:
                run.append(as_bytes[i])
                continue
            if run:
                parts.append(_characters(run))
                run, first = bytearray(), False
            surface = surfaces[i]
            if first and surface:
                surface, first = (surface[1:] if self.vocabulary.dummy_prefix and self.vocabulary.pieces[i][0] == MARK else surface), False
            parts.append(surface)
        if run:
            parts.append(_characters(run))
        return "".join(parts)


class _Neighbours(dict):
    """One piece: whether other pieces may stand behind it, worked out when first asked for."""

    def __init__(self, pieces: Pieces, piece: str):
        self.pieces, self.piece, self.size, self.packed = pieces, piece, len(piece), pieces._packed(piece)

    def __missing__(self, right: str) -> bool:
        if self.pieces.verdicts >= PAIRS:
            self.pieces.forget()
        self.pieces.verdicts += 1
        self[right] = verdict = self.pieces.together(self.piece, right)
        return verdict


class _First(dict):
    """The empty prefix, behind which any piece may stand."""

    def __missing__(self, right: str) -> bool:
        return True


_FIRST = _First()


class _Seen(dict):
    """The ids of short spans, worked out when first asked for; of two generations the older is dropped."""

    def __init__(self, work_out):
        self.work_out, self.older = work_out, {}

    def __missing__(self, span: str) -> bytes:
        ids = self.older.get(span)
        if ids is None:
            ids = self.work_out(span)
        if len(span) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[span] = ids
        return ids


def _characters(raw: bytearray) -> str:
    """UTF-8 with one replacement sign for each byte that is part of no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_VOCABULARIES: dict[str, Vocabulary] = {}


@lru_cache(maxsize=2)
def _pieces(name: str) -> Pieces:
    return Pieces(_VOCABULARIES[name])


def _of(shared) -> Pieces:
    """A worker's encoder of the vocabulary that was broadcast."""
    vocabulary = shared.value
    _VOCABULARIES[vocabulary.name] = vocabulary
    return _pieces(vocabulary.name)


class PieceModel:
    """A model file as Spark columns. Its vocabulary, a few MB at most, is broadcast; executors need no file."""

    def __init__(self, spark, path: str):
        small_batches(spark)
        self.shared = spark.sparkContext.broadcast(Vocabulary.read(path))

    def ids(self, text: Column) -> Column:
        """array<int> of a text's ids, begin and end included; null counts as empty."""
        shared = self.shared

        def encode(texts: pa.Array) -> pa.Array:
            pieces = _of(shared)
            return pa.array([pieces.encode(t or "").astype(np.int32) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return F.arrow_udf(encode, "array<int>")(text)

    def text(self, ids: Column) -> Column:
        """The text of an array of ids; null stays null."""
        shared = self.shared

        def decode(column: pa.Array) -> pa.Array:
            pieces = _of(shared)
            return pa.array([None if x is None else pieces.decode(np.array(x, np.int64)) for x in column.to_pylist()], pa.string())

        return F.arrow_udf(decode, "string")(ids)

    def round_trip(self, text: Column) -> Column:
        """A struct of n_tokens, ids_sha256 and the text decoded from the ids, without the ids themselves."""
        shared = self.shared

        def both(texts: pa.Array) -> pa.Array:
            pieces, n, digests, decoded = _of(shared), [], [], []
            for t in texts.to_pylist():
                ids = pieces.encode(t or "")
                n.append(len(ids))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(pieces.decode(ids))
            return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded"])

        return F.arrow_udf(both, "n_tokens long, ids_sha256 string, decoded string")(text)


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``ids``: array<int> of its whole text.

    Null text counts as empty and has the begin and end ids only; repeated rows get equal ids. A column
    named ids is replaced. Long texts are encoded whole, with tables of one number a character.
    """
    model = PieceModel(docs.sparkSession, path)
    return drop_existing(docs, "ids").withColumn("ids", model.ids(F.col(text_col).cast("string")))


def piece_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256; no rows in, none out."""
    model = PieceModel(docs.sparkSession, path)
    out = docs.select(F.col(id_col), model.round_trip(missing(F.col(text_col).cast("string"), "")).alias("_trip"))
    return out.select(id_col, "_trip.n_tokens", "_trip.ids_sha256", F.sha2("_trip.decoded", 256).alias("decoded_sha256"))
