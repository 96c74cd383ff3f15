"""Fill-in-middle: texts cut at random token bounds and put together in another order.

A token is a run of ASCII letters or any other character. Bounds are found by bit-parallel steps on
big integers, bit i standing for byte i of the UTF-8 text: ``bytes.translate`` makes one mask of the
letters and one of the bytes that begin a character; a token begins at each of the latter that is
not a letter after a letter. ``bit_count`` of that mask is the number of tokens, and the byte of the
token with a given rank is found by halving the mask, each time keeping the half that holds it.
Work is linear in a text's bytes, and a text is all that a worker holds at once besides its batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import drop_existing, missing
from railside.llm.words import small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: By byte: '1' for what the mask holds.
_LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
_HEADS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def _mask(raw: bytes, table: bytes) -> int:
    """Bit i is set where ``table`` has '1' for byte i; a base that is a power of two reads in linear time."""
    return int(raw.translate(table)[::-1], 2)


def select(bits: int, rank: int) -> int:
    """The place of the set bit that has ``rank`` set bits below it."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, width = low, half
        else:
            bits >>= half
            at, width, rank = at + half, width - half, rank - below
    return at


class Tokens:
    """The token bounds of one text that is not empty, as masks over its bytes."""

    def __init__(self, raw: bytes):
        letters, self.heads, self.size = _mask(raw, _LETTERS), _mask(raw, _HEADS), len(raw)
        self.starts = self.heads & ~(letters & (letters << 1))
        self.n = self.starts.bit_count()

    def byte_of(self, token: int) -> int:
        """Where token number ``token`` begins; the text's end for the one after the last."""
        return self.size if token >= self.n else select(self.starts, token)

    def chars(self, begin: int, end: int) -> int:
        """Characters that begin in the bytes from ``begin`` to ``end`` (exclusive)."""
        return ((self.heads >> begin) & ((1 << (end - begin)) - 1)).bit_count()


@dataclass(frozen=True)
class FillInMiddle:
    """How texts are cut: the seed of the hashes, and the shares of 100 of the forms."""

    seed: int = 1
    cut_share: int = 90
    spm_share: int = 20

    def apply(self, key: str, raw: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        """n, form, characters of prefix and middle (None if plain), and the output."""
        if not raw:
            return 0, "plain", None, None, raw
        digest = sha256(f"{self.seed}:{key}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))
        tokens = Tokens(raw)
        if h3 % 100 >= self.cut_share or any(s.encode() in raw for s in (PREFIX, SUFFIX, MIDDLE)):
            return tokens.n, "plain", None, None, raw
        a, b = (tokens.byte_of(k) for k in sorted((h1 % (tokens.n + 1), h2 % (tokens.n + 1))))
        prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        if h4 % 100 < self.spm_share:
            form, out = "spm", b"".join((s, suffix, p, prefix, m, middle))
        else:
            form, out = "psm", b"".join((p, prefix, s, suffix, m, middle))
        return tokens.n, form, tokens.chars(0, a), tokens.chars(a, b), out

    def column(self, key: Column, text: Column) -> Column:
        """A struct of n, form, prefix_chars, middle_chars and output."""

        def cut(keys: pa.Array, texts: pa.Array) -> pa.Array:
            rows = [self.apply(k, t) for k, t in zip(keys.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True) if rows else ([],) * 5
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            return pa.StructArray.from_arrays(arrays, ["n", "form", "prefix_chars", "middle_chars", "output"])

        return F.arrow_udf(cut, "n long, form string, prefix_chars long, middle_chars long, output string")(key, text)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of; no cut text holds a sentinel, so each stands once."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: FillInMiddle | None = None) -> DataFrame:
    """Every row and column of ``docs`` with n, form, prefix_chars, middle_chars and output.

    Null text counts as empty, and an empty text is plain; a null id is hashed as the empty string;
    rows of equal id and text get equal results. Columns of these names (and ``fim``) are replaced.
    Long texts are cut whole. No rows in, none out.
    """
    small_batches(docs.sparkSession)
    docs = drop_existing(docs, "n", "form", "prefix_chars", "middle_chars", "output", "fim")
    cut = (how or FillInMiddle()).column(missing(F.col(id_col).cast("string"), ""), missing(F.col(text_col).cast("string"), ""))
    return docs.withColumn("fim", cut).select(*docs.columns, "fim.*")


def fill_in_middle_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256."""
    out = fill_in_middle(docs.select(id_col, text_col), id_col, text_col)
    return out.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))
