"""Word hashing over the raw UTF-8 of an Arrow column, vectorised over many documents at once."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handled in one numpy step; one document may exceed it. Small, so that a step's
#: temporaries stay near the caches and a worker's memory stays low.
STEP_BYTES = 1 << 18
#: Documents handled in one step, at most.
STEP_ROWS = 256
#: Words of more bytes are hashed one by one with BLAKE2.
LONG_WORD = 512
#: Bytes of an Arrow batch that Spark hands to a Python worker, unless the session names less.
BATCH_BYTES = 4 << 20

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes after A-Z were lowered. SPACED: all but tab to carriage return and space.
SPACED = np.ones(256, bool)
SPACED[[*range(9, 14), 32]] = False
#: Digits, a-z and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: By 0 to 8 bytes: a little-endian mask of that many.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that Python workers get: rows hold whole texts, of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)[bB]?", spark.conf.get(name) or "")
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@dataclass
class Words:
    """Words of the documents first to last (exclusive) of a batch, in order."""

    first: int
    last: int
    hashes: np.ndarray  # uint64 by word
    doc: np.ndarray  # int64 by word: 0 for the document ``first``
    begins: np.ndarray  # int64 by document, one more than documents: its first word


def words_of(column: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """Hashed words (A-Z lowered) of a string column, in steps of about STEP_BYTES; null has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + STEP_BYTES, "right")) - 1)
        last = min(last, n, first + STEP_ROWS)
        yield _hash(raw[at[first] : at[last]], at[first : last + 1] - at[first], first, last, kind)
        first = last


def _hash(raw: np.ndarray, at: np.ndarray, first: int, last: int, kind: np.ndarray) -> Words:
    size = len(raw)
    low = _LOWER[raw]
    inside = kind[low]
    before = np.zeros(size, bool)
    before[1:] = inside[:-1]
    edges = at[(at > 0) & (at < size)]
    before[edges] = False
    after = np.zeros(size, bool)
    after[:-1] = inside[1:]
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = _hash_spans(low, starts, ends)
    doc = np.searchsorted(at[1:], starts, "right")
    begins = np.searchsorted(doc, np.arange(last - first + 1))
    return Words(first, last, hashes, doc, begins)


def _hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time go through the finaliser, then the length.

    Every lane is mixed with all before it, so no family of texts hashes alike by its structure; two
    given different spans do with probability near 2**-64.
    """
    size = ends - starts
    out = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))
    out = mix(out ^ (lanes[starts] & _MASK[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(more):
        out[more] = mix(out[more] * np.uint64(0xD1342543DE82EF95) ^ (lanes[starts[more] + done] & _MASK[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out + size.astype(np.uint64))


def hash_words(words: list[str], kind: np.ndarray) -> np.ndarray:
    """The hashes that ``words_of`` gives for words that stand alone."""
    found = [w.hashes for w in words_of(pa.array(words, pa.string()), kind)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words; the caller drops runs that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix(out + hashes[i : i + n] + np.uint64(i + 1))
    return out


def grams_at(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Those of ``grams`` that begin at the given words."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(k):
        out = mix(out + hashes[starts + i] + np.uint64(i + 1))
    return out
