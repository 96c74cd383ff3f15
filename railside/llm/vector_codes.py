"""Vectors as short codes: product quantisation in whole numbers, with codebooks trained here.

A component x becomes floor(scale * x), a vector is cut into equal parts, and each part is replaced
by the index of the nearest entry of its position's codebook. Nearest entries are found in two
steps. A float32 matrix product screens all entries: it gives |c|^2 - 2 x.c with a rounding error
that is bounded for every row (Higham's gamma, for any order of summation, with the conversion of
x and c counted). Entries whose interval overlaps the best one's, most often one, are re-evaluated
in int64, and the first of the nearest is taken. So codes and errors are exact, whatever the
library that multiplies matrices.

Codebooks are of fixed size: only they pass through the driver. A round of training reads the
vectors once; each task sums its parts by entry, and Spark adds the tasks' sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import cut, drop_existing, small_side
from railside.llm.words import small_batches

#: Whole components of at most this size are taken: squares and sums of a part then fit in int64.
LARGEST = 1 << 26
#: Vectors handled in one numpy step.
STEP = 4096
#: Half the distance between 1 and the next float32.
UNIT = 2.0**-24


def kept(column: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def whole_numbers(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column as an int64 matrix; shorter vectors end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if flat.size and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component is above {LARGEST / scale:g}: its square would not be exact")
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.astype(np.int64)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row of ``x``: the first of the nearest entries, and its squared distance (both int64)."""
    squares = (entries * entries).sum(1)
    scores = x.astype(np.float32) @ (-2 * entries).astype(np.float32).T
    scores += squares.astype(np.float32)
    steps = (x.shape[1] + 4) * UNIT
    length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    error = steps / (1 - steps) * (2 * length * np.sqrt(squares.max()) + squares.max()) * (1 + 1e-9)
    reach = np.nextafter((scores.min(1) + 2 * error).astype(np.float32), np.float32(np.inf))
    row, entry = np.nonzero(scores <= reach[:, None])
    exact = ((x[row] - entries[entry]) ** 2).sum(1)
    begins = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(exact, begins)
    hits = np.flatnonzero(exact == best[row])
    first = hits[np.searchsorted(row[hits], np.arange(len(x)))]  # entries ascend within a row
    return entry[first], best


@dataclass(frozen=True)
class Codebooks:
    """By part, entry and place within the part: whole numbers."""

    entries: np.ndarray
    scale: float = 256.0

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all numbers in order, in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and summed errors of whole-number vectors."""
        found = [nearest(x[:, p * part.shape[1] : (p + 1) * part.shape[1]], part) for p, part in enumerate(self.entries)]
        return np.stack([f[0] for f in found], 1), sum(f[1] for f in found)

    def steps(self, column: pa.Array) -> Iterator[np.ndarray]:
        for at in range(0, len(column), STEP):
            yield whole_numbers(column.slice(at, STEP), self.width, self.scale)

    def column(self, vectors: Column) -> Column:
        """A struct of code (two hexadecimal digits a part) and error."""

        def encode(column: pa.Array) -> pa.Array:
            codes, errors, digits = [], [np.zeros(0, np.int64)], 2 * len(self.entries)
            for x in self.steps(column):
                code, error = self.assign(x)
                text = code.astype(np.uint8).tobytes().hex()
                codes += [text[i : i + digits] for i in range(0, len(text), digits)]
                errors.append(error)
            return pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], ["code", "error"])

        return F.arrow_udf(encode, "code string, error long")(vectors)

    def decode(self, codes: Column) -> Column:
        """The vectors that codes stand for: each part's entry, at the middle of its scale's steps."""

        def decode(column: pa.Array) -> pa.Array:
            raw = np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(len(column), -1)
            values = np.concatenate([part[raw[:, p]] for p, part in enumerate(self.entries)], 1) if len(raw) else np.zeros((0, self.width))
            return pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * self.width, ((values + 0.5) / self.scale).ravel())

        return F.arrow_udf(decode, "array<double>")(codes)

    def moved(self, vectors: DataFrame, vector_col: str) -> Codebooks:
        """Each entry replaced by its parts' componentwise floor(sum / count); unused entries stay."""
        parts, n, size = self.entries.shape

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, totals = np.zeros((parts, n), np.int64), np.zeros((parts, n, size), np.int64)
            for batch in batches:
                for x in self.steps(batch.column(0)):
                    codes, _ = self.assign(x)
                    for p in range(parts):
                        counts[p] += np.bincount(codes[:, p], minlength=n)
                        for j in range(size):  # sums of a step are exact in float64
                            totals[p, :, j] += np.bincount(codes[:, p], x[:, p * size + j], n).astype(np.int64)
            part, entry = np.nonzero(counts)
            if len(part):
                place = np.tile(np.arange(size), len(part))
                columns = [np.repeat(part, size), np.repeat(entry, size), place, np.repeat(counts[part, entry], size), totals[part, entry].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "n", "total"])

        found = vectors.select(vector_col).mapInArrow(sums, "part long, entry long, place long, n long, total long")
        rows = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # as many as the codebooks have numbers
        entries = self.entries.copy()
        for r in rows:
            entries[r.part, r.entry, r.place] = r.total // r.n
        return Codebooks(entries, self.scale)


def fit_codebooks(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> Codebooks | None:
    """Codebooks that start as the vectors of the smallest ids and move ``rounds`` times; None without vectors.

    All kept vectors teach. Equal ids are ordered by their vectors, null ids come last. Vectors end in
    zeros up to a multiple of ``parts`` that holds the longest one. There are at most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    small_batches(vectors.sparkSession)
    data = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(kept(F.col("x")))
    longest = data.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    size = max(1, -(-longest // parts))
    first = data.orderBy(F.asc_nulls_last("id"), "x").limit(entries).select("x").toArrow()["x"].combine_chunks()
    x = whole_numbers(first, parts * size, scale)
    books = Codebooks(x.reshape(len(x), parts, size).transpose(1, 0, 2).copy(), scale)
    for _ in range(rounds):
        books = books.moved(data, "x")
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """The rows with a kept vector, all their columns, code and error (long); columns of these names are replaced."""
    small_batches(vectors.sparkSession)
    vectors = drop_existing(vectors, "code", "error", "coded").where(kept(F.col(vector_col).cast("array<double>")))
    coded = books.column(F.col(vector_col).cast("array<double>"))
    return vectors.withColumn("coded", coded).select(*vectors.columns, "coded.*")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """One row per kept vector: id, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds a component that is null or not finite go; an empty vector
    is one of zeros; repeated rows each get a row. Null labels are one label. No kept rows, no
    rows out. Other columns are ignored. A component above ``LARGEST`` / scale is an error.
    """
    vectors = vectors.select(F.col(id_col), F.col(vector_col).alias("_x"), F.col(label_col).alias("_label"))
    books = fit_codebooks(vectors, id_col, "_x", parts, entries, rounds, scale)
    if books is None:
        return vectors.limit(0).select(id_col, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = cut(encode_vectors(vectors, books, "_x").drop("_x"))
    sums = small_side(cut(codes.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))))
    return codes.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).select(id_col, "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
