"""Exact duplicates by counting quotient filters and byte verification.

Each partition builds counting quotient filters of 64-bit text fingerprints: a fingerprint's high
bits (its quotient) name a run, and the run keeps sorted remainders with counts. Filters of one
quotient range merge without loss by merging their sorted remainders. Fingerprints counted more
than once send their documents to verification, which groups whole texts byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import cut, missing, small_side

#: Fingerprints in one filter while it is built, and (about) in one merged quotient range.
FILTER_SIZE = 1 << 20
#: Quotient bits within a range.
QUOTIENT_BITS = 16


class CountingQuotientFilter:
    """Occupied quotients of one range with the lengths of their runs; sorted remainders and counts, run after run."""

    def __init__(self, held: np.ndarray, lengths: np.ndarray, remainders: np.ndarray, counts: np.ndarray, range_bits: int):
        self.held, self.lengths, self.remainders, self.counts, self.range_bits = held, lengths, remainders, counts, range_bits

    @classmethod
    def _of_sorted(cls, own: np.ndarray, counts: np.ndarray, range_bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints without the bits of their range."""
        left = np.uint64(64 - range_bits - QUOTIENT_BITS)
        quotient = own >> left
        starts = np.flatnonzero(np.append(True, quotient[1:] != quotient[:-1])) if len(own) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(own)))
        return cls(quotient[starts].astype(np.int32), lengths.astype(np.int32), own & ((np.uint64(1) << left) - np.uint64(1)), counts, range_bits)

    @classmethod
    def of(cls, fingerprints: np.ndarray, range_bits: int) -> CountingQuotientFilter:
        """From fingerprints (any order, repeats allowed) that share their first ``range_bits`` bits."""
        own, counts = np.unique(fingerprints & np.uint64((1 << 64 - range_bits) - 1), return_counts=True)
        return cls._of_sorted(own, counts.astype(np.int64), range_bits)

    def local(self) -> np.ndarray:
        """Sorted fingerprints without the bits of their range."""
        left = np.uint64(64 - self.range_bits - QUOTIENT_BITS)
        return np.repeat(self.held.astype(np.uint64), self.lengths) << left | self.remainders

    def fingerprints(self, range_index: int) -> np.ndarray:
        high = np.uint64(range_index) << np.uint64(64 - self.range_bits) if self.range_bits else np.uint64(0)
        return high | self.local()

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """One filter with the counts of both: each of the other's remainders finds its place in the sorted ones."""
        own, more = self.local(), other.local()
        at = np.searchsorted(own, more)
        same = own[np.minimum(at, len(own) - 1)] == more if len(own) else np.zeros(len(more), bool)
        counts = self.counts.copy()
        counts[at[same]] += other.counts[same]
        return self._of_sorted(np.insert(own, at[~same], more[~same]), np.insert(counts, at[~same], other.counts[~same]), self.range_bits)

    def row(self, name: int) -> tuple:
        return name, self.held.tobytes(), self.lengths.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def read(cls, held: bytes, lengths: bytes, remainders: bytes, counts: bytes, range_bits: int) -> CountingQuotientFilter:
        return cls(np.frombuffer(held, np.int32), np.frombuffer(lengths, np.int32), np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64), range_bits)


def _build(range_bits: int, filter_size: int):
    """Partition of fingerprints -> its filters, one row for each quotient range that it meets."""

    def emit(prints: np.ndarray) -> pa.RecordBatch:
        prints.sort()
        part = prints >> np.uint64(64 - range_bits) if range_bits else np.zeros(len(prints), np.uint64)
        names, starts = np.unique(part, return_index=True)
        rows = [CountingQuotientFilter.of(own, range_bits).row(int(name)) for name, own in zip(names, np.split(prints, starts[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)], names=["range", "held", "lengths", "remainders", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= filter_size:
                yield emit(np.concatenate(waiting))
                waiting, size = [], 0
        if size:
            yield emit(np.concatenate(waiting))

    return run


def _merge(range_bits: int):
    """Filters of one quotient range -> fingerprints whose merged count is above one.

    Filters come in the compact form that they have in a row, about 20 bytes for each fingerprint of
    the range, and are merged two by two.
    """

    def run(table: pa.Table) -> pa.Table:
        columns = [table[c] for c in ("held", "lengths", "remainders", "counts")]
        filters = [CountingQuotientFilter.read(*(c[i].as_py() for c in columns), range_bits) for i in range(table.num_rows)]
        while len(filters) > 1:
            pairs = [filters[i].merged(filters[i + 1]) for i in range(0, len(filters) - 1, 2)]
            filters = pairs + filters[2 * len(pairs) :]
        again = filters[0].fingerprints(table["range"][0].as_py())[filters[0].counts > 1]
        return pa.table({"fp": pa.array(again.view(np.int64), pa.int64())})

    return run


def repeated_fingerprints(prints: DataFrame, column: str = "fp", filter_size: int = FILTER_SIZE) -> DataFrame:
    """Distinct values of a long column that occur more than once, by merged quotient filters.

    Ranges are so many that each has about ``filter_size`` values at most. An empty table gives an
    empty one; nulls are ignored.
    """
    prints = prints.select(F.col(column).alias("fp")).where(F.col("fp").isNotNull())
    range_bits = max(0, (prints.count() // filter_size).bit_length())
    filters = prints.mapInArrow(_build(range_bits, filter_size), "range long, held binary, lengths binary, remainders binary, counts binary")
    return filters.groupBy("range").applyInArrow(_merge(range_bits), "fp long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the largest id stays.
    Rows that repeat both id and text are one document: they count in ``group_size`` and are flagged
    alike. A null id never stays beside one that is not null; a group of null ids only keeps null.
    Empty input gives no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), missing(F.col(text_col), "").alias("text"))
    texts = texts.select("id", "text", F.xxhash64("text").alias("fp"))
    narrow = cut(texts.select("id", "fp", F.sha2("text", 256).alias("text_sha256")))
    again = small_side(cut(repeated_fingerprints(narrow)))
    # The text itself is a grouping key: Spark compares its bytes, and each task sends a group once.
    verified = (
        texts.join(again, "fp", "left_semi")
        .groupBy(F.sha2("text", 256).alias("text_sha256"), "text")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("text_sha256", "keep_id", "group_size")
    )
    verified = small_side(cut(verified))
    joined = narrow.join(verified, "text_sha256", "left")
    grouped = F.col("group_size").isNotNull()
    out = joined.select(
        F.col("id").alias(id_col),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        missing(F.col("group_size"), 1).cast("long").alias("group_size"),
        F.when(grouped, F.col("id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
    )
    return out


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no equal with a larger id; all their columns."""
    own = docs.select(*[F.col(c) for c in docs.columns], F.sha2(missing(F.col(text_col), ""), 256).alias("_sha"))
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    return own.alias("d").join(kept.alias("k"), (F.col("d._sha") == F.col("k._sha")) & F.col(f"d.{id_col}").eqNullSafe(F.col("k._id")), "left_semi").drop("_sha")


__all__ = ["CountingQuotientFilter", "drop_duplicates", "exact_duplicates", "repeated_fingerprints"]
