"""Benchmark decontamination by winnowing.

Runs of GRAM words are hashed; of every ``span - GRAM + 1`` consecutive run hashes the smallest (the
last among equals) is kept. Two texts that share ``span`` words share those hashes, so they keep
the same one: a match of kept hashes misses no shared span. Each hit is extended to the windows of
``span`` words around it, and those count that are windows of an item too. A benchmark item with
fewer words than the span is one window, winnowed with its own length as the span. Windows are
compared by 64-bit hashes over all of their words.

A benchmark of bounded size is held by every task, and documents are read once. A larger one is
joined: kept hashes of documents with those of items, then the windows around what was found, for
the documents found only. Documents are read three times then, however large the benchmark is.
Either way items are named once for each distinct set of windows, not for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from railside.llm.cluster import cut, missing, small_side
from railside.llm.words import ALNUM, Words, grams, grams_at, small_batches, words_of

#: Bytes of benchmark text that are sent to every executor; a larger benchmark is joined.
BLOCK_BYTES = 32 << 20
#: Distinct sets of windows whose items a task remembers.
REMEMBERED = 4096


def _gram(span: int) -> int:
    return max(1, (span + 1) // 2)


def winnow(hashes: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept run hashes and their first words' positions; runs and windows stay within a document."""
    k = _gram(span)
    w = span - k + 1
    runs = grams(hashes, k)
    n = len(runs) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, at = runs[:n].copy(), np.arange(n)
    for i in range(1, w):
        other = runs[i : i + n]
        take = other <= best
        best[take] = other[take]
        at[take] = np.flatnonzero(take) + i
    whole = doc[:n] == doc[span - 1 : span - 1 + n]
    at = np.unique(at[whole])
    return runs[at], at


class Benchmark:
    """One block of items: by window length, the kept run hashes, the windows, and each window's items."""

    def __init__(self, ids: list, texts: list[str], span: int):
        #: An item without id contaminates, but has no name to be listed by.
        self.ids = [None if i is None else str(i) for i in ids]
        parts = list(words_of(pa.array(texts, pa.string()), ALNUM))
        hashes = np.concatenate([p.hashes for p in parts]) if parts else np.zeros(0, np.uint64)
        item = np.concatenate([p.doc + p.first for p in parts]) if parts else np.zeros(0, np.int64)
        sizes = np.bincount(item, minlength=len(ids))
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({min(span, int(s)) for s in sizes if s}):
            own = sizes[item] >= span if length == span else sizes[item] == length
            words, of = hashes[own], item[own]
            prints = np.unique(winnow(words, of, length)[0])
            runs = grams(words, length)
            whole = of[: len(runs)] == of[length - 1 : length - 1 + len(runs)]
            pairs = np.unique(np.stack([runs[whole], of[: len(runs)][whole].astype(np.uint64)], 1), axis=0)
            windows, begins = np.unique(pairs[:, 0], return_index=True)
            self.lengths[length] = prints, windows, np.append(begins, len(pairs)), pairs[:, 1].astype(np.int64)

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words of windows that occur, their numbers), for each length.

        A kept run hash that the items kept too is extended to all windows around it, each looked up
        once however often the items hold it.
        """
        for length, (prints, windows, _, _) in self.lengths.items():
            found, at = winnow(hashes, doc, length)
            at = at[_spot(prints, found) >= 0]
            starts = np.unique(at[:, None] - np.arange(length - _gram(length) + 1))
            starts = starts[(starts >= 0) & (starts + length <= len(doc))]
            starts = starts[doc[starts] == doc[starts + length - 1]]
            number = _spot(windows, grams_at(hashes, starts, length))
            yield length, starts[number >= 0], number[number >= 0]

    def names(self, found: list[tuple[int, np.ndarray]]) -> list[str]:
        """Ids of the items that hold any of the numbered windows (length, numbers)."""
        items = []
        for length, numbers in found:
            _, _, begins, of = self.lengths[length]
            items += [of[begins[w] : begins[w + 1]] for w in np.unique(numbers).tolist()]
        return sorted({self.ids[i] for i in np.unique(np.concatenate(items)).tolist()} - {None}) if items else []


def _spot(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted values, -1 where absent."""
    if not len(values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return np.where(values[at] == wanted, at, -1)


def _matched(benchmark: Benchmark, words: Words) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Which words are hit, and of each length the documents of the windows found with their numbers."""
    edge, found = np.zeros(len(words.hashes) + 1, np.int64), []
    for length, starts, number in benchmark.hits(words.hashes, words.doc):
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
        found.append((length, words.doc[starts], number))
    return np.cumsum(edge[:-1]) > 0, found


def _scan(benchmark: Benchmark):
    """The result of each row; the items of a set of windows are named and digested once while it is remembered."""
    named: dict[tuple, tuple[int, str]] = {}

    def items_of(found: list[tuple[int, np.ndarray]]) -> tuple[int, str]:
        found = [(length, np.unique(numbers)) for length, numbers in found if len(numbers)]
        key = tuple((length, numbers.tobytes()) for length, numbers in found)
        if key not in named:
            if len(named) >= REMEMBERED:
                named.clear()
            names = benchmark.names(found)
            named[key] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
        return named[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, hits, items, digests = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [_NO_ITEMS] * n
            for words in words_of(batch.column(1), ALNUM):
                counts[words.first : words.last] = np.diff(words.begins)
                hit, found = _matched(benchmark, words)
                hits[words.first : words.last] = np.bincount(words.doc[hit], minlength=words.last - words.first)
                for d in np.unique(words.doc[hit]).tolist():
                    items[words.first + d], digests[words.first + d] = items_of([(length, number[doc == d]) for length, doc, number in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(hits), pa.array(items), pa.array(digests), pa.array(hits > 0)], names=["id", *_RESULT])

    return run


_NO_ITEMS = hashlib.sha256(b"").hexdigest()
_RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def _clean(benchmark: Benchmark, text: int):
    """Whole rows without a hit in the column of that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            for words in words_of(batch.column(text).cast(pa.string()), ALNUM):
                hit, _ = _matched(benchmark, words)
                kept[words.first + np.unique(words.doc[hit])] = False
            yield batch.filter(pa.array(kept))

    return run


def benchmark_items(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The benchmark's distinct ids and texts, and about their bytes."""
    items = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    return items, items.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0


def _held(items: DataFrame, span: int) -> Benchmark:
    """The whole benchmark, whose size was checked."""
    table = items.toArrow()
    return Benchmark(table["id"].to_pylist(), table["text"].to_pylist(), span)


# A larger benchmark: fingerprints and windows as rows. Texts are named by a digest, so rows of equal
# texts share their result, and no row needs a number.


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _item_rows(span: int):
    """(kind, length, hash, item) of items: kept run hashes (kind 0, without item) and windows (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), ALNUM):
                sizes = np.diff(words.begins)
                for length in sorted({min(span, int(x)) for x in sizes if x}):
                    own = sizes[words.doc] >= span if length == span else sizes[words.doc] == length
                    hashes, of = words.hashes[own], words.doc[own]
                    prints, runs = np.unique(winnow(hashes, of, length)[0]), grams(hashes, length)
                    whole = of[: len(runs)] == of[length - 1 : length - 1 + len(runs)]
                    names = batch.column(0).take(pa.array(words.first + of[: len(runs)][whole]))
                    both = [(0, prints, pa.nulls(len(prints), pa.string())), (1, runs[whole], names)]
                    for kind, found, items in both:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), kind, np.int32)), pa.array(np.full(len(found), length, np.int32)), _signed(found), items], names=["kind", "length", "hash", "item"])

    return run


def _doc_prints(lengths: list[int]):
    """(key, length, hash, at) of the kept run hashes of texts, for each length of window that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), ALNUM):
                for length in lengths:
                    found, at = winnow(words.hashes, words.doc, length)
                    doc = words.doc[at]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.first + doc)), pa.array(np.full(len(at), length, np.int32)), _signed(found), pa.array((at - words.begins[doc]).astype(np.int32))], names=["key", "length", "hash", "at"])

    return run


def _doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, length, hash, start) of the windows around the places (length, at) of each text."""
    for batch in batches:
        places = batch.column(2).to_pylist()
        for words in words_of(batch.column(1), ALNUM):
            for d in range(words.last - words.first):
                own = words.hashes[words.begins[d] : words.begins[d + 1]]
                for length in sorted({p["length"] for p in places[words.first + d]}):
                    at = np.array([p["at"] for p in places[words.first + d] if p["length"] == length], np.int64)
                    starts = np.unique(at[:, None] - np.arange(length - _gram(length) + 1))
                    starts = starts[(starts >= 0) & (starts + length <= len(own))]
                    key = batch.column(0).take(pa.array(np.full(len(starts), words.first + d)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.full(len(starts), length, np.int32)), _signed(grams_at(own, starts, length)), pa.array(starts.astype(np.int32))], names=["key", "length", "hash", "start"])


@F.arrow_udf(LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    sizes = [np.diff(w.begins) for w in words_of(texts, ALNUM)]
    return pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))


def _text_key(text: str) -> Column:
    return F.md5(missing(F.col(text).cast("string"), ""))


def _joined_hits(texts: DataFrame, items: DataFrame, span: int) -> tuple[DataFrame, DataFrame]:
    """(key, length, hash, start) of the windows of texts (key, text) that items hold, and the items' rows."""
    of_items = cut(items.mapInArrow(_item_rows(span), "kind int, length int, hash long, item string"))
    lengths = [r["length"] for r in of_items.select("length").distinct().collect()]  # at most ``span``
    prints = small_side(cut(of_items.where("kind = 0").select("length", "hash").distinct()))
    spots = texts.mapInArrow(_doc_prints(lengths), "key string, length int, hash long, at int").join(prints, ["length", "hash"], "left_semi")
    places = cut(spots.groupBy("key").agg(F.collect_set(F.struct("length", "at")).alias("places")))
    some = texts.join(small_side(places), "key").dropDuplicates(["key"])
    windows = small_side(cut(of_items.where("kind = 1").select("length", "hash").distinct()))
    around = some.select("key", "text", "places").mapInArrow(_doc_windows, "key string, length int, hash long, start int")
    return cut(around.join(windows, ["length", "hash"], "left_semi")), of_items


def _joined(texts: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """``contamination`` for a benchmark that no task holds."""
    keyed = texts.withColumn("key", _text_key("text"))
    hits, of_items = _joined_hits(keyed.select("key", missing(F.col("text"), "").alias("text")), items, span)
    # words under windows: those that begin behind all earlier ones count whole, others by what they add
    ends = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], x["end"]).alias("reach")),
    )
    windows = F.sort_array(F.collect_set(F.struct("length", "hash")))
    by_text = cut(hits.groupBy("key").agg(ends["n"].cast("long").alias("n_hit"), windows.alias("windows")).withColumn("set", F.md5(F.to_json("windows"))))
    sets = by_text.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("w")).select("set", "w.length", "w.hash")
    names = sets.join(of_items.where("kind = 1 and item is not null").select("length", "hash", "item").distinct(), ["length", "hash"]).select("set", "item").distinct()
    named = names.groupBy("set").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))
    found = small_side(cut(by_text.select("key", "n_hit", "set").join(named, "set", "left").drop("set")))
    out = keyed.select("id", _n_words(missing(F.col("text"), "")).alias("n_words"), "key").join(found, "key", "left")
    values = {"n_words": F.col("n_words"), "n_hit": missing(F.col("n_hit"), 0), "n_items": missing(F.col("n_items"), 0), "items_sha256": missing(F.col("items_sha256"), F.lit(_NO_ITEMS)), "contaminated": F.col("n_hit").isNotNull()}
    return out.select("id", *[values[c].cast(t).alias(c) for c, t in _RESULT.items()])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", span: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit when it lies in an occurrence of ``span`` consecutive words of an item, or of a
    whole shorter item. Null text has no words; an item without words occurs nowhere, one without id
    hits words but is neither counted nor named; an empty benchmark contaminates nothing; repeated
    rows get the same result; other columns are ignored. Ids may be of any type that Arrow has.
    ``items_sha256`` digests the sorted item ids joined by commas (of the empty string if none).
    A benchmark above ``block_bytes`` is joined and not sent to every task; the rows are the same.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    items, size = benchmark_items(items, item_id_col, item_text_col)
    if size <= block_bytes:
        out = texts.mapInArrow(_scan(_held(items, span)), f"id {kind}, {', '.join(f'{c} {t}' for c, t in _RESULT.items())}")
    else:
        out = _joined(texts, items, span)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", span: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without words in a benchmark span; all their columns.

    Each row is judged by its own text, whatever its id.
    """
    small_batches(docs.sparkSession)
    items, size = benchmark_items(items, item_id_col, item_text_col)
    if size <= block_bytes:
        text = [c.lower() for c in docs.columns].index(text_col.lower())
        return docs.mapInArrow(_clean(_held(items, span), text), docs.schema)
    texts = docs.select(_text_key(text_col).alias("key"), missing(F.col(text_col).cast("string"), "").alias("text"))
    own = "_".join(["", *docs.columns])  # a name that no column has
    bad = small_side(cut(_joined_hits(texts, items, span)[0].select(F.col("key").alias(own)).distinct()))
    return docs.join(bad, _text_key(text_col) == F.col(f"`{own}`"), "left_anti")
