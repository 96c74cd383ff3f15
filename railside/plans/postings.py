"""Inverted indexes: postings of terms in files by a bucket of the term, so that a query reads its terms' buckets.

Words have their stem and their positions in a text; names have their trigrams and how many. An
index is made once for the files that it comes from, and found again by their names, lengths and
times; rows of a term are sorted together within a file, so statistics skip what is left.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.functions.stems import stem
from railside.functions.text import STOP_WORDS, trigrams
from railside.plans.scratch import shared_folder
from railside.plans.snapshots import Files

#: Stands in an index's name: a new number where stems, grams or columns change.
FORMAT = 1
#: Buckets of an index: folders, of which a query of a few terms reads a few.
BUCKETS = 64
#: Rows that a Python worker gives back at once.
STEP = 4096


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], buckets: int = BUCKETS, folder: str | None = None) -> str:
    """The path of an index with this name, made by ``build`` (rows with ``term``) where it is not there yet.

    It is written beside and renamed, so that it is there as a whole or not at all; if two make it
    at once, one of the two is kept.
    """
    path = f"{folder or shared_folder(spark)}/{name}-{FORMAT}-{buckets}"
    files = Files(spark, path)
    if not files.fs.exists(files.path("")):
        made = f"{path}-{uuid.uuid4().hex}"
        rows = build().withColumn("bucket", F.pmod(F.crc32("term"), F.lit(buckets)).cast("int"))
        # a bucket with a frequent term is split over tasks; sorted, so that a file's statistics tell its terms
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(made)
        if files.fs.exists(files.path("")) or not files.fs.rename(files.jvm.org.apache.hadoop.fs.Path(made), files.path("")):
            Files(spark, made).drop("")
    return path


def search(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some terms; only their buckets' files are listed and read."""
    wanted = sorted({bucket_of(t, buckets) for t in terms})
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")


# words


def terms_of(text: str) -> list[str]:
    """The stems of a query's words, each once, without stop words."""
    return list(dict.fromkeys(stem(w) for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS))


def word_postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, positions) of all words of all texts but stop words; positions count all words from 1.

    A text's postings are put together in the task that reads it, so nothing is shuffled; a word is
    stemmed once in a worker (of the last 131,072 words). Null texts have none, rows without id go.
    """
    stops = frozenset(STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                found: dict[str, list[int]] = {}
                for at, word in enumerate(re.findall("[a-z0-9]+", (text.as_py() or "").lower()), 1):
                    if word not in stops:
                        found.setdefault(stem(word), []).append(at)
                key = batch.column(0)[i].as_py()
                for term, places in found.items():
                    out[0].append(term)
                    out[1].append(key)
                    out[2].append(places)
                    if len(out[0]) == STEP:
                        yield _postings(out)
                        out = ([], [], [])
        if out[0]:
            yield _postings(out)

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "term string, id long, positions array<int>")


def _postings(out: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["term", "id", "positions"])


def nearness(a: Column, b: Column) -> Column:
    """How much two positions count together: the square root of both weights (a tenth) and of what their distance leaves."""
    return F.sqrt(0.01 / (1.005 + 0.05 * F.exp(F.abs(a - b) / 1.5 - 2)))


def rank(lists: Column) -> Column:
    """A text's rank from the positions of the query's terms, an array for each.

    Every two positions of different terms, at most 100 words apart, are independent evidence; the
    rank is the chance that not all of it fails. Positions are gone through in order, beside those
    of the last 100 words. With one term its positions count, each the less the later it comes.
    """
    single = F.aggregate(F.transform(lists[0], lambda p, j: 0.1 / ((j + 1) * (j + 1))), F.lit(0.0), lambda s, x: s + x) / 1.64493406685
    places = F.array_sort(F.flatten(F.transform(lists, lambda ps, i: F.transform(ps, lambda p: F.struct(p.alias("p"), i.alias("i"))))))
    begin = F.struct(F.lit(1.0).alias("failed"), F.array().cast("array<struct<p:int,i:int>>").alias("near"))

    def step(state: Column, x: Column) -> Column:
        near = F.filter(state["near"], lambda y: x["p"] - y["p"] <= 100)
        others = F.filter(near, lambda y: y["i"] != x["i"])
        return F.struct(F.aggregate(others, state["failed"], lambda t, y: t * (1 - nearness(x["p"], y["p"]))).alias("failed"), F.concat(near, F.array(x)).alias("near"))

    return F.when(F.size(lists) == 1, single).otherwise(1 - F.aggregate(places, begin, step)["failed"])


def matches(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id, hits, rank) of the texts that hold all terms of a query; none for a query without terms."""
    terms = terms_of(query)
    rows = search(spark, path, terms).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("found")).where(F.size("found") == len(terms))
    lists = F.transform("found", lambda f: f["positions"])
    return rows.select("id", F.size(F.flatten(lists)).alias("hits"), rank(lists).alias("rank"))


# names


def gram_postings(names: DataFrame) -> DataFrame:
    """(term, type, id, name, size) of the trigrams of names; size is the name's number of trigrams."""
    grams = names.withColumn("grams", trigrams(F.col("name"))).withColumn("size", F.size("grams"))
    return grams.select(F.explode("grams").alias("term"), "type", "id", "name", "size")


def similar(spark: SparkSession, path: str, query: str, least: float = 0.3) -> DataFrame:
    """(type, id, name, score) of names whose trigrams are at least so similar to the query's.

    A name that shares no trigram is not read. One of too many or too few trigrams is left out
    first, and shared ones are counted: the score is a matter of these counts.
    """
    grams = spark.range(1).select(trigrams(F.lit(query)).alias("g")).first().g
    n = len(grams)
    rows = search(spark, path, grams).where((F.col("size") >= least * n) & (F.col("size") * least <= n))
    counted = rows.groupBy("type", "id", "name", "size").agg(F.count("*").alias("c"))
    score = F.round(F.col("c") / (n + F.col("size") - F.col("c")), 6)
    return counted.select("type", "id", "name", score.alias("score")).where(F.col("score") >= least)
