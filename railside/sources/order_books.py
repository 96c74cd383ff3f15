"""Recorded answers of an exchange as a Spark data source, in batch and as a stream.

A recording holds one JSON-RPC envelope a line: the answer to a question for market catalogues or for
market books, with a list of markets, or an error. The source opens the envelopes and gives a row
for each market, as JSON; what it holds is read with columns. A file is a partition, so a task that
is lost reads its file again. As a stream, the source gives files in the order of their names: an
offset is the last name taken.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from railside.functions.racing import best_back, weighted_price
from railside.plans.scratch import scratch
from railside.registry import table_query

ENVELOPE_ROW = "file string, line int, kind string, market string, error string"
_LADDER = "array<struct<price: double, size: double>>"
CATALOGUE = "marketId string, marketName string, marketStartTime string, event struct<venue: string, countryCode: string>, runners array<struct<selectionId: bigint, runnerName: string, sortPriority: int>>"
BOOK = f"marketId string, status string, inplay boolean, totalMatched double, runners array<struct<selectionId: bigint, status: string, lastPriceTraded: double, totalMatched: double, ex: struct<availableToBack: {_LADDER}, availableToLay: {_LADDER}, tradedVolume: {_LADDER}>>>"

#: The values of either kind of market.
STATE = f"struct<marketId: string, marketName: string, marketStartTime: string, event: struct<venue: string>, status: string, inplay: boolean, runners: array<struct<selectionId: bigint, runnerName: string, status: string, lastPriceTraded: double, totalMatched: double, ex: struct<availableToBack: {_LADDER}, availableToLay: {_LADDER}, tradedVolume: {_LADDER}>>>>"
_STEPS = pa.list_(pa.struct([("price", pa.float64()), ("size", pa.float64())]))
_RUNNER = pa.struct([("selectionId", pa.int64()), ("runnerName", pa.string()), ("status", pa.string()), ("lastPriceTraded", pa.float64()), ("totalMatched", pa.float64()), ("ex", pa.struct([("availableToBack", _STEPS), ("availableToLay", _STEPS), ("tradedVolume", _STEPS)]))])
_STATE = pa.struct([("marketId", pa.string()), ("marketName", pa.string()), ("marketStartTime", pa.string()), ("event", pa.struct([("venue", pa.string())])), ("status", pa.string()), ("inplay", pa.bool_()), ("runners", pa.list_(_RUNNER))])
_ANSWER = pa.schema([("result", pa.list_(_STATE))])


class File(InputPartition):
    """One recording."""

    def __init__(self, path: str):
        self.path = path


def _files(path: str) -> list[str]:
    """The recordings below a folder, in any store that Arrow reads, by name."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def envelopes(path: str, folder: str) -> Iterator[tuple]:
    """The rows of one recording; a line that is no envelope is an error of its own, not of the others."""
    for first, lines in _blocks(path, folder):
        for number, line in enumerate(lines, first):
            for row in _envelope_rows(line):
                yield path, number, *row


def _envelope_rows(line: bytes) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(kind, market, error) of a line."""
    try:
        if (markets := _recorded(line)) is None:
            envelope = json.loads(line)
            if envelope.get("error"):
                yield None, None, str(envelope["error"].get("message"))
            markets = ((market, None) for market in envelope.get("result") or [])
        for market, text in markets:
            kind = "catalogue" if "event" in market or "marketName" in market else "book"
            yield kind, text or json.dumps(market), None
    except (ValueError, AttributeError, TypeError) as e:
        yield None, None, f"no envelope: {e}"


# What stands before and behind the markets of an answer, as an exchange writes it.
_HEAD, _BETWEEN, _TAIL = re.compile(r'\s*\{\s*(?:"jsonrpc"\s*:\s*"[^"\\]*"\s*,\s*)?"result"\s*:\s*\[\s*', re.ASCII), re.compile(r"\s*,\s*", re.ASCII), re.compile(r'\s*\]\s*(?:,\s*"id"\s*:\s*\d+\s*)?\}\s*', re.ASCII)
_scan = json.JSONDecoder().scan_once


def _recorded(line: bytes) -> list[tuple[object, str]] | None:
    """The markets of a plain answer, each with its text as it was recorded; None where a line is anything else."""
    if not line.isascii():
        return None
    text = line.decode()
    if not (head := _HEAD.match(text)):
        return None
    at, out = head.end(), []
    try:
        while True:
            market, end = _scan(text, at)
            out.append((market, text[at:end]))
            if not (more := _BETWEEN.match(text, end)):
                return out if _TAIL.fullmatch(text, end) else None
            at = more.end()
    except StopIteration:  # no value stands there
        return None


def _blocks(path: str, folder: str) -> Iterator[tuple[int, list[bytes]]]:
    """Lines that are not empty, a block at a time, each with the number of its first."""
    from pyarrow import fs

    store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
    left, first = b"", 1
    with store.open_input_stream(path) as stream:  # a name that ends in .gz is opened as such
        while block := stream.read(1 << 20):
            *whole, left = (left + block).split(b"\n")
            if lines := [x for x in whole if x.strip()]:
                yield first, lines
                first += len(lines)
    if left.strip():
        yield first, [left]


# What may not be told by values alone: errors, names in escapes, and names whose value is null.
_UNTOLD, _NULLS = (b'"error"', b"\\u", b"\0"), re.compile(rb'"(?:event|marketName)"\s*:\s*null')


def _read_at_once(lines: list[bytes]) -> pa.RecordBatch | None:
    """Line (from 0), kind and state of the markets of plain answers; None where a line is anything else, or a value of another type."""
    from pyarrow import json as arrow_json

    block = b"\n".join(lines)
    if any(x in block for x in _UNTOLD) or (b"null" in block and _NULLS.search(block)) or not all(x.lstrip().startswith(b"{") and x.rstrip().endswith(b"}") for x in lines):
        return None
    try:
        block.decode()
        parse = arrow_json.ParseOptions(explicit_schema=_ANSWER, unexpected_field_behavior="ignore")
        answers = arrow_json.read_json(pa.BufferReader(block), arrow_json.ReadOptions(use_threads=False, block_size=len(block) + 1), parse).column("result").combine_chunks()
    except (ValueError, pa.ArrowException):
        return None
    if len(answers) != len(lines):
        return None
    states = answers.flatten()
    if states.null_count:
        return None
    named = pc.or_(pc.is_valid(states.field("event")), pc.is_valid(states.field("marketName")))
    return pa.RecordBatch.from_arrays([pc.list_parent_indices(answers).cast(pa.int32()), pc.if_else(named, "catalogue", "book"), states], names=["line", "kind", "state"])


def states(path: str, folder: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``envelopes`` and ``state``: a market's values where its block is plain, and then no text of it."""
    for first, lines in _blocks(path, folder):
        if (found := _read_at_once(lines)) is not None:
            n = len(found)
            none = pa.nulls(n, pa.string())
            columns = [pa.repeat(pa.scalar(path), n), pc.add(found["line"], pa.scalar(first, pa.int32())), found["kind"], none, none, found["state"]]
        else:
            rows = [(path, number, *row) for number, line in enumerate(lines, first) for row in _envelope_rows(line)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()))] + [pa.nulls(len(rows), _STATE)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays(columns, names=["file", "line", "kind", "market", "error", "state"])


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[File]:
        return [File(f) for f in _files(self.folder)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        return envelopes(partition.path, self.folder) if partition.path else iter(())


class _StateReader(_Reader):
    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return states(partition.path, self.folder) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are names: a batch holds the files behind its start up to its end."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802  the interface's name
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max(_files(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(f) for f in _files(self.folder) if start["file"] < f <= end["file"]]

    def read(self, partition: File) -> Iterator[tuple]:
        return envelopes(partition.path, self.folder)


class Recordings(DataSource):
    """``spark.read.format("exchange_recordings").load(folder)``, or ``readStream``; in batch, with option ``states``, plain markets come as values."""

    @classmethod
    def name(cls) -> str:
        return "exchange_recordings"

    def _states(self) -> bool:
        return self.options.get("states", "false").lower() == "true"

    def schema(self) -> str:
        return f"{ENVELOPE_ROW}, state {STATE}" if self._states() else ENVELOPE_ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_StateReader if self._states() else _Reader)(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options["path"])


def read_recordings(spark: SparkSession, folder: str, states: bool = False) -> DataFrame:
    spark.dataSource.register(Recordings)
    return spark.read.format(Recordings.name()).option("states", str(states).lower()).load(folder)


def stream_recordings(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(Recordings)
    return spark.readStream.format(Recordings.name()).load(folder)


def runner_books(rows: DataFrame) -> DataFrame:
    """One row a runner of the last book of each market, with what the last catalogue calls market and runner.

    Prices are best offers and the mean price of what was traded. A market that no catalogue names is
    without venue, time and names. The last is told by file and line. Recordings are read once: each
    market's runners become their few values where they are read, and markets are dealt by their id
    once, for books and catalogues alike.
    """
    of = lambda kind, schema: F.from_json(F.when(F.col("kind") == kind, F.col("market")), schema)
    values = F.col("state") if "state" in rows.columns else F.lit(None).cast(STATE)
    read = rows.where("kind is not null").select("file", "line", "kind", values.alias("s"), of("book", BOOK).alias("b"), of("catalogue", CATALOGUE).alias("c"))
    empty = F.array().cast(_LADDER)

    def priced(r: Column) -> Column:
        back, lay, traded = (F.coalesce(r["ex"][side], empty) for side in ("availableToBack", "availableToLay", "tradedVolume"))
        first = F.try_element_at(lay, F.lit(1))["price"]
        return F.struct(
            r["selectionId"].alias("selection_id"), r["status"].alias("status"), r["totalMatched"].alias("matched"),
            best_back(back, r["lastPriceTraded"]).alias("back"), first.alias("lay"), weighted_price(traded, back, lay).alias("vwap"),
        )

    def book(m: str) -> Column:
        return F.struct(F.col(f"{m}.status").alias("market_status"), F.col(f"{m}.inplay").alias("inplay"), F.transform(f"{m}.runners", priced).alias("runners"))

    def named(m: str) -> Column:
        runner = lambda r: F.struct(r["selectionId"].alias("selection_id"), r["runnerName"].alias("name"))
        return F.struct(F.col(f"{m}.event.venue").alias("venue"), F.col(f"{m}.marketStartTime").alias("off"), F.transform(f"{m}.runners", runner).alias("runners"))

    known, is_book, is_named = F.col("s").isNotNull(), F.col("kind") == "book", F.col("kind") == "catalogue"
    states = read.select(
        F.coalesce("s.marketId", "b.marketId", "c.marketId").alias("market_id"), "kind", F.struct("file", "line").alias("at"),
        F.when(is_book & known, book("s")).when(is_book, book("b")).alias("book"), F.when(is_named & known, named("s")).when(is_named, named("c")).alias("named"),
    )
    last = lambda kind, state: F.max_by(state, F.when(F.col("kind") == kind, F.col("at"))).alias(state)
    markets = states.repartition("market_id").groupBy("market_id").agg(last("book", "book"), last("catalogue", "named"))
    runners = markets.select("market_id", "book.market_status", "book.inplay", "named", F.explode("book.runners").alias("r"))
    # what a market without an id is called is not known
    mine = F.when(F.col("market_id").isNotNull(), F.filter("named.runners", lambda x: x["selection_id"] == F.col("r.selection_id")))
    named_runners = runners.select("market_id", "market_status", "inplay", "r", "named.venue", "named.off", F.explode_outer(mine).alias("n"))
    if_named = lambda x: F.when(F.col("n").isNotNull(), x)
    return named_runners.select("market_id", "r.selection_id", "market_status", "inplay", "r.status", "r.matched", "r.back", "r.lay", "r.vwap", if_named(F.col("venue")).alias("venue"), if_named(F.try_to_timestamp("off")).alias("off"), "n.name")


def _envelope(markets: Column) -> Column:
    return F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), markets.alias("result"), F.lit(1).alias("id")))


@table_query(
    "src_order_book",
    """
SELECT CAST(l_orderkey AS VARCHAR) AS market_id, l_linenumber AS selection_id, CASE WHEN l_orderkey % 5 <> 0 THEN concat('Course ', l_orderkey % 25) END AS venue, CASE WHEN l_orderkey % 5 <> 0 THEN concat('Horse ', l_partkey) END AS name,
  round(1 + l_quantity / 10, 2) AS back, round(2 + l_quantity / 10, 2) AS lay, round((2 * (1 + l_quantity / 10) + l_quantity) / 3, 6) AS vwap
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)""",
)
def order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as recorded answers: catalogues of most markets, and books of all, an old one and a new one."""
    folder = scratch(spark, "recordings")
    # forty markets an answer, as they are asked for: lines are dealt by answer once, all that is gathered stays there, and only its values wait for the three recordings
    dealt = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.floor(F.col("l_orderkey") / 40).alias("a"), F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_quantity").repartition("a")
    lines = dealt.groupBy("a", "k", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_quantity").alias("l_quantity"))
    markets = lines.groupBy("a", "k").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("lines"))
    answers = markets.groupBy("a").agg(F.collect_list(F.struct("k", "lines")).alias("markets")).select("markets").persist(StorageLevel.DISK_ONLY)

    def step(p: Column, size: Column | float) -> Column:
        return F.struct(p.cast("double").alias("price"), (F.lit(size) if isinstance(size, float) else size).cast("double").alias("size"))

    def book(shift: float) -> Callable[[Column], Column]:
        def runner(x: Column) -> Column:
            p = F.round(1 + x["l_quantity"] / 10, 2) + shift
            ex = F.struct(F.array(step(p, 5.0), step(p - 0.5, 9.0)).alias("availableToBack"), F.array(step(p + 1, 5.0)).alias("availableToLay"), F.array(step(p, 2.0), step(x["l_quantity"], 1.0)).alias("tradedVolume"))
            return F.struct(x["l_linenumber"].alias("selectionId"), F.lit("ACTIVE").alias("status"), F.lit(3.0).alias("totalMatched"), ex.alias("ex"))

        return lambda m: F.struct(m["k"].cast("string").alias("marketId"), F.lit("OPEN").alias("status"), F.transform(m["lines"], runner).alias("runners"))

    def catalogue(m: Column) -> Column:
        runner = lambda x: F.struct(x["l_linenumber"].alias("selectionId"), F.concat(F.lit("Horse "), x["l_partkey"].cast("string")).alias("runnerName"))
        event = F.struct(F.concat(F.lit("Course "), (m["k"] % 25).cast("string")).alias("venue"))
        return F.struct(m["k"].cast("string").alias("marketId"), F.lit("Win").alias("marketName"), event.alias("event"), F.transform(m["lines"], runner).alias("runners"))

    named = F.filter("markets", lambda m: m["k"] % 5 != 0)
    for part, asked, market in (("0", F.col("markets"), book(7.0)), ("1", named, catalogue), ("2", F.col("markets"), book(0.0))):
        answers.select(asked.alias("asked")).where("size(asked) > 0").select(_envelope(F.transform("asked", market)).alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(f"{folder}/{part}")
    answers.unpersist()
    out = runner_books(read_recordings(spark, folder, states=True))
    return out.select("market_id", F.col("selection_id").cast("int").alias("selection_id"), "venue", "name", F.round("back", 2).alias("back"), F.round("lay", 2).alias("lay"), F.round("vwap", 6).alias("vwap"))
