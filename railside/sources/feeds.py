"""Readers and writers of the feeds: price files, month files, order books, result pages, ledgers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.plans.snapshots import Files, Snapshots

# The columns of exchange price files.
PRICE_COLUMNS = "event_id menu_hint event_name event_dt selection_id selection_name win_lose bsp ppwap morningwap ppmax ppmin ipmax ipmin morningtradedvol pptradedvol iptradedvol".split()

BOOK = "market_id string, inplay boolean, runners array<struct<selection_id: bigint, last: double, back: array<struct<price: double, size: double>>, lay: array<struct<price: double, size: double>>, traded: array<struct<price: double, size: double>>>>"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price files as text columns; rows with fewer fields are dropped, which needs all columns read."""
    schema = ", ".join(f"{c} string" for c in PRICE_COLUMNS) + ", _corrupt string"
    rows = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).csv(path)
    # a condition on another column as well: Spark refuses to read the corrupt record alone, as a count would
    return rows.where("_corrupt is null and length(concat_ws('', event_id)) >= 0").drop("_corrupt")


def read_text_columns(spark: SparkSession, path: str, *needed: str) -> DataFrame:
    """CSV files by their header, every column text; folders of key=value become columns."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", False).csv(path)
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise ValueError(f"columns that the files lack: {', '.join(missing)}")
    return rows


def read_month(spark: SparkSession, path: str, month: str, *needed: str) -> DataFrame:
    """Rows of a month's files, of which the name begins with the month; INCOMPLETE ones are skipped."""
    rows = read_text_columns(spark, path, *needed).withColumn("_name", F.regexp_extract("_metadata.file_path", r"(?:^|[/=])([^/=]*)/[^/]*$", 1))
    return rows.where(F.col("_name").startswith(month) & ~F.col("_name").contains("INCOMPLETE")).select(*needed)


def file_ranges(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(kind, first, last) of every file in a folder of its kind whose name is start-end.csv; others are skipped."""
    files = spark.read.text(path).select(F.col("_metadata.file_path").alias("at")).distinct()
    part = r"(\d{4}_\d{2}_\d{2})"
    name = rf"{kind}=([^/]+)/(?:[^/]*=)?{part}-{part}\.csv(?:/|$)"
    kind_of, first, last = (F.regexp_extract("at", name, i) for i in (1, 2, 3))
    return files.where(F.col("at").rlike(name)).select(kind_of.alias(kind), F.to_date(first, "yyyy_MM_dd").alias("first"), F.to_date(last, "yyyy_MM_dd").alias("last"))


def days_covered(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Each day of each file's range by kind, once for every file."""
    return file_ranges(spark, path, kind).select(kind, F.explode(F.sequence("first", "last")).alias("day"))


def file_index(spark: SparkSession, path: str, needed: list[str], least: int = 3) -> DataFrame:
    """(file, day, n) of the CSV files named with a day that have the needed columns and ``least`` rows or more.

    A file may be a folder of parts, each with its header. Names are told from paths, columns from
    header lines: lines of which the fields hold all the needed names.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("at"), "value")
    fields = F.split(F.regexp_replace("value", '"', ""), ",")
    is_header = F.col("value").contains(needed[0])
    for c in needed:
        is_header &= F.array_contains(fields, c)
    # lines are counted by part first, and a part's path is an aggregate, so that a condition on its name is no line's
    parts = lines.groupBy("at").agg(F.first("at").alias("path"), F.count_if(~is_header).alias("n"), F.bool_or(is_header).alias("complete"))
    name = F.regexp_extract("path", r"([^/=]*\d{4}_\d{2}_\d{2}[^/=]*\.csv)(?:/[^/]*)?$", 1)
    files = parts.groupBy(name.alias("file")).agg(F.sum("n").alias("n"), F.bool_or("complete").alias("complete")).where((F.col("file") != "") & F.col("complete") & (F.col("n") >= least))
    return files.select("file", F.to_date(F.regexp_extract("file", r"(\d{4}_\d{2}_\d{2})", 1), "yyyy_MM_dd").alias("day"), "n")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOOK).json(path)


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], parts: list[str]) -> None:
    """Append the rows whose keys the files lack, by partition folder. One writer at a time."""
    files = Files(spark, path)
    if files.fs.exists(files.path("")):
        rows = rows.join(spark.read.option("header", True).csv(path).select(*keys), keys, "left_anti")
    rows.write.partitionBy(*parts).option("header", True).mode("append").csv(path)


class DayCache:
    """Rows by day, fetched once: a day that was fetched is not asked for again, even if it had no rows.

    Days are parts of a versioned table, so a day is there as a whole or not at all, and readers
    keep what they saw.
    """

    def __init__(self, spark: SparkSession, path: str, day: str = "day"):
        self.table, self.day = Snapshots(spark, path, day), day

    def through(self, days: list[date], fetch: Callable[[list[date]], DataFrame]) -> DataFrame:
        """The rows of some days; ``fetch`` gives those of the days that are not cached."""
        now = self.table.manifest()
        known = set(now.marks.get("days", []))
        missing = [d for d in days if str(d) not in known]
        if missing:
            now = self.table.replace(fetch(missing), missing, {"days": sorted({*known, *map(str, missing)})}, now)
        return self.table.read(now, days)


def dates_of(text: str) -> list[date]:
    """First and last day of a-b with YYYY/MM/DD days, or years."""
    ends = [x.strip() for x in text.split("-")]
    first, last = ends[0], ends[-1]
    return [date(int(first), 1, 1) if len(first) == 4 else date(*map(int, first.split("/"))), date(int(last), 12, 31) if len(last) == 4 else date(*map(int, last.split("/")))]


def days_between(spark: SparkSession, text: str) -> DataFrame:
    first, last = dates_of(text)
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("d"))


def tag_texts(html, tag: str):
    """Texts of all elements of a name without nested ones, trimmed, tags inside removed."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))
