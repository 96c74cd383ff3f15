"""Round trips of the sources and sinks: rows of the order tables written as a feed and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railside.plans.racing import Racing
from railside.plans.scratch import scratch
from railside.plans.snapshots import Snapshots
from railside.registry import racing_query, table_query
from railside.sources import feeds

_FEED = {
    "event_id": "l_orderkey",
    "menu_hint": "concat('Ascot ', l_linenumber, 'th')",
    "event_name": "concat('R', l_orderkey)",
    "event_dt": "'05-01-2024 13:05'",
    "selection_id": "l_partkey",
    "selection_name": "concat('Horse ', l_partkey)",
    "win_lose": "CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END",
    "bsp": "floor(100 + l_extendedprice / 50) / 100",
}


def _price_files(spark: SparkSession, sf_dir: str, condition: str) -> str:
    path = scratch(spark, "prices")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(condition).selectExpr(*[f"CAST({x} AS STRING) AS {name}" for name, x in _FEED.items()])
    lines.select("*", *[F.lit("2.5").alias(x) for x in feeds.PRICE_COLUMNS[8:]]).write.option("header", True).csv(path)
    return path


@table_query("src_bsp_csv", "SELECT l_orderkey AS event_id, l_partkey AS selection_id, floor(100 + l_extendedprice / 50) / 100 AS bsp FROM lineitem")
def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds.read_prices(spark, _price_files(spark, sf_dir, "true"))
    return rows.select(F.col("event_id").try_cast("long").alias("event_id"), F.col("selection_id").try_cast("long").alias("selection_id"), F.col("bsp").try_cast("double").alias("bsp"))


@table_query("src_bsp_fetcher", "SELECT coalesce(w.e, p.e) AS event_id, coalesce(w.s, p.s) AS selection_id, win, place FROM (SELECT l_orderkey AS e, l_partkey AS s, max(floor(100 + l_extendedprice / 50) / 100) AS win FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) w FULL JOIN (SELECT l_orderkey AS e, l_partkey AS s, max(floor(100 + l_extendedprice / 50) / 100) AS place FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2) p ON w.e = p.e AND w.s = p.s")
def win_and_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN and PLACE files joined by race and runner; rows of one of them stay."""

    def side(condition: str, name: str) -> DataFrame:
        rows = feeds.read_prices(spark, _price_files(spark, sf_dir, condition))
        return rows.groupBy(F.col("event_id").try_cast("long").alias("event_id"), F.col("selection_id").try_cast("long").alias("selection_id")).agg(F.max(F.col("bsp").try_cast("double")).alias(name))

    return side("l_linenumber <= 3", "win").join(side("l_linenumber >= 3", "place"), ["event_id", "selection_id"], "full_outer")


def _month_files(r: Racing, compression: str = "none") -> str:
    spark = r.races.sparkSession
    path = scratch(spark, "months")
    rows = r.races.select("race_id", "race_date", F.col("course_id").alias("course"), F.date_format("race_date", "yyyy-MM").alias("month"))
    # one file a month folder at most for each task: months are dealt first
    rows.repartition("month").write.partitionBy("month").option("header", True).option("compression", compression).csv(path)
    return path


_MONTHS = "SELECT race_id, race_date, course_id AS course, strftime(race_date, '%Y-%m') AS month FROM races"


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("race_id").cast("long").alias("race_id"), F.col("race_date").cast("date").alias("race_date"), F.col("course").cast("long").alias("course"), F.date_format(F.col("race_date").cast("date"), "yyyy-MM").alias("month"))


@racing_query("src_master_csv", _MONTHS)
def master_files(r: Racing) -> DataFrame:
    return _typed(feeds.read_text_columns(r.races.sparkSession, _month_files(r), "race_id", "race_date"))


@racing_query("sink_csv_gzip", _MONTHS)
def gzipped_files(r: Racing) -> DataFrame:
    return _typed(feeds.read_text_columns(r.races.sparkSession, _month_files(r, "gzip"), "race_id", "race_date"))


@racing_query("src_master_discover", "SELECT strftime(race_date, '%Y-%m') AS month, count(*) AS races FROM races GROUP BY 1")
def discovered(r: Racing) -> DataFrame:
    """Months that the folders name, with their rows."""
    rows = r.races.sparkSession.read.option("header", True).option("inferSchema", False).csv(_month_files(r))
    return rows.groupBy(F.date_format(F.col("race_date").cast("date"), "yyyy-MM").alias("month")).agg(F.count("*").alias("races"))


@racing_query("src_rp_month", "SELECT race_id, num, count(*) OVER (PARTITION BY race_id) AS ran FROM runners JOIN races USING (race_id) WHERE race_date BETWEEN DATE '1999-05-01' AND DATE '1999-05-31'")
def month_results(r: Racing) -> DataFrame:
    """A month's runners with their race's number of rows, from month files; a copy of each is INCOMPLETE."""
    spark, path = r.races.sparkSession, scratch(r.races.sparkSession, "results")
    rows = r.runners.join(r.races.select("race_id", F.date_format("race_date", "yyyy-MM").alias("month")), "race_id").select("race_id", "num", "month")
    for mark in ("", "_INCOMPLETE"):
        rows.withColumn("file", F.concat("month", F.lit(mark))).drop("month").repartition("file").write.mode("append").partitionBy("file").option("header", True).csv(path)
    rows = feeds.read_month(spark, path, "1999-05", "race_id", "num").select(F.col("race_id").cast("long").alias("race_id"), F.col("num").cast("int").alias("num"))
    return rows.join(rows.groupBy("race_id").agg(F.count("*").alias("ran")), "race_id")


@racing_query("src_bf_index", "SELECT concat('prices_', strftime(date_trunc('week', race_date), '%Y_%m_%d'), '.csv') AS file, CAST(date_trunc('week', race_date) AS DATE) AS day, count(*) AS n FROM runners JOIN races USING (race_id) WHERE day(date_trunc('week', race_date)) % 5 <> 0 GROUP BY 1, 2 HAVING count(*) >= 3")
def price_index(r: Racing, least: int = 3) -> DataFrame:
    """Price files of weeks, told by their names; in every fifth a column is missing, so that it is left out."""
    spark, path = r.races.sparkSession, scratch(r.races.sparkSession, "price_index")
    weeks = r.races.select("race_id", F.date_trunc("week", "race_date").cast("date").alias("week"))
    runners = r.runners.select("race_id", "num")
    for condition, column in (("day(week) % 5 <> 0", "bsp"), ("day(week) % 5 = 0", "price")):
        rows = r.with_races(runners, weeks.where(condition)).hint("rebalance", "week")
        file = F.concat(F.lit("prices_"), F.date_format("week", "yyyy_MM_dd"), F.lit(".csv"))
        own = rows.select(file.alias("file"), F.col("race_id").alias("event_id"), F.col("num").alias("selection_id"), F.lit("2.5").alias(column))
        own.write.mode("append").partitionBy("file").option("header", True).csv(path)
    return feeds.file_index(spark, path, ["event_id", "selection_id", "bsp"], least)


@racing_query("sink_master_csv", "SELECT race_id, race_type FROM races WHERE race_id % 3 <> 2")
def appended(r: Racing) -> DataFrame:
    """Two overlapping batches appended by key: no key stands twice."""
    spark, path = r.races.sparkSession, scratch(r.races.sparkSession, "master")
    rows = r.races.select("race_id", "race_type")
    feeds.append_new(spark, rows.where("race_id % 3 = 0"), path, ["race_id"], ["race_type"])
    feeds.append_new(spark, rows.where("race_id % 3 <> 2"), path, ["race_id"], ["race_type"])
    return spark.read.option("header", True).csv(path).select(F.col("race_id").cast("long").alias("race_id"), "race_type")


@racing_query("sink_stitched", "SELECT race_type, surface, count(*) AS n FROM races GROUP BY 1, 2")
def stitched(r: Racing) -> DataFrame:
    spark, path = r.races.sparkSession, scratch(r.races.sparkSession, "stitched")
    r.races.select("race_id", "race_type", "surface").repartition("race_type", "surface").write.partitionBy("race_type", "surface").option("header", True).csv(path)
    return spark.read.option("header", True).csv(path).groupBy("race_type", "surface").agg(F.count("*").alias("n"))


@racing_query("sink_manifest", "SELECT strftime(race_date, '%Y-%m') AS month, count(*) AS races FROM races GROUP BY 1")
def manifest(r: Racing) -> DataFrame:
    """A ledger of months; a second run over all months adds only those that it lacks."""
    spark, path = r.races.sparkSession, scratch(r.races.sparkSession, "manifest")
    months = r.races.groupBy(F.date_format("race_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("races"))
    months.where("month < '1996'").write.json(path)
    months.join(spark.read.json(path).select("month"), "month", "left_anti").write.mode("append").json(path)
    return spark.read.schema("month string, races long").json(path)


@racing_query("sink_json", "SELECT race_id, CAST(count(*) AS INT) AS n FROM runners GROUP BY 1")
def nested_json(r: Racing) -> DataFrame:
    """Races with their runners nested, as JSON and back."""
    path = scratch(r.races.sparkSession, "json")
    r.runners.groupBy("race_id").agg(F.collect_list(F.struct("num", "horse_id")).alias("runners")).write.json(path)
    return r.races.sparkSession.read.schema("race_id long, runners array<struct<num: int, horse_id: bigint>>").json(path).select("race_id", F.size("runners").alias("n"))


@table_query("src_json_cache", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def cached_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache by day, read through: half of the days are asked for first, then all, and the others are fetched then."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    days = [r.day for r in events.select("day").distinct().orderBy("day").collect()]  # a row a day
    cache = feeds.DayCache(spark, scratch(spark, "cache"))

    def fetch(asked: list) -> DataFrame:
        return events.where(F.col("day").isin(asked)).select("event_id", "user_id", "value", "day")

    cache.through(days[::2], fetch)
    return cache.through(days, fetch).groupBy("day").agg(F.count("*").alias("n"))


@table_query("src_nested_books", "SELECT l_orderkey AS market_id, CAST(count(*) AS INT) AS runners, round(max(l_extendedprice), 2) AS longest FROM lineitem GROUP BY 1")
def order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested order books as JSON files, read with their schema."""
    path = scratch(spark, "books")
    ladder = F.array(F.struct(F.round("l_extendedprice", 2).alias("price"), F.col("l_quantity").alias("size")))
    runner = F.struct(F.col("l_partkey").alias("selection_id"), F.lit(2.0).alias("last"), ladder.alias("back"), ladder.alias("lay"), ladder.alias("traded"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").cast("string").alias("market_id")).agg(F.lit(False).alias("inplay"), F.collect_list(runner).alias("runners")).write.json(path)
    best = F.array_max(F.transform("runners", lambda x: F.try_element_at(x["back"], F.lit(1))["price"]))
    return feeds.read_books(spark, path).select(F.col("market_id").cast("long").alias("market_id"), F.size("runners").alias("runners"), best.alias("longest"))


@racing_query("scan_pg", "SELECT race_id, race_date, surface FROM races WHERE race_date = DATE '1999-05-05'")
def scan(r: Racing) -> DataFrame:
    return r.races.where("race_date = DATE '1999-05-05'").select("race_id", "race_date", "surface")


@racing_query(
    "src_dates",
    "SELECT CAST(d AS DATE) AS d, coalesce(n, 0) AS races FROM (SELECT unnest(generate_series(CAST(min(race_date) AS TIMESTAMP), CAST(max(race_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM races) LEFT JOIN (SELECT race_date, count(*) AS n FROM races GROUP BY 1) ON race_date = CAST(d AS DATE)",
)
def date_range(r: Racing) -> DataFrame:
    """Each day of the range from the first race to the last, given as YYYY/MM/DD-YYYY/MM/DD, and its races."""
    ends = r.races.agg(F.concat_ws("-", F.date_format(F.min("race_date"), "yyyy/MM/dd"), F.date_format(F.max("race_date"), "yyyy/MM/dd"))).first()[0]  # one row
    days = r.races.groupBy(F.col("race_date").alias("d")).agg(F.count("*").alias("n"))
    return feeds.days_between(r.spark, ends).join(days, "d", "left").select("d", F.coalesce("n", F.lit(0)).cast("long").alias("races"))


def _range_files(r: Racing) -> str:
    """Races by type, in a file for each run of days without a gap, named start-end.csv."""
    path = scratch(r.races.sparkSession, "ranges")
    day = F.datediff("race_date", F.lit("1970-01-01").cast("date"))
    days = r.races.select("race_type", "race_date").distinct().withColumn("run", day - F.row_number().over(Window.partitionBy("race_type").orderBy("race_date")))
    ends = days.withColumns({"a": F.min("race_date").over(Window.partitionBy("race_type", "run")), "b": F.max("race_date").over(Window.partitionBy("race_type", "run"))})
    name = F.concat(F.date_format("a", "yyyy_MM_dd"), F.lit("-"), F.date_format("b", "yyyy_MM_dd"), F.lit(".csv"))
    named = r.races.join(ends.select("race_type", "race_date", name.alias("file")), ["race_type", "race_date"]).select("race_id", "race_type", "file")
    named.repartition("race_type", "file").write.partitionBy("race_type", "file").option("header", True).csv(path)
    return path


@racing_query("src_coverage", "SELECT race_type, count(DISTINCT race_date) AS days FROM races GROUP BY 1")
def coverage(r: Racing) -> DataFrame:
    """Days that the names of the files cover."""
    return feeds.days_covered(r.races.sparkSession, _range_files(r), "race_type").groupBy("race_type").agg(F.countDistinct("day").alias("days"))


@racing_query("src_latest_date", "SELECT race_type, max(race_date) AS latest FROM races GROUP BY 1")
def latest_date(r: Racing) -> DataFrame:
    """The last day that the names of the files tell."""
    return feeds.file_ranges(r.races.sparkSession, _range_files(r), "race_type").groupBy("race_type").agg(F.max("last").alias("latest"))


@table_query("src_page_titles", r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title>', 1), ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction from HTML: the first title of each page."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", F.coalesce(F.try_element_at(feeds.tag_texts(F.coalesce("html", F.lit("")), "title"), F.lit(1)), F.lit("")).alias("title"))


@racing_query("mv_refresh", "SELECT horse_id, count(*) AS runs, CAST(2 AS BIGINT) AS version FROM runners JOIN races USING (race_id) GROUP BY 1")
def refreshed_snapshot(r: Racing) -> DataFrame:
    """The base snapshot by month: made without the last months, then refreshed, which writes those months only.

    It is read by its manifest; a reader of the first version would still see that. A refresh goes
    through its rows twice, so runners meet their races once, before both.
    """
    table, path = Snapshots(r.spark, scratch(r.spark, "base"), "race_month"), scratch(r.spark, "base_rows")
    months = r.races.select("race_id", F.date_format("race_date", "yyyy-MM").alias("race_month"))
    r.with_races(r.runners.select("race_id", "num", "horse_id", "win_bsp"), months).write.parquet(path)
    base = r.spark.read.parquet(path)
    table.refresh(base.where("race_month < '1998-06'"))
    now, _ = table.refresh(base)
    return table.read(now).groupBy("horse_id").agg(F.count("*").alias("runs")).withColumn("version", F.lit(now.version).cast("long"))


@racing_query("partitions", "SELECT strftime(race_date, '%Y-%m') AS month, count(*) AS races FROM races WHERE race_date >= DATE '2000-11-01' AND race_date < DATE '2001-02-01' GROUP BY 1")
def month_partitions(r: Racing) -> DataFrame:
    """Month partitions: a filter on the month prunes folders."""
    path = scratch(r.races.sparkSession, "races")
    r.races.withColumn("race_month", F.date_format("race_date", "yyyyMM").cast("int")).repartition("race_month").write.partitionBy("race_month").parquet(path)
    rows = r.races.sparkSession.read.parquet(path).where("race_month between 200011 and 200101")
    return rows.groupBy(F.date_format("race_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("races"))
