"""Sources whose rows are nested or shifted: profile pages, result JSON, price files of two layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.plans.scratch import scratch
from railside.registry import table_query
from railside.sources import feeds
from railside.sources.queries import _price_files

# A stitched file's columns; older files lack the venue.
_SIDE = "bsp ppwap morningwap ppmax ppmin ipmax ipmin morning_vol pre_vol ip_vol".split()
STITCHED_COLUMNS = ["date", "off", "event_name", "venue", "horse", *[f"win_{x}" for x in _SIDE], "win_lose", *[f"place_{x}" for x in _SIDE], "place_win_lose"]
# The countries whose races are taken.
COUNTRIES = ["ENG", "SCO", "Wale", "Eire"]

STATE = "profile struct<horseUid: bigint, horseName: string, age: string>"
RACE = "id bigint, country string, rides array<struct<horse: string, jockey: string>>"
BETTING = "id bigint, rides array<struct<horse: string, odds: double>>"


def read_records(spark: SparkSession, path: str, region: str) -> DataFrame:
    """Price records of one region: day, off, region, horse, bsp with two decimals as text.

    Records without a readable time are dropped; an empty or unreadable price is null.
    """
    at = F.try_to_timestamp("event_dt", F.lit("dd-MM-yyyy HH:mm"))
    horse = F.lower(F.trim(F.regexp_replace("selection_name", r"\s*\([A-Za-z]{2,3}\)\s*$", "")))
    rows = feeds.read_prices(spark, path).withColumn("at", at).where("at is not null")
    return rows.select(F.date_format("at", "yyyy-MM-dd").alias("day"), F.date_format("at", "HH:mm").alias("off"), F.lit("GB" if region == "UK" else region).alias("region"), horse.alias("horse"), F.format_string("%.2f", F.col("bsp").try_cast("double")).alias("bsp"))


def read_stitched(spark: SparkSession, path: str) -> DataFrame:
    """Stitched price files of both layouts in one scan; rows without a venue have a null one.

    A row of the older layout is one field short: its fields from the horse on move one place. Rows
    that are shorter still are dropped.
    """
    schema = ", ".join(f"`{c}` string" for c in STITCHED_COLUMNS) + ", _corrupt string"
    rows = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", False).csv(path)
    commas = F.length(F.regexp_replace("_corrupt", r'"[^"]*"|[^,]', ""))
    rows = rows.withColumn("old", F.when(F.col("_corrupt").isNull(), False).when(commas == len(STITCHED_COLUMNS) - 2, True)).where("old is not null and length(concat_ws('', `date`)) >= 0")
    at = STITCHED_COLUMNS.index("venue")
    moved = [F.when(~F.col("old"), F.col("venue")).alias("venue")]
    moved += [F.when(F.col("old"), F.col(before)).otherwise(F.col(c)).alias(c) for before, c in zip(STITCHED_COLUMNS[at:], STITCHED_COLUMNS[at + 1 :])]
    return rows.select(*STITCHED_COLUMNS[:at], *moved)


def page_state(html: Column | str) -> Column:
    """The profile that a page's script assigns, null if there is none."""
    line = F.regexp_extract(html, r"window\.PRELOADED_STATE\s*=([^\n]*)", 1)
    return F.from_json(F.regexp_replace(F.trim(line), r"[;\s]+$", ""), STATE)["profile"]


def card_links(html: Column | str) -> Column:
    """Distinct links to race cards of a page, in their order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="(/racecards/[^"]+)"'), F.lit(1)))


def profiles(pages: DataFrame) -> DataFrame:
    """url, html -> horse_id, name, age. A page without a profile is named by its address."""
    parts = F.split("url", "/")
    known = pages.withColumn("p", page_state("html"))
    age = F.split(F.trim(F.regexp_replace("p.age", "Died as a", "")), "-")[0].try_cast("int")
    named = F.initcap(F.regexp_replace(F.try_element_at(parts, F.lit(7)), "-", " "))
    return known.select(F.coalesce("p.horseUid", F.try_element_at(parts, F.lit(6)).try_cast("long")).alias("horse_id"), F.coalesce("p.horseName", named).alias("name"), age.alias("age"))


def results(races: DataFrame, betting: DataFrame) -> DataFrame:
    """Rides of the countries taken, with their odds by race and horse name: one row per ride.

    Names are compared trimmed and in lower case; of several odds for one name the lowest counts.
    """
    key = F.lower(F.trim("ride.horse"))
    region = F.when(F.col("country") == "Eire", "IRE").otherwise("GB")
    rides = races.where(F.col("country").isin(COUNTRIES)).select("id", region.alias("region"), F.explode("rides").alias("ride")).select("id", "region", F.trim("ride.horse").alias("horse"), F.col("ride.jockey").alias("jockey"), key.alias("key"))
    odds = betting.select("id", F.size("rides").alias("ran"), F.explode("rides").alias("ride")).groupBy("id", key.alias("key")).agg(F.max("ran").alias("ran"), F.min("ride.odds").alias("odds"))
    return rides.join(odds, ["id", "key"], "left").drop("key")


@table_query("src_bsp_csv_py", "SELECT '2024-01-05' AS day, '13:05' AS off, 'GB' AS region, concat('horse ', l_partkey) AS horse, printf('%.2f', floor(100 + l_extendedprice / 50) / 100) AS bsp FROM lineitem")
def price_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(spark, _price_files(spark, sf_dir, "true"), "UK")


@table_query("src_stitched_csv", "SELECT concat('R', o_orderkey) AS event_name, CASE WHEN o_orderkey % 3 <> 0 THEN concat('V', o_custkey) END AS venue, concat('Horse ', o_custkey) AS horse, floor(100 + o_totalprice / 50) / 100 AS win_bsp, CAST(o_orderkey % 2 AS BIGINT) AS place_win_lose FROM orders")
def stitched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with and without a venue in one folder."""
    path = scratch(spark, "stitched_prices")
    values = {"date": "'2024-01-05'", "off": "'13:05'", "event_name": "concat('R', o_orderkey)", "venue": "concat('V', o_custkey)", "horse": "concat('Horse ', o_custkey)", "win_bsp": "floor(100 + o_totalprice / 50) / 100", "place_win_lose": "o_orderkey % 2"}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for condition, columns in (("o_orderkey % 3 <> 0", STITCHED_COLUMNS), ("o_orderkey % 3 = 0", [c for c in STITCHED_COLUMNS if c != "venue"])):
        orders.where(condition).selectExpr(*[f"CAST({values.get(c, '2.5')} AS STRING) AS `{c}`" for c in columns]).write.mode("append").option("header", True).csv(path)
    return read_stitched(spark, path).select("event_name", "venue", "horse", F.col("win_bsp").try_cast("double").alias("win_bsp"), F.col("place_win_lose").try_cast("long").alias("place_win_lose"))


@table_query("src_racecard_html", "SELECT p_partkey AS horse_id, concat('Horse ', p_partkey) AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS age, CAST(2 AS INT) AS links FROM part")
def racecard_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile pages, every fourth without its script, and the cards that each page names."""
    key, age = F.col("p_partkey").cast("string"), F.concat(F.when(F.col("p_partkey") % 5 == 0, "Died as a ").otherwise(""), F.col("p_size").cast("string"), F.lit("-y-o"))
    state = F.to_json(F.struct(F.struct(F.col("p_partkey").alias("horseUid"), F.concat(F.lit("Horse "), key).alias("horseName"), age.alias("age")).alias("profile")))
    script = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("<script>window.PRELOADED_STATE = "), state, F.lit(";\n</script>"))).otherwise("")
    links = F.concat(F.lit('<a href="/racecards/1/'), key, F.lit('"></a><a href="/racecards/2/'), key, F.lit('"></a><a href="/racecards/1/'), key, F.lit('"></a>'))
    pages = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("https://example.test/profile/horse/"), key, F.lit("/horse-"), key).alias("url"), F.concat(F.lit("<html><body>"), script, links, F.lit("</body></html>")).alias("html"))
    return profiles(pages).join(pages.select(F.split("url", "/")[5].cast("long").alias("horse_id"), F.size(card_links("html")).alias("links")), "horse_id")


@table_query("src_results_json", "SELECT l_orderkey AS id, CASE WHEN o_custkey % 6 = 3 THEN 'IRE' ELSE 'GB' END AS region, concat('Horse ', l_partkey) AS horse, concat('J', l_suppkey) AS jockey, CASE WHEN l_orderkey % 2 = 0 THEN n END AS ran, CASE WHEN l_orderkey % 2 = 0 THEN odds END AS odds FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN (SELECT l_orderkey AS k, l_partkey AS p, min(floor(100 + l_extendedprice / 50) / 100) AS odds FROM lineitem GROUP BY 1, 2) x ON k = l_orderkey AND p = l_partkey JOIN (SELECT l_orderkey AS c, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1) y ON c = l_orderkey WHERE o_custkey % 6 < 4")
def results_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Race files and betting files; betting files of every second race are missing."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    country = F.try_element_at(F.array(*[F.lit(x) for x in (*COUNTRIES, "FR", "USA")]), (F.col("o_custkey") % 6 + 1).cast("int"))
    heads = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), country.alias("country"))
    horse, price = F.concat(F.lit("Horse "), F.col("l_partkey").cast("string")), F.floor(100 + F.col("l_extendedprice") / 50) / 100
    rides = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.concat(F.lit(" "), horse).alias("horse"), F.concat(F.lit("J"), F.col("l_suppkey").cast("string")).alias("jockey"))).alias("rides"))
    odds = lines.where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.concat(F.upper(horse), F.lit(" ")).alias("horse"), price.alias("odds"))).alias("rides"))
    races, betting = scratch(spark, "races_json"), scratch(spark, "betting_json")
    heads.join(rides, "id").write.json(races)
    odds.write.json(betting)
    return results(spark.read.schema(RACE).json(races), spark.read.schema(BETTING).json(betting))
