"""Market analytics: calibration, movers, in-play ranges, book against exchange."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railside.functions.columns import buckets, count_where, mean, rate
from railside.plans.months import MonthStore
from railside.plans.racing import Racing
from railside.registry import racing_query

WIN_BINS = ((2, "1.0-2.0"), (3, "2.0-3.0"), (5, "3.0-5.0"), (10, "5.0-10.0"), (20, "10.0-20.0"))
PLACE_BINS = ((1.5, "1.0-1.5"), (2, "1.5-2.0"), (3, "2.0-3.0"), (5, "3.0-5.0"))


def dated(r: Racing, date_from: str | None, date_to: str | None) -> DataFrame:
    """Races of an inclusive date range; the filter reaches the scan."""
    races = r.races
    if date_from:
        races = races.where(F.col("race_date") >= F.lit(date.fromisoformat(date_from)))
    if date_to:
        races = races.where(F.col("race_date") <= F.lit(date.fromisoformat(date_to)))
    return races


def _calibration(rows: DataFrame, price: str, hit: Column, bins: Column) -> DataFrame:
    rows = rows.where(F.col(price) > 0).select(bins.alias("price_bin"), F.col(price).alias("price"), hit.alias("hit"))
    sums = rows.groupBy("price_bin").agg(F.count("*").alias("runners"), count_where(F.col("hit")).alias("wins"), F.avg("price").alias("mean_price"), F.min("price").alias("low"))
    out = sums.select("price_bin", "runners", "wins", rate(F.col("wins"), F.col("runners")).alias("actual_sr"), F.round(100 / F.col("mean_price"), 4).alias("implied_sr"), F.round(100 * F.col("wins") / F.col("runners") - 100 / F.col("mean_price"), 4).alias("edge"), "low")
    return out.orderBy("low").drop("low")


_CALIBRATION_SQL = """
WITH b AS (SELECT CASE {bins} END AS price_bin, {price} AS p, {hit} AS hit FROM runners JOIN races USING (race_id) WHERE {price} > 0 AND race_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')
SELECT price_bin, count(*) AS runners, count(*) FILTER (hit) AS wins, round(100.0 * count(*) FILTER (hit) / count(*), 4) AS actual_sr,
  round(100 / avg(p), 4) AS implied_sr, round(100.0 * count(*) FILTER (hit) / count(*) - 100 / avg(p), 4) AS edge
FROM b GROUP BY price_bin"""


def _bins_sql(price: str, bins, rest: str) -> str:
    return " ".join(f"WHEN {price} < {b} THEN '{label}'" for b, label in bins) + f" ELSE '{rest}'"


@racing_query("win_calibration", _CALIBRATION_SQL.format(bins=_bins_sql("win_bsp", WIN_BINS, "20.0+"), price="win_bsp", hit="win_flag"), date_from="1997-01-01", date_to="1999-12-31")
def win_calibration(r: Racing, date_from: str, date_to: str) -> DataFrame:
    """Strike rate against the price by price bin, cheapest first; implied is 100 over the mean price."""
    rows = r.runners.join(dated(r, date_from, date_to).select("race_id"), "race_id")
    return _calibration(rows, "win_bsp", F.col("win_flag"), buckets(F.col("win_bsp"), *WIN_BINS, rest="20.0+"))


@racing_query("place_calibration", _CALIBRATION_SQL.format(bins=_bins_sql("place_bsp", PLACE_BINS, "5.0+"), price="place_bsp", hit="pos_num <= 3"), date_from="1997-01-01", date_to="1999-12-31")
def place_calibration(r: Racing, date_from: str, date_to: str) -> DataFrame:
    """The same on the place market; placed is third or better."""
    rows = r.runners.join(dated(r, date_from, date_to).select("race_id"), "race_id")
    return _calibration(rows, "place_bsp", F.col("pos_num") <= 3, buckets(F.col("place_bsp"), *PLACE_BINS, rest="5.0+"))


@racing_query(
    "calibration_wb",
    """
WITH b AS (SELECT CASE WHEN 1 / win_bsp >= 1 THEN 11 ELSE CAST(floor(1 / win_bsp * 10) AS INT) + 1 END AS bucket, 1 / win_bsp AS q, win_flag FROM runners WHERE win_bsp > 1)
SELECT bucket, count(*) AS runners, round(100 * avg(q), 4) AS implied_pct, round(100.0 * count(*) FILTER (win_flag) / count(*), 4) AS actual_pct,
  round(100.0 * count(*) FILTER (win_flag) / count(*) - 100 * avg(q), 4) AS error_pct
FROM b GROUP BY bucket HAVING count(*) >= 10""",
)
def calibration_wb(r: Racing, n: int = 10, least: int = 10) -> DataFrame:
    """Calibration by equal-width buckets of implied probability, of at least ``least`` runners."""
    q = 1 / F.col("win_bsp")
    rows = r.runners.where(F.col("win_bsp") > 1).select(F.width_bucket(q, F.lit(0.0), F.lit(1.0), F.lit(n)).cast("int").alias("bucket"), q.alias("q"), "win_flag")
    sums = rows.groupBy("bucket").agg(F.count("*").alias("runners"), F.avg("q").alias("q"), count_where(F.col("win_flag")).alias("wins")).where(F.col("runners") >= least)
    actual = 100 * F.col("wins") / F.col("runners")
    return sums.select("bucket", "runners", F.round(100 * F.col("q"), 4).alias("implied_pct"), F.round(actual, 4).alias("actual_pct"), F.round(actual - 100 * F.col("q"), 4).alias("error_pct")).orderBy("bucket")


def starred(r: Racing, races: DataFrame) -> DataFrame:
    """Facts with course and horse names: the star join of market reports."""
    return r.runners.join(races, "race_id").join(r.courses, "course_id").join(r.horses, "horse_id")


def percent_move(to: str, start: str) -> Column:
    """100 * (to - start) / start, null where the start is 0."""
    return 100 * F.try_divide(F.col(to) - F.col(start), F.col(start))


_ORDER = ["race_id", "num", "horse_id", "win_bsp"]


@racing_query(
    "market_movers",
    """
SELECT race_id, race_date, course_name, race_name, horse_name, round(win_ppmax, 4) AS morning_price, round(win_bsp, 4) AS bsp, round(100 * (win_ppmax - win_bsp) / win_ppmax, 4) AS move_pct, win_flag, pos_num
FROM runners JOIN races USING (race_id) JOIN courses USING (course_id) JOIN horses USING (horse_id)
WHERE race_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' AND win_ppmax > 0 AND win_bsp > 0 AND win_ppmax <> win_bsp AND abs(win_ppmax - win_bsp) / win_ppmax >= 0.05 AND win_bsp < win_ppmax
ORDER BY round(abs(win_ppmax - win_bsp) / win_ppmax, 6) DESC, race_id, num, horse_id, win_bsp LIMIT 100""",
    date_from="1998-03-01",
    date_to="1998-03-31",
    min_move=5,
    kind="steamer",
)
def market_movers(r: Racing, date_from: str, date_to: str, min_move: float = 20, kind: str = "all", limit: int = 100) -> DataFrame:
    """Largest moves from the morning price; steamers shorten, drifters lengthen. Ties by race and runner."""
    size = F.abs(F.col("win_ppmax") - F.col("win_bsp")) / F.col("win_ppmax")
    r = MonthStore(r).between(r, date_from, date_to)
    rows = starred(r, r.races).where((F.col("win_ppmax") > 0) & (F.col("win_bsp") > 0) & (F.col("win_ppmax") != F.col("win_bsp")))
    rows = rows.where(size >= min_move / 100)
    if kind == "steamer":
        rows = rows.where("win_bsp < win_ppmax")
    elif kind == "drifter":
        rows = rows.where("win_bsp > win_ppmax")
    rows = rows.withColumn("size", F.round(size, 6)).orderBy(F.desc("size"), *_ORDER).limit(limit)
    return rows.select("race_id", "race_date", "course_name", "race_name", "horse_name", F.round("win_ppmax", 4).alias("morning_price"), F.round("win_bsp", 4).alias("bsp"), F.round(-percent_move("win_bsp", "win_ppmax"), 4).alias("move_pct"), "win_flag", "pos_num")


@racing_query(
    "market_movers_range",
    """
SELECT race_id, horse_name, round((win_ppmax - win_ppmin) / win_ppmin, 4) AS price_range, round(100 * (win_bsp - win_ppmin) / win_ppmin, 4) AS drift_pct, round(pre_vol, 2) AS volume
FROM runners JOIN races USING (race_id) JOIN horses USING (horse_id)
WHERE race_date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30' AND win_ppmin > 0 AND win_ppmax > win_ppmin AND pre_vol >= 1000000 AND (win_ppmax - win_ppmin) / win_ppmin >= 0.2
ORDER BY round((win_ppmax - win_ppmin) / win_ppmin, 6) DESC, race_id, num, horse_id, win_bsp LIMIT 100""",
    date_from="1998-03-01",
    date_to="1998-06-30",
)
def market_movers_range(r: Racing, date_from: str, date_to: str, least: float = 0.2, volume: float = 1_000_000, limit: int = 100) -> DataFrame:
    """Widest pre-off ranges among well traded runners, with the drift from the low to the off."""
    width = (F.col("win_ppmax") - F.col("win_ppmin")) / F.col("win_ppmin")
    r = MonthStore(r).between(r, date_from, date_to)
    rows = r.runners.join(r.races, "race_id").join(r.horses, "horse_id")
    rows = rows.where((F.col("win_ppmin") > 0) & (F.col("win_ppmax") > F.col("win_ppmin")) & (F.col("pre_vol") >= volume) & (width >= least))
    rows = rows.withColumn("w", F.round(width, 6)).orderBy(F.desc("w"), *_ORDER).limit(limit)
    return rows.select("race_id", "horse_name", F.round(width, 4).alias("price_range"), F.round(percent_move("win_bsp", "win_ppmin"), 4).alias("drift_pct"), F.round("pre_vol", 2).alias("volume"))


@racing_query(
    "inplay_moves",
    """
SELECT race_id, race_date, course_name, horse_name, round(win_bsp, 4) AS win_bsp, round(win_ipmin, 4) AS ip_low, round(win_ipmax, 4) AS ip_high, round(100 * (win_ipmin - win_bsp) / win_bsp, 4) AS surge_pct, round(100 * (win_ipmax - win_bsp) / win_bsp, 4) AS collapse_pct, win_flag, pos_num
FROM runners ru JOIN races USING (race_id) JOIN courses USING (course_id) JOIN horses USING (horse_id)
WHERE race_date BETWEEN DATE '1998-03-01' AND DATE '1998-04-30' AND ru.win_bsp > 0 AND (ru.win_ipmin > 0 OR ru.win_ipmax > 0) AND (abs(ru.win_ipmin - ru.win_bsp) / ru.win_bsp > 0.255 OR abs(ru.win_ipmax - ru.win_bsp) / ru.win_bsp > 0.255)
ORDER BY round(abs(ru.win_ipmax - ru.win_bsp) / ru.win_bsp, 6) DESC, race_id, num, horse_id, ru.win_bsp LIMIT 100""",
    date_from="1998-03-01",
    date_to="1998-04-30",
    min_move=25.5,
)
def inplay_moves(r: Racing, date_from: str, date_to: str, min_move: float = 20, limit: int = 100) -> DataFrame:
    """In-play lows and highs that left the starting price by more than ``min_move`` percent."""
    low, high = percent_move("win_ipmin", "win_bsp"), percent_move("win_ipmax", "win_bsp")
    r = MonthStore(r).between(r, date_from, date_to)
    rows = starred(r, r.races).where((F.col("win_bsp") > 0) & ((F.col("win_ipmin") > 0) | (F.col("win_ipmax") > 0)))
    rows = rows.where((F.abs(low) > min_move) | (F.abs(high) > min_move))
    rows = rows.withColumn("size", F.round(F.abs(F.col("win_ipmax") - F.col("win_bsp")) / F.col("win_bsp"), 6)).orderBy(F.desc_nulls_last("size"), *_ORDER).limit(limit)
    return rows.select("race_id", "race_date", "course_name", "horse_name", F.round("win_bsp", 4).alias("win_bsp"), F.round("win_ipmin", 4).alias("ip_low"), F.round("win_ipmax", 4).alias("ip_high"), F.round(low, 4).alias("surge_pct"), F.round(high, 4).alias("collapse_pct"), "win_flag", "pos_num")


@racing_query(
    "inplay_swing",
    """
SELECT race_id, horse_name, round(win_ipmax - win_ipmin, 4) AS swing, pos_num FROM runners JOIN races USING (race_id) JOIN horses USING (horse_id)
WHERE race_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND win_ipmax - win_ipmin >= 10
ORDER BY round(win_ipmax - win_ipmin, 6) DESC NULLS LAST, race_id, num, horse_id LIMIT 50""",
    date_from="1998-01-01",
    date_to="1998-12-31",
)
def inplay_swing(r: Racing, date_from: str, date_to: str, least: float = 10, limit: int = 50) -> DataFrame:
    """Widest in-play ranges."""
    r = MonthStore(r).between(r, date_from, date_to)
    rows = r.runners.join(r.races, "race_id").join(r.horses, "horse_id").withColumn("width", F.col("win_ipmax") - F.col("win_ipmin"))
    rows = rows.where(F.col("width") >= least).withColumn("w", F.round("width", 6)).orderBy(F.desc_nulls_last("w"), "race_id", "num", "horse_id").limit(limit)
    return rows.select("race_id", "horse_name", F.round("width", 4).alias("swing"), "pos_num")


@racing_query(
    "book_vs_exchange",
    """
SELECT race_date, count(DISTINCT race_id) AS races, round(avg(dec_price) FILTER (win_flag), 4) AS avg_sp_winner, round(avg(win_bsp) FILTER (win_flag), 4) AS avg_bsp_winner,
  round(sum((dec_price - 1) * CASE WHEN win_flag THEN 1 ELSE -1 END), 4) AS sp_pl, round(sum((win_bsp - 1) * win_lose) FILTER (win_bsp > 0), 4) AS bsp_pl
FROM runners JOIN races USING (race_id) WHERE race_date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND dec_price IS NOT NULL GROUP BY race_date""",
    date_from="1998-01-01",
    date_to="1998-06-30",
)
def book_vs_exchange(r: Racing, date_from: str, date_to: str) -> DataFrame:
    """Daily level-stakes results at book and exchange prices, as the reports define them: the book's
    losers lose the price less 1, the exchange's nothing."""
    rows = r.runners.where("dec_price is not null").join(dated(r, date_from, date_to).select("race_id", "race_date"), "race_id")
    won = F.col("win_flag")
    return rows.groupBy("race_date").agg(
        F.countDistinct("race_id").alias("races"),
        mean(F.when(won, F.col("dec_price"))).alias("avg_sp_winner"),
        mean(F.when(won, F.col("win_bsp"))).alias("avg_bsp_winner"),
        F.round(F.sum((F.col("dec_price") - 1) * F.when(won, 1).otherwise(-1)), 4).alias("sp_pl"),
        F.round(F.sum(F.when(F.col("win_bsp") > 0, (F.col("win_bsp") - 1) * F.col("win_lose"))), 4).alias("bsp_pl"),
    ).orderBy("race_date")
