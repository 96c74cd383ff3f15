"""The ledger of updates, and audits of the warehouse against files and within a month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.functions.columns import count_where
from railside.plans.racing import Racing
from railside.registry import racing_query, table_query

_LEDGER = [
    "o_orderkey AS update_id",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'historical' ELSE 'daily' END AS update_type",
    "CAST(o_orderdate AS DATE) AS update_date",
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'running' END AS status",
    "CAST(o_orderdate AS DATE) AS completed_on",
    "o_custkey AS races_loaded",
    "o_custkey * 9 AS runners_loaded",
]
_LEDGER_SQL = f"(SELECT {', '.join(_LEDGER)} FROM orders)"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_LEDGER)


def daily_status(ledger: DataFrame) -> DataFrame:
    """By day of the daily updates: the last that was completed, the most it loaded, failures."""

    def done(column: str) -> Column:
        return F.max(F.when(F.col("status") == "completed", F.col(column)))

    days = ledger.where("update_type = 'daily'").groupBy("update_date")
    return days.agg(done("update_id").alias("latest_successful_id"), done("completed_on").alias("last_updated"), count_where(F.col("status") == "failed").alias("failure_count"), done("races_loaded").alias("races_loaded"), done("runners_loaded").alias("runners_loaded"))


def latest_updates(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The n latest daily updates; of one day, the larger id is the later."""
    return ledger.where("update_type = 'daily'").orderBy(F.desc("update_date"), F.desc("update_id")).limit(n).drop("update_type")


_DONE = "max({0}) FILTER (status = 'completed') AS {1}"


@table_query("update_status", f"SELECT update_date, {_DONE.format('update_id', 'latest_successful_id')}, {_DONE.format('completed_on', 'last_updated')}, count(*) FILTER (status = 'failed') AS failure_count, {_DONE.format('races_loaded', 'races_loaded')}, {_DONE.format('runners_loaded', 'runners_loaded')} FROM {_LEDGER_SQL} WHERE update_type = 'daily' GROUP BY 1")
def update_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_status(_ledger(spark, sf_dir))


@table_query("admin_status", f"SELECT * EXCLUDE (update_type) FROM {_LEDGER_SQL} WHERE update_type = 'daily' ORDER BY update_date DESC, update_id DESC LIMIT 10")
def admin_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_updates(_ledger(spark, sf_dir))


def unresolved_names(rows: DataFrame, first: str, last: str) -> DataFrame:
    """Runners with a result that lack an id: kind (the first that is missing), name, race and count.

    ``rows`` has race_id, race_date, pos_num and an id and a name of horse, trainer and jockey. Empty
    names say nothing and are left out.
    """
    kind, name = F, F
    for k in ("horse", "trainer", "jockey"):
        gone = F.col(f"{k}_id").isNull()
        kind, name = kind.when(gone, k), name.when(gone, F.col(f"{k}_name"))
    rows = rows.where(F.col("race_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("pos_num").isNotNull())
    return rows.select(kind.alias("kind"), name.alias("name"), "race_id").where("kind is not null and name <> ''").groupBy("kind", "name", "race_id").agg(F.count("*").alias("occurrences"))


_BLANKED = [x for k, n in (("horse", 9), ("trainer", 5), ("jockey", 7)) for x in (f"CASE WHEN {k}_id % {n} <> 0 THEN {k}_id END AS {k}_id", f"concat('{k} ', {k}_id) AS {k}_name")]


@racing_query("verify_unresolved", f"SELECT kind, name, race_id, count(*) AS occurrences FROM (SELECT CASE WHEN horse_id IS NULL THEN 'horse' WHEN trainer_id IS NULL THEN 'trainer' ELSE 'jockey' END AS kind, CASE WHEN horse_id IS NULL THEN horse_name WHEN trainer_id IS NULL THEN trainer_name ELSE jockey_name END AS name, race_id FROM (SELECT race_id, race_date, pos_num, {', '.join(_BLANKED)} FROM runners JOIN races USING (race_id)) WHERE (horse_id IS NULL OR trainer_id IS NULL OR jockey_id IS NULL) AND pos_num IS NOT NULL AND race_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30') GROUP BY 1, 2, 3", first="1999-01-01", last="1999-06-30")
def unresolved_dimensions(r: Racing, first: str, last: str) -> DataFrame:
    return unresolved_names(r.base.selectExpr("race_id", "race_date", "pos_num", *_BLANKED), first, last)


def completeness(races: DataFrame, runners: DataFrame, file_races: DataFrame, file_runners: DataFrame, since: str) -> DataFrame:
    """The warehouse against its files, one row per check: check, value, passed.

    Duplicate keys of races and runners; months since a day that hold races; horses with three runs or
    more since then whose files tell of two runs more or less; totals within 1,000 and 10,000 rows.
    Every horse is compared, none sampled.
    """

    def one(name: str, rows: DataFrame, value: Column, passed) -> DataFrame:
        return rows.agg(value.cast("long").alias("value")).select(F.lit(name).alias("check"), "value", passed(F.col("value")).alias("passed"))

    def doubles(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

    def runs(rows: DataFrame, days: DataFrame, name: str) -> DataFrame:
        return rows.join(days.where(F.col("race_date") >= F.lit(since).cast("date")).select("race_id"), "race_id").groupBy("horse_id").agg(F.count("*").alias(name))

    def apart(a: DataFrame, b: DataFrame) -> tuple[DataFrame, Column]:
        both = a.select(F.lit(1).alias("side")).union(b.select(F.lit(-1).alias("side")))
        return both, F.abs(F.coalesce(F.sum("side"), F.lit(0)))

    horses = runs(runners, races, "here").where("here >= 3").join(runs(file_runners, file_races, "there"), "horse_id", "left")
    checks = [
        one("duplicate races", doubles(races, "race_date", "course_id", "off_min"), F.count("*"), lambda v: v == 0),
        one("duplicate runners", doubles(runners, "race_id", "num"), F.count("*"), lambda v: v == 0),
        one("months", races.where(F.col("race_date") >= F.lit(since).cast("date")), F.countDistinct(F.trunc("race_date", "month")), lambda v: v > 0),
        one("horses apart", horses.where(F.abs(F.col("here") - F.coalesce("there", F.lit(0))) > 1), F.count("*"), lambda v: v == 0),
        one("races apart", *apart(races, file_races), lambda v: v <= 1000),
        one("runners apart", *apart(runners, file_runners), lambda v: v <= 10000),
    ]
    return reduce(DataFrame.unionByName, checks)


_FILES = "f AS (SELECT * FROM runners WHERE horse_id % 3 <> 0 OR num < 4), fr AS (SELECT * FROM races WHERE race_id % 90 <> 0), a AS (SELECT horse_id, count(*) AS here FROM runners JOIN races USING (race_id) WHERE race_date >= DATE '2000-01-01' GROUP BY 1), b AS (SELECT horse_id, count(*) AS there FROM f JOIN fr USING (race_id) WHERE race_date >= DATE '2000-01-01' GROUP BY 1)"


@racing_query("completeness_py", f"WITH {_FILES} SELECT 'duplicate races' AS check, count(*) AS value, count(*) = 0 AS passed FROM (SELECT 1 FROM races GROUP BY race_date, course_id, off_min HAVING count(*) > 1) UNION ALL SELECT 'duplicate runners', count(*), count(*) = 0 FROM (SELECT 1 FROM runners GROUP BY race_id, num HAVING count(*) > 1) UNION ALL SELECT 'months', count(DISTINCT date_trunc('month', race_date)), count(*) > 0 FROM races WHERE race_date >= DATE '2000-01-01' UNION ALL SELECT 'horses apart', count(*), count(*) = 0 FROM a LEFT JOIN b USING (horse_id) WHERE here >= 3 AND abs(here - coalesce(there, 0)) > 1 UNION ALL SELECT 'races apart', v, v <= 1000 FROM (SELECT abs((SELECT count(*) FROM races) - (SELECT count(*) FROM fr)) AS v) UNION ALL SELECT 'runners apart', v, v <= 10000 FROM (SELECT abs((SELECT count(*) FROM runners) - (SELECT count(*) FROM f)) AS v)".replace(" AS check", ' AS "check"'), since="2000-01-01")
def warehouse_and_files(r: Racing, since: str) -> DataFrame:
    """Files that lack some races and some runners."""
    return completeness(r.races, r.runners, r.races.where("race_id % 90 <> 0"), r.runners.where("horse_id % 3 <> 0 or num < 4"), since)


def month_report(races: DataFrame, runners: DataFrame) -> DataFrame:
    """One row on a month's races (race_id, ran) and runners (race_id, num, prices).

    Runners are summed by race before the full join, so that each race is one row on either side. A
    race without a declared number is no mismatch.
    """
    prices = F.coalesce("win_bsp", "win_ppwap", "place_bsp")
    # one aggregation by key gives rows, distinct keys and rows without prices
    keys = runners.groupBy("race_id", "num").agg(F.count("*").alias("n"), count_where(prices.isNull()).alias("bare"))
    sides = keys.groupBy("race_id").agg(F.sum("n").alias("n"), F.count("*").alias("distinct"), F.sum("bare").alias("bare")).withColumn("ridden", F.lit(True))
    both = races.groupBy("race_id").agg(F.count("*").alias("races"), F.max("ran").alias("ran")).join(sides, "race_id", "full_outer")

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    return both.agg(
        total(F.col("races")).alias("total_races"),
        total(F.col("n")).alias("total_runners"),
        count_where(F.col("ridden").isNull()).alias("races_without_runners"),
        count_where(F.col("races").isNull()).alias("runners_without_race"),
        count_where(F.col("ran") != F.coalesce("n", F.lit(0))).alias("ran_mismatches"),
        total(F.col("n") - F.col("distinct")).alias("duplicate_runners"),
        total(F.col("bare")).alias("without_prices"),
    )


_MONTH_SQL = """WITH m AS (SELECT * FROM races WHERE race_date BETWEEN DATE '1999-05-01' AND DATE '1999-05-31'),
 a AS (SELECT race_id, ran FROM m WHERE race_id % 20 <> 0),
 b AS (SELECT race_id, num, race_id % 7 = 0 AS bare FROM runners JOIN m USING (race_id) WHERE race_id % 30 <> 1)
 SELECT (SELECT count(*) FROM a) AS total_races, (SELECT count(*) FROM b) AS total_runners,
 (SELECT count(*) FROM a WHERE race_id NOT IN (SELECT race_id FROM b)) AS races_without_runners,
 (SELECT count(DISTINCT race_id) FROM b WHERE race_id NOT IN (SELECT race_id FROM a)) AS runners_without_race,
 (SELECT count(*) FROM a WHERE ran <> (SELECT count(*) FROM b WHERE b.race_id = a.race_id)) AS ran_mismatches,
 (SELECT count(*) - count(DISTINCT (race_id, num)) FROM b) AS duplicate_runners,
 (SELECT count(*) FROM b WHERE bare) AS without_prices"""


@racing_query("validate_month", _MONTH_SQL, first="1999-05-01", last="1999-05-31")
def validate_month(r: Racing, first: str, last: str) -> DataFrame:
    """A month whose files lack some races on one side and some on the other."""
    month = r.races.where(F.col("race_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    own = r.runners.join(month.where("race_id % 30 <> 1").select("race_id"), "race_id")
    blank = [F.when(F.col("race_id") % 7 != 0, F.col(c)).alias(c) for c in ("win_bsp", "win_ppwap", "place_bsp")]
    return month_report(month.where("race_id % 20 <> 0").select("race_id", "ran"), own.select("race_id", "num", *blank))
