"""Window operators: lags, ranks, samples, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railside.registry import table_query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a horse: a customer's orders in time, ties by key."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("race_id"), F.col("o_custkey").alias("horse_id"), F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 7 + F.col("o_orderkey") % 3).alias("trainer_id"), F.col("o_totalprice").alias("price"))


_RUNS = "WITH r AS (SELECT o_orderkey AS race_id, o_custkey AS horse_id, CAST(o_orderdate AS DATE) AS d, o_custkey % 7 + o_orderkey % 3 AS trainer_id, o_totalprice AS price FROM orders) "
_W = "(PARTITION BY horse_id ORDER BY d, race_id)"

def _by_horse():
    return Window.partitionBy("horse_id").orderBy("d", "race_id")


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last by ``order``. A partial maximum, so that no key's rows are sorted in a task."""
    rest = [c for c in df.columns if c not in keys]
    first = list(order) + [c for c in rest if c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*first)).alias("_m")).select(*keys, *[F.col("_m")[c].alias(c) for c in rest])


@table_query("w_lag_dsr", _RUNS + f"SELECT race_id, CAST(date_diff('day', lag(d) OVER {_W}, d) AS INT) AS dsr FROM r")
def lag_dsr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the horse's run before, of every run."""
    return _orders(spark, sf_dir).select("race_id", F.datediff("d", F.lag("d").over(_by_horse())).alias("dsr"))


@table_query("w_lag_recency", _RUNS + f"SELECT race_id, CAST(date_diff('day', lag(d) OVER {_W}, d) AS INT) AS dsr FROM r WHERE d >= DATE '1999-01-01'")
def lag_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all horses, runs before the date range unseen."""
    rows = _orders(spark, sf_dir).where("d >= DATE '1999-01-01'")
    return rows.select("race_id", F.datediff("d", F.lag("d").over(_by_horse())).alias("dsr"))


@table_query("w_lag_trainer", _RUNS + f"SELECT race_id, horse_id, old_id, trainer_id FROM (SELECT *, lag(trainer_id) OVER {_W} AS old_id FROM r) WHERE old_id <> trainer_id")
def lag_trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs under another trainer than the run before."""
    return _orders(spark, sf_dir).withColumn("old_id", F.lag("trainer_id").over(_by_horse())).where("old_id <> trainer_id").select("race_id", "horse_id", "old_id", "trainer_id")


@table_query("w_row_number_last", _RUNS + "SELECT horse_id, race_id, d FROM (SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY d DESC, race_id DESC) AS rn FROM r) WHERE rn = 1")
def last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_orders(spark, sf_dir).select("horse_id", "d", "race_id"), ["horse_id"], "d", "race_id")


@table_query("w_row_number_first", _RUNS + "SELECT horse_id, trainer_id, race_id FROM (SELECT *, row_number() OVER (PARTITION BY horse_id, trainer_id ORDER BY d, race_id) AS rn FROM r) WHERE rn = 1")
def first_for_trainer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).groupBy("horse_id", "trainer_id").agg(F.min(F.struct("d", "race_id")).alias("m"))
    return rows.select("horse_id", "trainer_id", "m.race_id")


@table_query("w_dedupe", "SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per key: the dearest."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return latest(lines, ["l_orderkey", "l_linenumber"], "price")


@table_query("w_count_over", _RUNS + "SELECT race_id, count(*) OVER (PARTITION BY d) AS n FROM r")
def count_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its day's rows: counted once map-side and joined, as no day is bounded."""
    rows = _orders(spark, sf_dir)
    return rows.join(rows.groupBy("d").agg(F.count("*").alias("n")), "d").select("race_id", "n")


@table_query("w_random_sample", _RUNS + "SELECT month, race_id FROM (SELECT strftime(d, '%Y-%m') AS month, race_id, row_number() OVER (PARTITION BY strftime(d, '%Y-%m') ORDER BY md5(concat('7|', race_id)), race_id) AS rn FROM r) WHERE rn <= 3")
def random_sample(spark: SparkSession, sf_dir: str, n: int = 3, seed: int = 7) -> DataFrame:
    """n rows of each month in the order of a seeded hash: the same in every run."""
    rows = _orders(spark, sf_dir).select(F.date_format("d", "yyyy-MM").alias("month"), "race_id", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("race_id").cast("string"))).alias("h"))
    w = Window.partitionBy("month").orderBy("h", "race_id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("month", "race_id")


@table_query("w_rank_market", "SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice, 2) AS price, CAST(rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS INT) AS rnk FROM lineitem")
def rank_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), F.rank().over(w).alias("rnk"))


@table_query("w_ntile", _RUNS + "SELECT race_id, CAST(ntile(4) OVER (PARTITION BY horse_id ORDER BY price, race_id) AS INT) AS quarter FROM r")
def ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("race_id", F.ntile(4).over(Window.partitionBy("horse_id").orderBy("price", "race_id")).alias("quarter"))


@table_query("w_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, ts, value FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest tick of each runner."""
    return latest(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id")
