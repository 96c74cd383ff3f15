"""Upserts by a policy for each column, replacements, deletions and key assignment, as whole-set joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railside.plans.racing import Racing
from railside.plans.scratch import scratch
from railside.registry import racing_query, table_query

#: new: the new value; fill: the new one unless null; old: the old one stays.
MODES = {"new": lambda o, n: n, "fill": lambda o, n: F.coalesce(n, o), "old": lambda o, n: o}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Rows of both by unique keys; where both have a key, each column follows its mode.

    Columns that ``policy`` does not name stay as they were. The result is for a new snapshot: nothing
    that is being read is overwritten.
    """
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("o"))
    n = new.select(*keys, F.struct(*values).alias("n"))
    both = o.join(n, keys, "full_outer")
    merged = [F.when(F.col("o").isNull(), F.col(f"n.{c}")).when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(MODES[policy.get(c, "old")](F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c in values]
    return both.select(*keys, *merged)


_OLD = "o AS (SELECT race_id AS k, going AS a, CAST(ran AS DOUBLE) AS b FROM races WHERE race_id % 5 <> 0)"
_NEW = "n AS (SELECT race_id AS k, CASE WHEN race_id % 3 <> 0 THEN surface END AS a, CASE WHEN race_id % 2 = 0 THEN dist_f END AS b FROM races WHERE race_id % 4 <> 0)"
_PICK = {"new": "n.{0}", "fill": "coalesce(n.{0}, o.{0})", "old": "o.{0}"}


def _frames(r: Racing) -> tuple[DataFrame, DataFrame]:
    old = r.races.where("race_id % 5 <> 0").select(F.col("race_id").alias("k"), F.col("going").alias("a"), F.col("ran").cast("double").alias("b"))
    new = r.races.where("race_id % 4 <> 0").select(F.col("race_id").alias("k"), F.when(F.col("race_id") % 3 != 0, F.col("surface")).alias("a"), F.when(F.col("race_id") % 2 == 0, F.col("dist_f")).alias("b"))
    return old, new


def _policy(name: str, a: str, b: str) -> None:
    cases = ", ".join(f"CASE WHEN o.k IS NULL THEN n.{c} WHEN n.k IS NULL THEN o.{c} ELSE {_PICK[m].format(c)} END AS {c}" for c, m in (("a", a), ("b", b)))
    sql = f"WITH {_OLD}, {_NEW} SELECT coalesce(o.k, n.k) AS k, {cases} FROM o FULL JOIN n ON o.k = n.k"
    racing_query(name, sql)(lambda r: upsert(*_frames(r), ["k"], {"a": a, "b": b}))


_policy("up_overwrite", "new", "new")
_policy("up_coalesce", "fill", "fill")
_policy("up_mixed", "new", "fill")
_policy("up_backfill", "fill", "old")
_policy("up_preserve_price", "new", "old")
_policy("up_ignore", "old", "old")


@racing_query("up_dims", "SELECT p_partkey AS id, concat(p_name, ' ', p_partkey) AS name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT (SELECT max(p_partkey) FROM part WHERE p_partkey % 2 = 0) + row_number() OVER (ORDER BY concat(p_name, ' ', p_partkey)), concat(p_name, ' ', p_partkey) FROM part WHERE p_partkey % 2 = 1")
def new_dimension_rows(r: Racing) -> DataFrame:
    """Known names keep their ids; new ones get the next, in order of name."""
    known = r.horses.where("horse_id % 2 = 0").select(F.col("horse_id").alias("id"), F.col("horse_name").alias("name"))
    return known.unionByName(new_ids(known, r.horses.select(F.col("horse_name").alias("name"))))


def new_ids(known: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of the names that ``known`` lacks: the numbers behind its largest id, in order of name.

    Numbers come from counts by range partition, so no single task ranks all new names.
    """
    spark = names.sparkSession
    path = scratch(spark, "names")
    # written, so that both readers see each name in the same part
    unknown = names.select("name").distinct().join(known.select("name"), "name", "left_anti")
    unknown.repartitionByRange("name").select("name", F.spark_partition_id().alias("p")).write.parquet(path)
    parts = spark.read.parquet(path)
    ranked = parts.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("name")))
    counts = ranked.groupBy("p").agg(F.max("i").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("p", "before")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return ranked.join(F.broadcast(before), "p").join(F.broadcast(top)).select((F.col("top") + F.col("before") + F.col("i")).alias("id"), "name")


@racing_query("up_courses", "SELECT course_id, course_name, CASE WHEN course_id % 3 = 0 THEN 9 ELSE region_id END AS region_id FROM courses")
def update_regions(r: Racing) -> DataFrame:
    new = r.courses.where("course_id % 3 = 0").withColumn("region_id", F.lit(9))
    return upsert(r.courses, new, ["course_id"], {"region_id": "new"})


@racing_query("up_row_loader", "SELECT race_id, CASE WHEN ran > 0 AND dist_f > 6 THEN 'loaded' ELSE 'quarantine' END AS state FROM races WHERE race_id % 2 = 1")
def load_new_rows(r: Racing) -> DataFrame:
    """Rows whose key is unknown: sound ones are loaded, others go to quarantine."""
    new = r.races.join(r.races.where("race_id % 2 = 0").select("race_id"), "race_id", "left_anti")
    return new.select("race_id", F.when((F.col("ran") > 0) & (F.col("dist_f") > 6), "loaded").otherwise("quarantine").alias("state"))


def replace_days(rows: DataFrame, path: str, day: str = "race_date") -> None:
    """Write rows to a table by day: the days that they hold are replaced as a whole, others stay as they are.

    The files of other days are not touched. The new days' files come in when all of them are
    written: a write that fails leaves the old days. A day without new rows is not replaced.
    """
    rows.hint("rebalance", F.col(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


@table_query(
    "replace_date",
    "SELECT event_id, day, CASE WHEN came THEN 'new' ELSE 'old' END AS src FROM (SELECT event_id, CAST(ts AS DATE) AS day, dayofmonth(ts) % 5 = 0 AND bool_or(event_id % 2 = 0) OVER (PARTITION BY CAST(ts AS DATE)) AS came FROM events) WHERE NOT (came AND event_id % 2 = 1)",
)
def replaced_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by day; then every fifth day comes again, with its even events only."""
    path = scratch(spark, "events_by_day")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.lit("old").alias("src"), F.to_date("ts").alias("day"))
    replace_days(events, path, "day")
    replace_days(events.where("dayofmonth(day) % 5 = 0 and event_id % 2 = 0").withColumn("src", F.lit("new")), path, "day")
    return spark.read.schema("event_id long, src string, day date").parquet(path).select("event_id", "day", "src")


@racing_query("update_from", "SELECT race_id, coalesce(m.to_id, course_id) AS course_id FROM races LEFT JOIN (VALUES (1, 2), (3, 4)) m(from_id, to_id) ON course_id = from_id")
def remap(r: Racing) -> DataFrame:
    m = r.races.sparkSession.createDataFrame([(1, 2), (3, 4)], "from_id int, to_id int")
    return r.races.join(F.broadcast(m), F.col("course_id") == F.col("from_id"), "left").select("race_id", F.coalesce("to_id", "course_id").alias("course_id"))


@racing_query("delete_where", "SELECT race_id, num, horse_id FROM runners WHERE NOT (pos_raw IS NULL AND race_id IN (SELECT race_id FROM races WHERE race_date < DATE '1998-01-01'))")
def delete_old_entries(r: Racing) -> DataFrame:
    """What remains once entries of old races without a result are deleted."""
    old = r.races.where("race_date < DATE '1998-01-01'").select("race_id", F.lit(True).alias("old"))
    rows = r.runners.join(old, "race_id", "left")
    return rows.where(~(F.col("pos_raw").isNull() & F.coalesce("old", F.lit(False)))).select("race_id", "num", "horse_id")


@racing_query("price_stamp", "SELECT race_id, num, horse_id, CASE WHEN dec_price IS NOT NULL THEN TIMESTAMP '2001-06-01 12:00:00' END AS price_updated_at FROM runners", at="2001-06-01 12:00:00")
def stamp(r: Racing, at: str) -> DataFrame:
    return r.runners.select("race_id", "num", "horse_id", F.when(F.col("dec_price").isNotNull(), F.lit(at).cast("timestamp")).alias("price_updated_at"))
