"""Sorting, paging, set operations and query shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railside.operators.mutations import new_ids
from railside.plans.racing import Racing
from railside.registry import racing_query


@racing_query("top_k", "SELECT race_id, prize_fund FROM races ORDER BY prize_fund DESC, race_id LIMIT 20", n=20)
def top_k(r: Racing, n: int) -> DataFrame:
    return r.races.select("race_id", "prize_fund").orderBy(F.desc("prize_fund"), "race_id").limit(n)


@racing_query("nulls_last", "SELECT race_id, num, horse_id, pos_num FROM runners ORDER BY pos_num DESC NULLS LAST, race_id, num, horse_id")
def nulls_last(r: Racing) -> DataFrame:
    return r.runners.select("race_id", "num", "horse_id", "pos_num").orderBy(F.desc_nulls_last("pos_num"), "race_id", "num", "horse_id")


@racing_query("paginate", "SELECT race_id, race_date FROM races ORDER BY race_date DESC, race_id LIMIT 25 OFFSET 50", limit=25, offset=50)
def paginate(r: Racing, limit: int, offset: int) -> DataFrame:
    return r.races.select("race_id", "race_date").orderBy(F.desc("race_date"), "race_id").offset(offset).limit(limit)


@racing_query("order_by_agg", "SELECT going, round(min(dist_f), 4) AS shortest FROM races GROUP BY going ORDER BY min(dist_f)")
def order_by_aggregate(r: Racing) -> DataFrame:
    return r.races.groupBy("going").agg(F.round(F.min("dist_f"), 4).alias("shortest")).orderBy("shortest")


@racing_query("union_all", "SELECT 'races' AS what, count(*) AS n FROM races UNION ALL SELECT 'runners', count(*) FROM runners UNION ALL SELECT 'winners', count(*) FROM runners WHERE win_flag")
def union_all(r: Racing) -> DataFrame:
    parts = [("races", r.races), ("runners", r.runners), ("winners", r.runners.where("win_flag"))]
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@racing_query(
    "insert_or_get",
    """
WITH known AS (SELECT trainer_id AS id, trainer_name AS name FROM trainers WHERE trainer_id % 3 <> 0),
new AS (SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY trainer_name) AS id, trainer_name AS name FROM (SELECT DISTINCT trainer_name FROM trainers WHERE trainer_name NOT IN (SELECT name FROM known)))
SELECT DISTINCT trainer_name AS name, id FROM runners JOIN trainers USING (trainer_id) JOIN (SELECT * FROM known UNION ALL SELECT * FROM new) k ON k.name = trainer_name""",
)
def insert_or_get(r: Racing) -> DataFrame:
    """The ids of the names that a load brings: those of known names are got, others are inserted under the next ids."""
    dimension = r.trainers.where("trainer_id % 3 <> 0").select(F.col("trainer_id").alias("id"), F.col("trainer_name").alias("name"))
    load = r.runners.select("trainer_id").distinct().join(r.trainers, "trainer_id").select(F.col("trainer_name").alias("name"))
    every = dimension.unionByName(new_ids(dimension, r.trainers.select(F.col("trainer_name").alias("name"))))
    return load.distinct().join(every, "name").select("name", "id")


@racing_query("distinct", "SELECT DISTINCT trainer_id, surface FROM runners JOIN races USING (race_id)")
def distinct(r: Racing) -> DataFrame:
    return r.runners.join(r.races, "race_id").select("trainer_id", "surface").distinct()


@racing_query("set_diff", "SELECT horse_id FROM runners WHERE num = 1 EXCEPT SELECT horse_id FROM runners WHERE num = 7")
def set_difference(r: Racing) -> DataFrame:
    return r.runners.where("num = 1").select("horse_id").distinct().join(r.runners.where("num = 7").select("horse_id"), "horse_id", "left_anti")


@racing_query("set_intersect", "SELECT horse_id FROM runners WHERE num = 1 INTERSECT SELECT horse_id FROM runners WHERE num = 7")
def set_intersection(r: Racing) -> DataFrame:
    return r.runners.where("num = 1").select("horse_id").intersect(r.runners.where("num = 7").select("horse_id"))


@racing_query("group_ordinals", "SELECT race_type, surface, going, count(*) AS n FROM races GROUP BY 1, 2, 3")
def group_ordinals(r: Racing) -> DataFrame:
    return r.races.groupBy("race_type", "surface", "going").agg(F.count("*").alias("n"))


@racing_query("cte_chain", "WITH b AS (SELECT race_id, horse_id, win_bsp, win_flag FROM runners WHERE pos_num <= 3), f AS (SELECT b.*, race_type FROM b JOIN races USING (race_id) WHERE surface = 'AW'), p AS (SELECT *, CASE WHEN win_bsp >= 1.01 THEN win_bsp END AS price FROM f) SELECT race_type, count(*) AS n, round(avg(price), 4) AS mean FROM p GROUP BY race_type")
def chained(r: Racing) -> DataFrame:
    """base -> filtered -> priced -> summed: one plan, whatever the steps."""
    base = r.runners.where("pos_num <= 3").select("race_id", "horse_id", "win_bsp", "win_flag")
    filtered = base.join(r.races.where("surface = 'AW'").select("race_id", "race_type"), "race_id")
    priced = filtered.withColumn("price", F.when(F.col("win_bsp") >= 1.01, F.col("win_bsp")))
    return priced.groupBy("race_type").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean"))


@racing_query("values_table", "SELECT m.new_id, count(*) AS races FROM races JOIN (VALUES (1, 101), (2, 102), (3, 103)) AS m(old_id, new_id) ON course_id = old_id GROUP BY 1")
def values_table(r: Racing) -> DataFrame:
    """An inline mapping of ids."""
    m = r.races.sparkSession.createDataFrame([(1, 101), (2, 102), (3, 103)], "old_id int, new_id int")
    return r.races.join(F.broadcast(m), F.col("course_id") == F.col("old_id")).groupBy("new_id").agg(F.count("*").alias("races"))
