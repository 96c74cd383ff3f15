"""Horse, trainer and jockey profiles: careers, splits, rolling form, combinations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railside.functions.columns import buckets, count_where, mean, rate
from railside.plans.racing import Racing
from railside.registry import racing_query

DISTANCES = ((7, "5-6f"), (9, "7-8f"), (13, "9-12f"))
_DIST_SQL = "CASE WHEN dist_f < 7 THEN '5-6f' WHEN dist_f < 9 THEN '7-8f' WHEN dist_f < 13 THEN '9-12f' ELSE '13f+' END"
_RUNS_SQL = "count(*) AS runs, count(*) FILTER (win_flag) AS wins, {places} AS places, round(100.0 * count(*) FILTER (win_flag) / count(*), 4) AS sr"
_HORSE_SPLIT = _RUNS_SQL.format(places="count(*) FILTER (pos_num <= 3)") + ", round(avg(rpr), 4) AS avg_rpr"
_SPLIT = _RUNS_SQL.format(places="CAST(0 AS BIGINT)")


def distance_bucket() -> Column:
    return buckets(F.col("dist_f"), *DISTANCES, rest="13f+")


def split(rows: DataFrame, category: Column, least: int = 1, limit: int | None = None, rated: bool = False, by_size: bool = False) -> DataFrame:
    """Results by category: those with ``least`` runs, best strike rate (or most runs) first."""
    won = count_where(F.col("win_flag"))
    places = count_where(F.col("pos_num") <= 3) if rated else F.min(F.lit(0).cast("long"))
    aggregates = [F.count("*").alias("runs"), won.alias("wins"), places.alias("places"), rate(won, F.count("*")).alias("sr")]
    if rated:
        aggregates.append(mean("rpr").alias("avg_rpr"))
    out = rows.groupBy(category.alias("category")).agg(*aggregates).where(F.col("runs") >= least)
    out = out.orderBy(F.desc("runs" if by_size else "sr"), "category")
    return out.limit(limit) if limit else out


def career(rows: DataFrame, prize: bool) -> DataFrame:
    """One row of career totals; horses have no prize total in this report."""
    total = F.round(F.sum("prize"), 4) if prize else F.lit(0).cast("long")
    out = rows.agg(F.count("*").alias("runs"), count_where(F.col("win_flag")).alias("wins"), count_where(F.col("pos_num") <= 3).alias("places"), F.round(F.sum("prize"), 4).alias("total_prize"), mean("rpr").alias("avg_rpr"), F.max("rpr").alias("peak_rpr"), mean("official").alias("avg_or"), F.max("official").alias("peak_or"))
    return out if prize else out.withColumn("total_prize", total)


_CAREER = "SELECT count(*) AS runs, count(*) FILTER (win_flag) AS wins, count(*) FILTER (pos_num <= 3) AS places, {prize} AS total_prize, round(avg(rpr), 4) AS avg_rpr, max(rpr) AS peak_rpr, round(avg(official), 4) AS avg_or, max(official) AS peak_or FROM runners WHERE {who}"


@racing_query("career_summary", _CAREER.format(prize="CAST(0 AS BIGINT)", who="horse_id = 100"), horse_id=100)
def career_summary(r: Racing, horse_id: int) -> DataFrame:
    return career(r.runners.where(F.col("horse_id") == horse_id), prize=False)


@racing_query("jockey_career", _CAREER.format(prize="round(sum(prize), 4)", who="jockey_id = 42"), jockey_id=42)
def jockey_career(r: Racing, jockey_id: int) -> DataFrame:
    return career(r.runners.where(F.col("jockey_id") == jockey_id), prize=True)


@racing_query("going_splits", f"SELECT going AS category, {_HORSE_SPLIT} FROM runners JOIN races USING (race_id) WHERE horse_id = 100 AND going IS NOT NULL GROUP BY going HAVING count(*) >= 2", horse_id=100)
def going_splits(r: Racing, horse_id: int) -> DataFrame:
    return split(r.base.where((F.col("horse_id") == horse_id) & F.col("going").isNotNull()), F.col("going"), least=2, rated=True, by_size=True)


@racing_query("distance_splits", f"SELECT {_DIST_SQL} AS category, {_HORSE_SPLIT} FROM runners JOIN races USING (race_id) WHERE horse_id = 100 AND dist_f IS NOT NULL GROUP BY 1", horse_id=100)
def distance_splits(r: Racing, horse_id: int) -> DataFrame:
    """By distance bucket, shortest first."""
    rows = r.base.where((F.col("horse_id") == horse_id) & F.col("dist_f").isNotNull())
    won = count_where(F.col("win_flag"))
    out = rows.groupBy(distance_bucket().alias("category")).agg(F.count("*").alias("runs"), won.alias("wins"), count_where(F.col("pos_num") <= 3).alias("places"), rate(won, F.count("*")).alias("sr"), mean("rpr").alias("avg_rpr"), F.min("dist_f").alias("low"))
    return out.orderBy("low").drop("low")


@racing_query("course_splits", f"SELECT course_name AS category, {_HORSE_SPLIT} FROM runners JOIN races USING (race_id) JOIN courses USING (course_id) WHERE horse_id = 100 GROUP BY 1 HAVING count(*) >= 2", horse_id=100)
def course_splits(r: Racing, horse_id: int) -> DataFrame:
    return split(r.base.where(F.col("horse_id") == horse_id).join(r.courses, "course_id"), F.col("course_name"), least=2, rated=True)


@racing_query("trainer_course_splits", f"SELECT course_name AS category, {_SPLIT} FROM runners JOIN races USING (race_id) JOIN courses USING (course_id) WHERE trainer_id = 7 GROUP BY 1 HAVING count(*) >= 10 ORDER BY sr DESC, category LIMIT 20", trainer_id=7)
def trainer_course_splits(r: Racing, trainer_id: int) -> DataFrame:
    return split(r.base.where(F.col("trainer_id") == trainer_id).join(r.courses, "course_id"), F.col("course_name"), least=10, limit=20)


@racing_query("jockey_course_splits", f"SELECT course_name AS category, {_SPLIT} FROM runners JOIN races USING (race_id) JOIN courses USING (course_id) WHERE jockey_id = 42 GROUP BY 1 HAVING count(*) >= 10 ORDER BY sr DESC, category LIMIT 20", jockey_id=42)
def jockey_course_splits(r: Racing, jockey_id: int) -> DataFrame:
    return split(r.base.where(F.col("jockey_id") == jockey_id).join(r.courses, "course_id"), F.col("course_name"), least=10, limit=20)


@racing_query("type_splits", f"SELECT race_type AS category, {_SPLIT} FROM runners JOIN races USING (race_id) WHERE trainer_id = 7 GROUP BY 1", trainer_id=7)
def type_splits(r: Racing, trainer_id: int) -> DataFrame:
    return split(r.base.where(F.col("trainer_id") == trainer_id), F.col("race_type"), by_size=True)


@racing_query("trainer_dist_splits", f"SELECT {_DIST_SQL} AS category, {_SPLIT} FROM runners JOIN races USING (race_id) WHERE trainer_id = 7 AND dist_f IS NOT NULL GROUP BY 1", trainer_id=7)
def trainer_dist_splits(r: Racing, trainer_id: int) -> DataFrame:
    return split(r.base.where((F.col("trainer_id") == trainer_id) & F.col("dist_f").isNotNull()), distance_bucket())


PERIODS = (14, 30, 90)


def rolling(rows: DataFrame, as_of: str, periods: tuple[int, ...] = PERIODS, priced: bool = True) -> DataFrame:
    """Results of the last 14, 30 and 90 days, a row each even without runs, in one pass.

    Each run is counted under every period that holds it, and a frame of the periods keeps the empty
    ones. A winner gains the exchange price less 1, a loser nothing: the report's definition.
    """
    day = date.fromisoformat(as_of)
    age = F.datediff(F.lit(day), "race_date")
    rows = rows.where(age <= max(periods))
    gain = F.when(F.col("win_bsp") > 0, (F.col("win_bsp") - 1) * F.col("win_lose")).otherwise(0.0)
    each = rows.select(F.explode(F.filter(F.array(*map(F.lit, periods)), lambda p: age <= p)).alias("days"), "win_flag", gain.alias("gain"))
    sums = each.groupBy("days").agg(F.count("*").alias("runs"), count_where(F.col("win_flag")).alias("wins"), F.round(F.sum("gain"), 4).alias("pl"))
    frame = rows.sparkSession.createDataFrame([(p,) for p in periods], "days int")
    out = frame.join(sums, "days", "left").select("days", F.concat(F.col("days").cast("string"), F.lit("d")).alias("period"), F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), F.coalesce("wins", F.lit(0).cast("long")).alias("wins"), rate(F.col("wins"), F.col("runs")).alias("sr"), (F.col("pl") if priced else F.lit(None).cast("double")).alias("pl"))
    return out.orderBy("days").drop("days")


_FORM = """
WITH x AS (SELECT date_diff('day', race_date, DATE '{day}') AS age, win_flag, CASE WHEN win_bsp > 0 THEN (win_bsp - 1) * win_lose ELSE 0 END AS g FROM runners JOIN races USING (race_id) WHERE {who}),
p AS (SELECT * FROM (VALUES (14), (30), (90)) v(d))
SELECT concat(d, 'd') AS period, count(age) AS runs, count(*) FILTER (win_flag) AS wins, round(100.0 * count(*) FILTER (win_flag) / nullif(count(age), 0), 4) AS sr, {pl} AS pl FROM p LEFT JOIN x ON age <= d GROUP BY d"""


@racing_query("rolling_form", _FORM.format(day="2001-07-25", who="trainer_id = 7", pl="round(sum(g), 4)"), trainer_id=7, as_of="2001-07-25")
def rolling_form(r: Racing, trainer_id: int, as_of: str) -> DataFrame:
    return rolling(r.base.where(F.col("trainer_id") == trainer_id), as_of)


@racing_query("jockey_rolling_form", _FORM.format(day="2001-07-25", who="jockey_id = 42", pl="CAST(NULL AS DOUBLE)"), jockey_id=42, as_of="2001-07-25")
def jockey_rolling_form(r: Racing, jockey_id: int, as_of: str) -> DataFrame:
    return rolling(r.base.where(F.col("jockey_id") == jockey_id), as_of, priced=False)


@racing_query(
    "trainer_combos",
    "SELECT trainer_name, count(*) AS runs, count(*) FILTER (win_flag) AS wins, round(100.0 * count(*) FILTER (win_flag) / count(*), 4) AS sr FROM runners JOIN trainers USING (trainer_id) WHERE jockey_id = 42 GROUP BY trainer_id, trainer_name HAVING count(*) >= 5 ORDER BY sr DESC, trainer_name LIMIT 20",
    jockey_id=42,
)
def trainer_combos(r: Racing, jockey_id: int, least: int = 5, limit: int = 20) -> DataFrame:
    rows = r.runners.where(F.col("jockey_id") == jockey_id).join(r.trainers, "trainer_id")
    won = count_where(F.col("win_flag"))
    out = rows.groupBy("trainer_id", "trainer_name").agg(F.count("*").alias("runs"), won.alias("wins"), rate(won, F.count("*")).alias("sr")).where(F.col("runs") >= least)
    return out.orderBy(F.desc("sr"), "trainer_name").limit(limit).select("trainer_name", "runs", "wins", "sr")


_LATEST = ["race_date", "race_id", "num", "win_bsp"]


def recent_form(r: Racing, horse_id: int, limit: int = 20) -> DataFrame:
    """The last runs with the days since the run before; the window is by horse, so it spreads."""
    rows = r.base.where(F.col("horse_id") == horse_id)
    w = Window.partitionBy("horse_id").orderBy(*_LATEST)
    rows = rows.withColumn("dsr", F.datediff("race_date", F.lag("race_date").over(w)))
    rows = rows.join(r.courses, "course_id", "left").join(r.trainers, "trainer_id", "left").join(r.jockeys, "jockey_id", "left")
    rows = rows.orderBy(*[F.desc(c) for c in _LATEST]).limit(limit)
    return rows.select("race_date", "course_name", "race_type", "going", "dist_f", "pos_num", F.round("btn", 4).alias("btn"), "official", "rpr", F.round("win_bsp", 4).alias("win_bsp"), "trainer_name", "jockey_name", "dsr")


def rating_trend(r: Racing, horse_id: int, limit: int = 20) -> DataFrame:
    rows = r.base.where((F.col("horse_id") == horse_id) & (F.col("rpr").isNotNull() | F.col("official").isNotNull()))
    return rows.orderBy(*[F.desc(c) for c in _LATEST]).limit(limit).select("race_date", "rpr", "official", "class", "win_flag")


def tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Parts of a profile as rows of one frame: part, row as JSON."""
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in part.columns])).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _profile(r: Racing, key: str, value: int) -> Racing:
    """The same warehouse with one entity's runners alone, for all parts of the profile."""
    own = r.runners.where(F.col(key) == value)
    return r.having(runners=own)


_FORM_SQL = """
WITH x AS (SELECT *, date_diff('day', lag(race_date) OVER (PARTITION BY horse_id ORDER BY race_date, race_id, num, win_bsp), race_date) AS dsr FROM runners JOIN races USING (race_id) WHERE horse_id = 100)
SELECT race_date, course_name, race_type, going, dist_f, pos_num, round(btn, 4) AS btn, official, rpr, round(x.win_bsp, 4) AS win_bsp, trainer_name, jockey_name, CAST(dsr AS INT) AS dsr
FROM x LEFT JOIN courses USING (course_id) LEFT JOIN trainers USING (trainer_id) LEFT JOIN jockeys USING (jockey_id) ORDER BY race_date DESC, race_id DESC, num DESC, x.win_bsp DESC LIMIT 20"""
racing_query("horse_recent_form", _FORM_SQL, horse_id=100)(recent_form)
racing_query("horse_rating_trend", "SELECT race_date, rpr, official, class, win_flag FROM runners JOIN races USING (race_id) WHERE horse_id = 100 AND (rpr IS NOT NULL OR official IS NOT NULL) ORDER BY race_date DESC, race_id DESC, num DESC, win_bsp DESC LIMIT 20", horse_id=100)(rating_trend)


def horse_parts(r: Racing, horse_id: int) -> dict[str, DataFrame]:
    """All parts of a horse's profile over the horse's runs alone."""
    r = _profile(r, "horse_id", horse_id)
    return {"horse": r.horses.where(F.col("horse_id") == horse_id).select("horse_id", "horse_name"), "career": career_summary(r, horse_id), "form": recent_form(r, horse_id), "going": going_splits(r, horse_id), "distance": distance_splits(r, horse_id), "course": course_splits(r, horse_id), "trend": rating_trend(r, horse_id)}


def trainer_parts(r: Racing, trainer_id: int, as_of: str) -> dict[str, DataFrame]:
    r = _profile(r, "trainer_id", trainer_id)
    return {"trainer": r.trainers.where(F.col("trainer_id") == trainer_id), "form": rolling_form(r, trainer_id, as_of), "course": trainer_course_splits(r, trainer_id), "type": type_splits(r, trainer_id), "distance": trainer_dist_splits(r, trainer_id)}


def jockey_parts(r: Racing, jockey_id: int, as_of: str) -> dict[str, DataFrame]:
    r = _profile(r, "jockey_id", jockey_id)
    return {"jockey": r.jockeys.where(F.col("jockey_id") == jockey_id), "career": jockey_career(r, jockey_id), "form": jockey_rolling_form(r, jockey_id, as_of), "combos": trainer_combos(r, jockey_id), "course": jockey_course_splits(r, jockey_id)}


@racing_query(
    "horse_profile",
    f"""
WITH own AS (SELECT * FROM runners JOIN races USING (race_id) WHERE horse_id = 100)
SELECT 'horse' AS part, CAST(100 AS VARCHAR) AS category, CAST(1 AS BIGINT) AS runs, CAST(NULL AS BIGINT) AS wins FROM horses WHERE horse_id = 100
UNION ALL SELECT 'career', NULL, count(*), count(*) FILTER (win_flag) FROM own
UNION ALL SELECT 'going', going, count(*), count(*) FILTER (win_flag) FROM own WHERE going IS NOT NULL GROUP BY going HAVING count(*) >= 2
UNION ALL SELECT 'distance', {_DIST_SQL}, count(*), count(*) FILTER (win_flag) FROM own GROUP BY 2
UNION ALL SELECT 'course', course_name, count(*), count(*) FILTER (win_flag) FROM own JOIN courses USING (course_id) GROUP BY course_name HAVING count(*) >= 2
UNION ALL SELECT 'form', NULL, least(20, count(*)), NULL FROM own
UNION ALL SELECT 'trend', NULL, least(20, count(*) FILTER (rpr IS NOT NULL OR official IS NOT NULL)), NULL FROM own""",
    horse_id=100,
)
def horse_profile(r: Racing, horse_id: int) -> DataFrame:
    """A digest of all parts of the profile; ``horse_parts`` gives the parts themselves."""
    p = horse_parts(r, horse_id)
    none = F.lit(None).cast("string").alias("category")
    out = p["horse"].select(F.lit("horse").alias("part"), F.col("horse_id").cast("string").alias("category"), F.lit(1).cast("long").alias("runs"), F.lit(None).cast("long").alias("wins"))
    out = out.unionByName(p["career"].select(F.lit("career").alias("part"), none, "runs", "wins"))
    for name in ("going", "distance", "course"):
        out = out.unionByName(p[name].select(F.lit(name).alias("part"), "category", "runs", "wins"))
    for name in ("form", "trend"):
        out = out.unionByName(p[name].agg(F.count("*").alias("runs")).select(F.lit(name).alias("part"), none, "runs", F.lit(None).cast("long").alias("wins")))
    return out


@racing_query(
    "trainer_profile",
    f"""
WITH own AS (SELECT * FROM runners JOIN races USING (race_id) WHERE trainer_id = 7),
c AS (SELECT course_name, count(*) AS n, count(*) FILTER (win_flag) AS w FROM own JOIN courses USING (course_id) GROUP BY 1 HAVING count(*) >= 10 ORDER BY round(100.0 * count(*) FILTER (win_flag) / count(*), 4) DESC, 1 LIMIT 20)
SELECT 'form' AS part, concat(d, 'd') AS category, count(race_id) AS runs, count(*) FILTER (win_flag) AS wins FROM (VALUES (14), (30), (90)) v(d) LEFT JOIN own ON date_diff('day', race_date, DATE '2001-07-25') <= d GROUP BY d
UNION ALL SELECT 'course', course_name, n, w FROM c UNION ALL SELECT 'type', race_type, count(*), count(*) FILTER (win_flag) FROM own GROUP BY 2 UNION ALL SELECT 'distance', {_DIST_SQL}, count(*), count(*) FILTER (win_flag) FROM own GROUP BY 2""",
    trainer_id=7,
    as_of="2001-07-25",
)
def trainer_profile(r: Racing, trainer_id: int, as_of: str) -> DataFrame:
    p = trainer_parts(r, trainer_id, as_of)
    out = p["form"].select(F.lit("form").alias("part"), F.col("period").alias("category"), "runs", "wins")
    for name in ("course", "type", "distance"):
        out = out.unionByName(p[name].select(F.lit(name).alias("part"), "category", "runs", "wins"))
    return out


@racing_query(
    "jockey_profile",
    """
WITH own AS (SELECT * FROM runners JOIN races USING (race_id) WHERE jockey_id = 42),
t AS (SELECT trainer_name, count(*) AS n, count(*) FILTER (win_flag) AS w FROM own JOIN trainers USING (trainer_id) GROUP BY trainer_id, trainer_name HAVING count(*) >= 5 ORDER BY round(100.0 * count(*) FILTER (win_flag) / count(*), 4) DESC, 1 LIMIT 20),
c AS (SELECT course_name, count(*) AS n, count(*) FILTER (win_flag) AS w FROM own JOIN courses USING (course_id) GROUP BY 1 HAVING count(*) >= 10 ORDER BY round(100.0 * count(*) FILTER (win_flag) / count(*), 4) DESC, 1 LIMIT 20)
SELECT 'career' AS part, CAST(NULL AS VARCHAR) AS category, count(*) AS runs, count(*) FILTER (win_flag) AS wins FROM own
UNION ALL SELECT 'form', concat(d, 'd'), count(race_id), count(*) FILTER (win_flag) FROM (VALUES (14), (30), (90)) v(d) LEFT JOIN own ON date_diff('day', race_date, DATE '2001-07-25') <= d GROUP BY d
UNION ALL SELECT 'combos', trainer_name, n, w FROM t UNION ALL SELECT 'course', course_name, n, w FROM c""",
    jockey_id=42,
    as_of="2001-07-25",
)
def jockey_profile(r: Racing, jockey_id: int, as_of: str) -> DataFrame:
    p = jockey_parts(r, jockey_id, as_of)
    out = p["career"].select(F.lit("career").alias("part"), F.lit(None).cast("string").alias("category"), "runs", "wins")
    out = out.unionByName(p["form"].select(F.lit("form").alias("part"), F.col("period").alias("category"), "runs", "wins"))
    out = out.unionByName(p["combos"].select(F.lit("combos").alias("part"), F.col("trainer_name").alias("category"), "runs", "wins"))
    return out.unionByName(p["course"].select(F.lit("course").alias("part"), "category", "runs", "wins"))


@racing_query(
    "siblings",
    """
WITH s AS (SELECT sire, dam FROM horses WHERE horse_id = 100)
SELECT horse_id, horse_name, count(race_id) AS runs, count(*) FILTER (win_flag) AS wins FROM horses JOIN s USING (sire, dam) LEFT JOIN runners USING (horse_id) WHERE horse_id <> 100 GROUP BY 1, 2""",
    horse_id=100,
)
def siblings(r: Racing, horse_id: int) -> DataFrame:
    """Horses of the same sire and dam with their runs and wins."""
    parents = r.horses.where(F.col("horse_id") == horse_id).select("sire", "dam")
    others = r.horses.join(F.broadcast(parents.limit(1)), ["sire", "dam"]).where(F.col("horse_id") != horse_id)
    rows = others.join(r.runners.select("horse_id", "race_id", "win_flag"), "horse_id", "left")
    return rows.groupBy("horse_id", "horse_name").agg(F.count("race_id").alias("runs"), count_where(F.col("win_flag")).alias("wins"))
