"""Cards, status views and data-quality reports over the warehouse."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railside.functions.columns import count_where, rate
from railside.functions.racing import key_of, status
from railside.plans.racing import Racing
from railside.registry import racing_query

_ONE = "1999-05-05"


def _day(text: str):
    return F.lit(date.fromisoformat(text))


def sizes(r: Racing) -> DataFrame:
    """race_id, actual: runners of each race, summed before any join so that no count is multiplied."""
    return r.runners.groupBy("race_id").agg(F.count("*").alias("actual"))


_SIZES = "WITH s AS (SELECT race_id, count(*) AS actual FROM runners GROUP BY 1) "


@racing_query("betting_card", f"SELECT race_id, num, horse_name, round(coalesce(win_ppwap, dec_price), 4) AS odds, CAST(rank() OVER (PARTITION BY race_id ORDER BY coalesce(win_ppwap, dec_price)) AS INT) AS market_rank FROM runners JOIN races USING (race_id) LEFT JOIN horses USING (horse_id) WHERE race_date = DATE '{_ONE}'", on=_ONE)
def betting_card(r: Racing, on: str) -> DataFrame:
    rows = r.runners.join(r.races.where(F.col("race_date") == _day(on)).select("race_id"), "race_id").join(r.horses, "horse_id", "left").withColumn("o", F.coalesce("win_ppwap", "dec_price"))
    return rows.select("race_id", "num", "horse_name", F.round("o", 4).alias("odds"), F.rank().over(Window.partitionBy("race_id").orderBy("o")).alias("market_rank"))


@racing_query("winners_with_odds", "SELECT race_date, race_id, horse_name, win_bsp AS bsp, dec_price AS sp, btn FROM runners JOIN races USING (race_id) JOIN horses USING (horse_id) WHERE win_flag AND race_date BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'")
def winners_with_odds(r: Racing) -> DataFrame:
    races = r.races.where(F.col("race_date").between(_day("1999-01-01"), _day("1999-03-31"))).select("race_id", "race_date")
    return r.runners.where("win_flag").join(races, "race_id").join(r.horses, "horse_id").select("race_date", "race_id", "horse_name", F.col("win_bsp").alias("bsp"), F.col("dec_price").alias("sp"), "btn")


_OFF = "race_date::TIMESTAMP + to_minutes(off_min)"


@racing_query("races_with_status", f"SELECT status, count(*) AS races FROM (SELECT CASE WHEN TIMESTAMP '1999-05-05 16:00:00' > {_OFF} + INTERVAL 30 MINUTE THEN 'Finished' WHEN TIMESTAMP '1999-05-05 16:00:00' > {_OFF} - INTERVAL 10 MINUTE THEN 'Active' ELSE 'Upcoming' END AS status FROM races) GROUP BY 1", as_of="1999-05-05 16:00:00")
def races_with_status(r: Racing, as_of: str) -> DataFrame:
    """Races by status at a given time; offs are UTC here."""
    off = F.timestamp_seconds(F.unix_timestamp(F.col("race_date").cast("timestamp")) + F.col("off_min") * 60)
    return r.races.groupBy(status(off, F.lit(as_of).cast("timestamp")).alias("status")).agg(F.count("*").alias("races"))


@racing_query("v_runners", "SELECT race_id, num, horse_id, course_name, md5(concat_ws('|', CAST(race_date AS VARCHAR), CAST(course_id AS VARCHAR))) AS meeting_key FROM runners JOIN races USING (race_id) JOIN courses USING (course_id)")
def runners_view(r: Racing) -> DataFrame:
    return r.base.join(r.courses, "course_id").select("race_id", "num", "horse_id", "course_name", key_of(F.col("race_date"), F.col("course_id")).alias("meeting_key"))


@racing_query("horse_history", "SELECT horse_id, race_id, race_date, CAST(date_diff('day', lag(race_date) OVER (PARTITION BY horse_id ORDER BY race_date, race_id), race_date) AS INT) AS dsr FROM (SELECT DISTINCT horse_id, race_id, race_date FROM runners JOIN races USING (race_id))")
def horse_history(r: Racing) -> DataFrame:
    """Every race of every horse with the days since the one before.

    Runs are dealt by race, then by horse; one sort puts a horse's runs in order, and a run in the
    same race as the one before it goes.
    """
    runs = r.with_races(r.runners.select("horse_id", "race_id"), r.races.select("race_id", "race_date"))
    at = F.struct("race_date", "race_id")
    before = F.lag(at).over(Window.partitionBy("horse_id").orderBy("race_date", "race_id"))
    rows = r.dealt(runs, "horse_id").withColumn("before", before).where(~F.col("before").eqNullSafe(at))
    return rows.select("horse_id", "race_id", "race_date", F.datediff("race_date", "before.race_date").alias("dsr"))


@racing_query("dq_orphan_fk", "SELECT race_id, num, horse_id FROM runners WHERE NOT EXISTS (SELECT 1 FROM horses h WHERE h.horse_id = runners.horse_id AND h.horse_id % 80 <> 0)")
def orphan_keys(r: Racing) -> DataFrame:
    return r.runners.join(r.horses.where("horse_id % 80 <> 0").select("horse_id"), "horse_id", "left_anti").select("race_id", "num", "horse_id")


@racing_query("dedupe_exists", "SELECT min(race_id) AS race_id, race_date, course_id FROM races GROUP BY race_date, course_id")
def first_of_equals(r: Racing) -> DataFrame:
    """Of races that are equal by day and course, the one with the smallest id."""
    return r.races.groupBy("race_date", "course_id").agg(F.min("race_id").alias("race_id"))


@racing_query("dq_entries_today", "SELECT course_name, count(DISTINCT race_id) AS races, count(*) AS entries FROM runners JOIN races USING (race_id) JOIN courses USING (course_id) WHERE pos_raw IS NULL AND race_date >= DATE '2001-01-01' GROUP BY 1")
def entries_by_course(r: Racing) -> DataFrame:
    rows = r.runners.where("pos_raw is null").join(r.races.where(F.col("race_date") >= _day("2001-01-01")), "race_id").join(r.courses, "course_id")
    return rows.groupBy("course_name").agg(F.countDistinct("race_id").alias("races"), F.count("*").alias("entries"))


@racing_query("dq_no_results", "SELECT race_id FROM races LEFT JOIN runners USING (race_id) GROUP BY race_id HAVING count(pos_num) = 0")
def without_results(r: Racing) -> DataFrame:
    return r.races.select("race_id").join(r.runners.where("pos_num is not null").select("race_id"), "race_id", "left_anti")


@racing_query("dq_runner_mismatch", _SIZES + "SELECT race_id, ran, actual, abs(ran - actual) AS difference FROM races JOIN s USING (race_id) WHERE ran <> actual AND race_date >= DATE '2001-06-01'")
def size_mismatch(r: Racing) -> DataFrame:
    rows = r.races.where(F.col("race_date") >= _day("2001-06-01")).join(sizes(r), "race_id").where("ran <> actual")
    return rows.select("race_id", "ran", "actual", F.abs(F.col("ran") - F.col("actual")).alias("difference")).orderBy(F.desc("difference"), "race_id")


@racing_query("dq_unresolved_today", "SELECT DISTINCT ON (horse_id) horse_id, race_id FROM runners WHERE horse_id % 3 = 0 ORDER BY horse_id, race_id")
def first_unresolved(r: Racing) -> DataFrame:
    """The first race of each unresolved name."""
    return r.runners.where("horse_id % 3 = 0").groupBy("horse_id").agg(F.min("race_id").alias("race_id"))


@racing_query("dq_missing_winner", "SELECT races.race_id FROM races LEFT JOIN runners ru ON ru.race_id = races.race_id AND ru.pos_num = 1 WHERE ru.race_id IS NULL")
def missing_winner(r: Racing) -> DataFrame:
    return r.races.select("race_id").join(r.runners.where("pos_num = 1").select("race_id"), "race_id", "left_anti")


@racing_query("dq_month_coverage", "SELECT strftime(race_date, '%Y-%m') AS month, count(*) AS races, count(DISTINCT course_id) AS courses, count(*) FILTER (ran > 0) AS with_ran, count(*) FILTER (ran IS NULL OR ran = 0) AS without_ran FROM races GROUP BY 1")
def month_coverage(r: Racing) -> DataFrame:
    return r.races.groupBy(F.date_format("race_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("races"), F.countDistinct("course_id").alias("courses"), count_where(F.col("ran") > 0).alias("with_ran"), count_where(F.col("ran").isNull() | (F.col("ran") == 0)).alias("without_ran"))


@racing_query("dq_unresolved_dims", "SELECT kind, id, count(*) AS n, min(race_date) AS first_seen, max(race_date) AS last_seen FROM (SELECT 'horse' AS kind, horse_id AS id, race_date FROM runners JOIN races USING (race_id) WHERE horse_id % 50 = 0 UNION ALL SELECT 'trainer', trainer_id, race_date FROM runners JOIN races USING (race_id) WHERE trainer_id % 50 = 0 UNION ALL SELECT 'jockey', jockey_id, race_date FROM runners JOIN races USING (race_id) WHERE jockey_id % 50 = 0) GROUP BY 1, 2")
def unresolved(r: Racing) -> DataFrame:
    """Unresolved ids of three dimensions in one pass over the facts."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").cast("long").alias("id")) for k in ("horse", "trainer", "jockey")])).alias("x")
    rows = r.base.select("race_date", kinds).select("race_date", "x.kind", "x.id").where("id % 50 = 0")
    return rows.groupBy("kind", "id").agg(F.count("*").alias("n"), F.min("race_date").alias("first_seen"), F.max("race_date").alias("last_seen"))


@racing_query("dq_missing_prices", "SELECT race_date, course_id, count(*) AS runners, round(100.0 * count(dec_price) / count(*), 4) AS pct FROM runners JOIN races USING (race_id) GROUP BY 1, 2 HAVING count(dec_price) < count(*)")
def missing_prices(r: Racing) -> DataFrame:
    return r.base.groupBy("race_date", "course_id").agg(F.count("*").alias("runners"), F.count("dec_price").alias("k")).where("k < runners").select("race_date", "course_id", "runners", rate(F.col("k"), F.col("runners")).alias("pct"))


_SUMMARY = _SIZES + "SELECT {key} AS period, count(*) AS races, CAST(sum(ran) AS BIGINT) AS declared, CAST(coalesce(sum(actual), 0) AS BIGINT) AS actual, round(100.0 * coalesce(sum(actual), 0) / sum(ran), 4) AS pct FROM races LEFT JOIN s USING (race_id) GROUP BY 1"


def summary(r: Racing, period) -> DataFrame:
    """Races, declared and actual runners by period; runners are summed by race before the join."""
    rows = r.races.join(sizes(r), "race_id", "left").groupBy(period.alias("period"))
    out = rows.agg(F.count("*").alias("races"), F.sum("ran").alias("declared"), F.coalesce(F.sum("actual"), F.lit(0)).alias("actual"))
    return out.withColumn("pct", rate(F.col("actual"), F.col("declared")))


@racing_query("dq_daily_summary", _SUMMARY.format(key="CAST(race_date AS VARCHAR)"))
def daily_summary(r: Racing) -> DataFrame:
    return summary(r, F.col("race_date").cast("string"))


@racing_query("dq_month_coverage_pct", _SUMMARY.format(key="strftime(race_date, '%Y-%m')") + " ORDER BY 1 DESC LIMIT 50")
def month_coverage_pct(r: Racing, limit: int = 50) -> DataFrame:
    return summary(r, F.date_format("race_date", "yyyy-MM")).orderBy(F.desc("period")).limit(limit)


@racing_query("dq_year_completeness", _SUMMARY.format(key="CAST(year(race_date) AS VARCHAR)"))
def year_completeness(r: Racing) -> DataFrame:
    return summary(r, F.year("race_date").cast("string"))


@racing_query("dq_yearly", "SELECT CAST(year(race_date) AS INT) AS y, count(*) AS races, count(DISTINCT course_id) AS courses, min(race_date) AS first_day, max(race_date) AS last_day FROM races GROUP BY 1")
def yearly(r: Racing) -> DataFrame:
    return r.races.groupBy(F.year("race_date").alias("y")).agg(F.count("*").alias("races"), F.countDistinct("course_id").alias("courses"), F.min("race_date").alias("first_day"), F.max("race_date").alias("last_day"))


@racing_query("dq_duplicate_keys", "SELECT race_date, course_id, count(*) AS n, string_agg(CAST(race_id AS VARCHAR), ',' ORDER BY race_id) AS ids FROM races GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(r: Racing) -> DataFrame:
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("race_id")), lambda x: x.cast("string")), ",")
    return r.races.groupBy("race_date", "course_id").agg(F.count("*").alias("n"), ids.alias("ids")).where("n > 1")


_SAMPLE = "SELECT horse_id, y, runs, win_rate FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(horse_id, '|', y)), horse_id) AS rn FROM (SELECT horse_id, CAST(year(race_date) AS INT) AS y, count(*) AS runs, round(100.0 * count(*) FILTER (win_flag) / count(*), 4) AS win_rate FROM runners JOIN races USING (race_id) GROUP BY 1, 2 HAVING count(*) >= {least})) WHERE rn <= {n}"


def sampled_horses(r: Racing, n: int, least: int) -> DataFrame:
    """n horses of each year, by a hash, of at least so many runs."""
    stats = r.base.groupBy("horse_id", F.year("race_date").alias("y")).agg(F.count("*").alias("runs"), rate(count_where(F.col("win_flag")), F.count("*")).alias("win_rate")).where(F.col("runs") >= least)
    w = Window.partitionBy("y").orderBy(F.md5(F.concat(F.col("horse_id").cast("string"), F.lit("|"), F.col("y").cast("string"))), "horse_id")
    return stats.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("horse_id", "y", "runs", "win_rate")


@racing_query("dq_horse_sample", _SAMPLE.format(least=1, n=3))
def horse_sample(r: Racing) -> DataFrame:
    return sampled_horses(r, 3, 1)


@racing_query("dq_horse_sample_year", _SAMPLE.format(least=5, n=5))
def horse_sample_year(r: Racing) -> DataFrame:
    return sampled_horses(r, 5, 5)


_FILL = ("pos_num", "official", "rpr", "dec_price")


@racing_query("dq_horse_deep", "SELECT horse_id, count(*) AS runs, " + ", ".join(f"round(100.0 * count({x}) / count(*), 4) AS {x}_pct" for x in _FILL) + " FROM runners GROUP BY 1")
def horse_fill(r: Racing) -> DataFrame:
    """How far each horse's fields are filled."""
    return r.runners.groupBy("horse_id").agg(F.count("*").alias("runs"), *[rate(F.count(x), F.count("*")).alias(f"{x}_pct") for x in _FILL])


@racing_query("dq_one_horse", "SELECT horse_id, count(*) AS runs, count(*) FILTER (win_flag) AS wins, min(race_date) AS first_run, max(race_date) AS last_run, count(DISTINCT trainer_id) AS trainers, count(DISTINCT jockey_id) AS jockeys, count(DISTINCT course_id) AS courses FROM runners JOIN races USING (race_id) WHERE horse_id = 77 GROUP BY 1", horse_id=77)
def one_horse(r: Racing, horse_id: int) -> DataFrame:
    rows = r.runners.where(F.col("horse_id") == horse_id).join(r.races, "race_id")
    return rows.groupBy("horse_id").agg(F.count("*").alias("runs"), count_where(F.col("win_flag")).alias("wins"), F.min("race_date").alias("first_run"), F.max("race_date").alias("last_run"), *[F.countDistinct(f"{x}_id").alias(f"{x}s") for x in ("trainer", "jockey", "course")])


@racing_query("dq_missing_ran", "SELECT race_id, race_date, count(*) OVER (PARTITION BY race_date) AS that_day FROM races WHERE ran = 1")
def missing_ran(r: Racing) -> DataFrame:
    rows = r.races.where("ran = 1").select("race_id", "race_date")
    return rows.join(rows.groupBy("race_date").agg(F.count("*").alias("that_day")), "race_date")


@racing_query("dq_mismatch_top", _SIZES + "SELECT race_id, ran, coalesce(actual, 0) AS actual FROM races LEFT JOIN s USING (race_id) WHERE ran <> coalesce(actual, 0) ORDER BY abs(ran - coalesce(actual, 0)) DESC, race_id LIMIT 20")
def mismatch_top(r: Racing, limit: int = 20) -> DataFrame:
    rows = r.races.join(sizes(r), "race_id", "left").select("race_id", "ran", F.coalesce("actual", F.lit(0).cast("long")).alias("actual")).where("ran <> actual")
    return rows.orderBy(F.desc(F.abs(F.col("ran") - F.col("actual"))), "race_id").limit(limit)


@racing_query("dq_unresolved_30d", "SELECT race_date, count(DISTINCT horse_id) AS names FROM runners JOIN races USING (race_id) WHERE horse_id % 3 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def unresolved_by_day(r: Racing, limit: int = 20) -> DataFrame:
    return r.base.where("horse_id % 3 = 0").groupBy("race_date").agg(F.countDistinct("horse_id").alias("names")).orderBy(F.desc("names"), "race_date").limit(limit)


@racing_query("dq_price_coverage", "SELECT strftime(race_date, '%Y-%m') AS month, round(100.0 * count(win_bsp) / count(*), 4) AS bsp_pct, round(100.0 * count(dec_price) / count(*), 4) AS sp_pct FROM runners JOIN races USING (race_id) GROUP BY 1")
def price_coverage(r: Racing) -> DataFrame:
    return r.base.groupBy(F.date_format("race_date", "yyyy-MM").alias("month")).agg(rate(F.count("win_bsp"), F.count("*")).alias("bsp_pct"), rate(F.count("dec_price"), F.count("*")).alias("sp_pct"))


@racing_query("dq_issue_summary", _SIZES + ", i AS (SELECT 'mismatch' AS issue, count(*) AS n FROM races JOIN s USING (race_id) WHERE ran <> actual UNION ALL SELECT 'no runners', count(*) FROM races WHERE race_id NOT IN (SELECT race_id FROM s) UNION ALL SELECT 'no price', count(*) FROM runners WHERE dec_price IS NULL UNION ALL SELECT 'no size', count(*) FROM races WHERE ran IS NULL) SELECT issue, n, CASE WHEN n = 0 THEN 'OK' WHEN n < 1000 THEN 'Warning' ELSE 'Critical' END AS severity FROM i")
def issue_summary(r: Racing) -> DataFrame:
    both = r.races.join(sizes(r), "race_id", "left").agg(count_where(F.col("ran") != F.col("actual")).alias("mismatch"), count_where(F.col("actual").isNull()).alias("no runners"), count_where(F.col("ran").isNull()).alias("no size"))
    out = both.unpivot([], both.columns, "issue", "n").unionByName(r.runners.agg(count_where(F.col("dec_price").isNull()).alias("n")).withColumn("issue", F.lit("no price")))
    return out.withColumn("severity", F.when(F.col("n") == 0, "OK").when(F.col("n") < 1000, "Warning").otherwise("Critical"))


@racing_query("dq_race_sample", _SIZES + "SELECT month, race_id, CASE WHEN actual IS NULL THEN 'empty' WHEN actual = ran THEN 'complete' ELSE 'partial' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY md5(CAST(race_id AS VARCHAR)), race_id) AS rn FROM (SELECT race_id, ran, strftime(race_date, '%Y-%m') AS month FROM races)) LEFT JOIN s USING (race_id) WHERE rn <= 3")
def race_sample(r: Racing, n: int = 3) -> DataFrame:
    rows = r.races.select("race_id", "ran", F.date_format("race_date", "yyyy-MM").alias("month"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("month").orderBy(F.md5(F.col("race_id").cast("string")), "race_id"))).where(F.col("rn") <= n).join(sizes(r), "race_id", "left")
    return rows.select("month", "race_id", F.when(F.col("actual").isNull(), "empty").when(F.col("actual") == F.col("ran"), "complete").otherwise("partial").alias("status"))


@racing_query("dq_metrics_long", "SELECT unnest(['runs', 'wins', 'placed', 'rated', 'priced']) AS metric, unnest([count(*), count(*) FILTER (win_flag), count(*) FILTER (pos_num <= 3), count(rpr), count(dec_price)]) AS n FROM runners")
def metrics_long(r: Racing) -> DataFrame:
    """One row of sums, unpivoted."""
    wide = r.runners.agg(F.count("*").alias("runs"), count_where(F.col("win_flag")).alias("wins"), count_where(F.col("pos_num") <= 3).alias("placed"), F.count("rpr").alias("rated"), F.count("dec_price").alias("priced"))
    return wide.unpivot([], wide.columns, "metric", "n")


@racing_query("dq_known_entities", "SELECT horse_id, horse_name, count(race_id) AS runs, CASE WHEN count(race_id) >= 30 THEN 'complete' ELSE 'thin' END AS status FROM horses LEFT JOIN runners USING (horse_id) WHERE horse_id IN (1, 7, 77, 770) GROUP BY 1, 2", ids=(1, 7, 77, 770))
def known_entities(r: Racing, ids: tuple[int, ...]) -> DataFrame:
    runs = r.runners.where(F.col("horse_id").isin(*ids)).groupBy("horse_id").agg(F.count("*").alias("runs"))
    rows = r.horses.where(F.col("horse_id").isin(*ids)).join(runs, "horse_id", "left").select("horse_id", "horse_name", F.coalesce("runs", F.lit(0).cast("long")).alias("runs"))
    return rows.withColumn("status", F.when(F.col("runs") >= 30, "complete").otherwise("thin"))


@racing_query("dq_month_grade", "SELECT month, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' ELSE 'C' END AS grade FROM (SELECT strftime(race_date, '%Y-%m') AS month, round((100.0 * count(pos_num) + 100.0 * count(official) + 100.0 * count(rpr) + 100.0 * count(dec_price)) / (4 * count(*)), 2) AS score FROM runners JOIN races USING (race_id) GROUP BY 1)")
def month_grade(r: Racing) -> DataFrame:
    filled = sum((F.count(x) for x in _FILL), F.lit(0))
    rows = r.base.groupBy(F.date_format("race_date", "yyyy-MM").alias("month")).agg(F.round(filled * 100.0 / (F.count("*") * 4), 2).cast("double").alias("score"))
    return rows.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").otherwise("C"))


@racing_query("dq_totals", " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in ("races", "runners", "horses", "trainers", "jockeys", "courses")))
def totals(r: Racing) -> DataFrame:
    out = None
    for t in ("races", "runners", "horses", "trainers", "jockeys", "courses"):
        one = getattr(r, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@racing_query("coverage_pct", "SELECT race_date, pct, CASE WHEN pct >= 80 THEN 'Ready' WHEN pct >= 50 THEN 'Partial' ELSE 'Not ready' END AS state FROM (SELECT race_date, round(100.0 * count(dec_price) / count(*), 4) AS pct FROM runners JOIN races USING (race_id) GROUP BY 1)")
def readiness(r: Racing) -> DataFrame:
    rows = r.base.groupBy("race_date").agg(rate(F.count("dec_price"), F.count("*")).alias("pct"))
    return rows.withColumn("state", F.when(F.col("pct") >= 80, "Ready").when(F.col("pct") >= 50, "Partial").otherwise("Not ready"))


@racing_query("string_agg", "SELECT course_id, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces, count(DISTINCT going) FILTER (dist_f > 8) AS goings FROM races GROUP BY 1")
def joined_names(r: Racing) -> DataFrame:
    return r.races.groupBy("course_id").agg(F.array_join(F.sort_array(F.collect_set("surface")), ",").alias("surfaces"), F.countDistinct(F.when(F.col("dist_f") > 8, F.col("going"))).alias("goings"))


@racing_query("dup_count", "SELECT count(*) - count(DISTINCT (race_id, num)) AS repeats FROM runners")
def repeats(r: Racing) -> DataFrame:
    keys = r.runners.groupBy("race_id", "num").agg(F.count("*").alias("n"))
    return keys.agg(F.sum(F.col("n") - 1).alias("repeats"))


@racing_query("starters", "SELECT race_id, count(*) FILTER (pos_raw IS NULL OR pos_raw <> 'PU') AS starters FROM runners GROUP BY 1")
def starters(r: Racing) -> DataFrame:
    return r.runners.groupBy("race_id").agg(count_where(F.col("pos_raw").isNull() | (F.col("pos_raw") != "PU")).alias("starters"))


@racing_query("siblings", "SELECT a.horse_id, count(DISTINCT b.horse_id) AS siblings FROM horses a JOIN horses b ON a.sire = b.sire AND a.dam = b.dam AND a.horse_id <> b.horse_id GROUP BY 1")
def sibling_counts(r: Racing) -> DataFrame:
    """Horses of the same parents: counted by parents, not by pairs."""
    family = r.horses.groupBy("sire", "dam").agg(F.count("*").alias("n")).where("n > 1")
    return r.horses.join(family, ["sire", "dam"]).select("horse_id", (F.col("n") - 1).alias("siblings"))


@racing_query("verify_data", "WITH f AS (SELECT race_id, ran FROM races WHERE race_id % 7 <> 0), w AS (SELECT race_id, count(*) AS n FROM runners GROUP BY 1) SELECT CASE WHEN w.race_id IS NULL THEN 'missing' WHEN f.race_id IS NULL THEN 'extra' WHEN ran <> n THEN 'count differs' ELSE 'equal' END AS finding, count(*) AS races FROM f FULL JOIN w ON f.race_id = w.race_id GROUP BY 1")
def verify(r: Racing) -> DataFrame:
    """Source races against the warehouse's: one full outer join."""
    f, w = r.races.where("race_id % 7 <> 0").select("race_id", "ran"), sizes(r)
    both = f.join(w, "race_id", "full_outer")
    finding = F.when(F.col("actual").isNull(), "missing").when(F.col("ran").isNull(), "extra").when(F.col("ran") != F.col("actual"), "count differs").otherwise("equal")
    return both.groupBy(finding.alias("finding")).agg(F.count("*").alias("races"))


@racing_query("date_gaps", "SELECT CAST(d AS DATE) AS d FROM generate_series(TIMESTAMP '1999-05-01', TIMESTAMP '1999-05-30', INTERVAL 1 DAY) g(d) WHERE CAST(d AS DATE) NOT IN (SELECT race_date FROM races WHERE race_id % 4 = 0)", first="1999-05-01", last="1999-05-30")
def date_gaps(r: Racing, first: str, last: str) -> DataFrame:
    """Days of a calendar without complete races."""
    days = r.races.sparkSession.range(1).select(F.explode(F.sequence(_day(first), _day(last))).alias("d"))
    done = r.races.where("race_id % 4 = 0").where(F.col("race_date").between(_day(first), _day(last))).select(F.col("race_date").alias("d"))
    return days.join(done, "d", "left_anti")


@racing_query("check_missing", "SELECT race_date, count(*) AS missing FROM races WHERE race_id NOT IN (SELECT race_id FROM runners WHERE dec_price IS NOT NULL) GROUP BY 1")
def missing_slots(r: Racing) -> DataFrame:
    return r.races.join(r.runners.where("dec_price is not null").select("race_id"), "race_id", "left_anti").groupBy("race_date").agg(F.count("*").alias("missing"))


@racing_query("course_orphans", "SELECT course_id, count(*) AS races FROM races WHERE course_id NOT IN (SELECT course_id FROM courses WHERE course_id % 5 <> 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def course_orphans(r: Racing, limit: int = 20) -> DataFrame:
    return r.races.join(r.courses.where("course_id % 5 <> 0").select("course_id"), "course_id", "left_anti").groupBy("course_id").agg(F.count("*").alias("races")).orderBy(F.desc("races"), "course_id").limit(limit)


@racing_query("validate_load", _SIZES + "SELECT (SELECT count(*) FROM races) AS races, (SELECT count(DISTINCT race_id) FROM races) AS keys, (SELECT count(*) FROM runners WHERE win_bsp < 1.01) AS sentinels, (SELECT count(*) FROM races WHERE race_id NOT IN (SELECT race_id FROM s)) AS empty_races")
def validate_load(r: Racing) -> DataFrame:
    a = r.races.agg(F.count("*").alias("races"), F.countDistinct("race_id").alias("keys"))
    b = r.runners.agg(count_where(F.col("win_bsp") < 1.01).alias("sentinels"))
    c = r.races.join(r.runners.select("race_id"), "race_id", "left_anti").agg(F.count("*").alias("empty_races"))
    return a.join(b).join(c)
