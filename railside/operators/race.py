"""Race search and lookups, meetings, parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railside.plans.racing import Racing
from railside.registry import racing_query

_RACE = ["race_id", "race_date", "course_id", "off_min", "race_name", "race_type", "class", "dist_f", "going", "surface", "ran"]
_RACE_SQL = ", ".join(_RACE)


def page_size(limit: int | None, default: int = 50, most: int = 1000) -> int:
    """A page's rows: the default below 1, at most ``most``."""
    return default if limit is None or limit < 1 else min(limit, most)


def day(text: str) -> date:
    """A date parameter; only YYYY-MM-DD is accepted."""
    if len(text) != 10:
        raise ValueError(f"not a YYYY-MM-DD date: {text!r}")
    return date.fromisoformat(text)


def default_window(date_from: str | None, date_to: str | None, as_of: str, days: int = 365) -> tuple[str | None, str | None]:
    """The last year before ``as_of``, only if neither bound is given."""
    if date_from or date_to:
        return date_from, date_to
    return date.fromordinal(day(as_of).toordinal() - days).isoformat(), as_of


@dataclass
class RaceFilters:
    """Optional conditions of a race search; None means no condition."""

    date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    course_id: int | None = None
    region_id: int | None = None
    pattern: str | None = None
    race_type: str | None = None
    class_: str | None = None
    handicap: bool | None = None
    dist_min: float | None = None
    dist_max: float | None = None
    going: str | None = None
    surface: str | None = None
    field_min: int | None = None
    field_max: int | None = None

    def conditions(self):
        c = F.col
        tests = {
            "date": lambda v: c("race_date") == F.lit(day(v)),
            "date_from": lambda v: c("race_date") >= F.lit(day(v)),
            "date_to": lambda v: c("race_date") <= F.lit(day(v)),
            "course_id": lambda v: c("course_id") == v,
            "region_id": lambda v: c("region_id") == v,
            "pattern": lambda v: c("pattern") == v,
            "race_type": lambda v: c("race_type") == v,
            "class_": lambda v: c("class") == v,
            "handicap": lambda v: c("race_name").ilike("%handicap%") if v else ~c("race_name").ilike("%handicap%"),
            "dist_min": lambda v: c("dist_f") >= v,
            "dist_max": lambda v: c("dist_f") <= v,
            "going": lambda v: c("going").ilike(f"%{v}%"),
            "surface": lambda v: c("surface") == v,
            "field_min": lambda v: c("ran") >= v,
            "field_max": lambda v: c("ran") <= v,
        }
        return [tests[f.name](getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None]


@racing_query(
    "race_search",
    f"SELECT {_RACE_SQL} FROM races JOIN (SELECT course_id, region_id FROM courses) USING (course_id) WHERE region_id = 2 AND pattern = 'Listed' AND race_date BETWEEN DATE '1995-01-01' AND DATE '2000-12-31' AND race_type = 'Flat' AND class = 'O' AND race_name ILIKE '%handicap%' AND dist_f >= 6 AND dist_f <= 14 AND going ILIKE '%good%' AND surface = 'Turf' AND ran >= 2 AND ran <= 6 ORDER BY race_date DESC, off_min, race_id LIMIT 100 OFFSET 1",
    filters=RaceFilters(date_from="1995-01-01", date_to="2000-12-31", region_id=2, pattern="Listed", race_type="Flat", class_="O", handicap=True, dist_min=6, dist_max=14, going="good", surface="Turf", field_min=2, field_max=6),
    limit=100,
    offset=1,
)
def race_search(r: Racing, filters: RaceFilters, limit: int = 100, offset: int = 0) -> DataFrame:
    """Races that meet all given conditions, newest first; a region is that of the race's course."""
    races = r.races if filters.region_id is None else r.races.join(r.courses.select("course_id", "region_id"), "course_id")
    for condition in filters.conditions():
        races = races.where(condition)
    return races.orderBy(F.desc("race_date"), "off_min", "race_id").offset(offset).limit(page_size(limit, 100)).select(*_RACE)


@racing_query("race_by_id", f"SELECT {_RACE_SQL} FROM races WHERE race_id = 77", race_id=77)
def race_by_id(r: Racing, race_id: int) -> DataFrame:
    return r.races.where(F.col("race_id") == race_id).select(*_RACE)


@racing_query("runners_by_race", "SELECT race_id, num, horse_name, trainer_name, jockey_name, pos_num FROM runners LEFT JOIN horses USING (horse_id) LEFT JOIN trainers USING (trainer_id) LEFT JOIN jockeys USING (jockey_id) WHERE race_id = 77", race_id=77)
def runners_by_race(r: Racing, race_id: int) -> DataFrame:
    """A race's runners with names: finishers first, then by number."""
    rows = r.runners.where(F.col("race_id") == race_id).join(r.horses, "horse_id", "left").join(r.trainers, "trainer_id", "left").join(r.jockeys, "jockey_id", "left")
    return rows.orderBy(F.asc_nulls_last("pos_num"), "num", "horse_name").select("race_id", "num", "horse_name", "trainer_name", "jockey_name", "pos_num")


@racing_query("runners_for_races", "SELECT race_id, num, horse_id, pos_num FROM runners WHERE race_id IN (1, 7, 77, 770, 1001)", race_ids=(1, 7, 77, 770, 1001))
def runners_for_races(r: Racing, race_ids: tuple[int, ...]) -> DataFrame:
    """Runners of a list of races in one scan."""
    return r.runners.where(F.col("race_id").isin(*race_ids)).orderBy("race_id", "num", "horse_id").select("race_id", "num", "horse_id", "pos_num")


@racing_query("races_on_date", f"SELECT {_RACE_SQL} FROM races WHERE race_date = DATE '1999-05-05' ORDER BY off_min, race_id LIMIT 50", on="1999-05-05")
def races_on_date(r: Racing, on: str, limit: int = 50) -> DataFrame:
    return r.races.where(F.col("race_date") == F.lit(day(on))).orderBy("off_min", "race_id").limit(page_size(limit)).select(*_RACE)


@racing_query("courses_list", "SELECT course_id, course_name, region_id FROM courses")
def courses_list(r: Racing) -> DataFrame:
    return r.courses.orderBy("course_name")


@racing_query("p_eq", "SELECT race_id, surface FROM races WHERE surface = 'AW'", surface="AW")
def equals(r: Racing, surface: str) -> DataFrame:
    return r.races.where(F.col("surface") == surface).select("race_id", "surface")


@racing_query("p_range", "SELECT race_id, dist_f FROM races WHERE dist_f >= 7 AND dist_f <= 9", low=7, high=9)
def in_range(r: Racing, low: float, high: float) -> DataFrame:
    return r.races.where((F.col("dist_f") >= low) & (F.col("dist_f") <= high)).select("race_id", "dist_f")


@racing_query("p_ilike", "SELECT race_id, race_name FROM races WHERE race_name ILIKE '%HANDICAP%' AND going ILIKE '%soft%'")
def handicaps(r: Racing) -> DataFrame:
    return r.races.where(F.col("race_name").ilike("%HANDICAP%") & F.col("going").ilike("%soft%")).select("race_id", "race_name")


@racing_query("p_not_ilike", "SELECT race_id, race_name FROM races WHERE race_name NOT ILIKE '%handicap%'")
def not_handicaps(r: Racing) -> DataFrame:
    return r.races.where(~F.col("race_name").ilike("%handicap%")).select("race_id", "race_name")


@racing_query("p_between", "SELECT race_id, race_date FROM races WHERE race_date BETWEEN DATE '1999-01-01' AND DATE '1999-01-31'")
def between(r: Racing) -> DataFrame:
    return r.races.where(F.col("race_date").between(F.lit(date(1999, 1, 1)), F.lit(date(1999, 1, 31)))).select("race_id", "race_date")


@racing_query("p_is_null", "SELECT race_id, num, horse_id FROM runners WHERE pos_raw IS NULL")
def entries(r: Racing) -> DataFrame:
    """Racecard entries: runners without a result."""
    return r.runners.where("pos_raw is null").select("race_id", "num", "horse_id")


@racing_query("p_is_distinct", "SELECT race_id, ran, n FROM races JOIN (SELECT race_id, count(*) AS n FROM runners GROUP BY 1) USING (race_id) WHERE n IS DISTINCT FROM ran")
def changed_size(r: Racing) -> DataFrame:
    """Races whose declared size is not, null-safely, the number of their runners."""
    sizes = r.runners.groupBy("race_id").agg(F.count("*").alias("n"))
    return r.races.join(sizes, "race_id").where(~F.col("n").eqNullSafe(F.col("ran"))).select("race_id", "ran", "n")


@racing_query("p_or_group", "SELECT race_id, num, horse_id FROM runners WHERE dec_price IS NOT NULL OR official IS NOT NULL OR rpr IS NOT NULL")
def any_known(r: Racing) -> DataFrame:
    return r.runners.where(F.col("dec_price").isNotNull() | F.col("official").isNotNull() | F.col("rpr").isNotNull()).select("race_id", "num", "horse_id")


# Result codes of horses that did not start.
NON_RUNNERS = ("NR", "N/R", "WD", "W/D", "RES", "RESERVE")


@racing_query("p_not_in_list", "SELECT race_id, num, pos_raw FROM runners WHERE pos_raw IS NULL OR upper(trim(pos_raw)) NOT IN ('NR', 'N/R', 'WD', 'W/D', 'RES', 'RESERVE', '7')", more=("7",))
def starters_only(r: Racing, more: tuple[str, ...] = ()) -> DataFrame:
    code = F.upper(F.trim("pos_raw"))
    return r.runners.where(F.col("pos_raw").isNull() | ~code.isin(*NON_RUNNERS, *more)).select("race_id", "num", "pos_raw")


@racing_query("p_regex", "SELECT race_id, num, pos_raw FROM runners WHERE regexp_matches(pos_raw, '^[0-9]+$')")
def numeric_positions(r: Racing) -> DataFrame:
    return r.runners.where(F.col("pos_raw").rlike("^[0-9]+$")).select("race_id", "num", "pos_raw")


@racing_query("p_default_window", "SELECT race_id, race_date FROM races WHERE race_date BETWEEN DATE '1999-07-02' AND DATE '2000-07-01'", as_of="2000-07-01")
def last_year(r: Racing, as_of: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    low, high = default_window(date_from, date_to, as_of)
    rows = r.races if low is None else r.races.where(F.col("race_date") >= F.lit(day(low)))
    return (rows if high is None else rows.where(F.col("race_date") <= F.lit(day(high)))).select("race_id", "race_date")


@racing_query("proj_case_bucket", "SELECT race_id, CASE WHEN dist_f < 7 THEN '5-6f' WHEN dist_f < 9 THEN '7-8f' WHEN dist_f < 13 THEN '9-12f' ELSE '13f+' END AS bucket FROM races")
def distance_buckets(r: Racing) -> DataFrame:
    from railside.operators.profile import distance_bucket

    return r.races.select("race_id", distance_bucket().alias("bucket"))


@racing_query("proj_price_select", "SELECT race_id, num, horse_id, win_ppwap AS price FROM runners", source="ppwap")
def price_of(r: Racing, source: str) -> DataFrame:
    """The price that a name chooses; an unknown name gives null."""
    column = {"bsp": "win_bsp", "dec": "dec_price", "ppwap": "win_ppwap"}.get(source)
    price = F.col(column) if column else F.lit(None).cast("double")
    return r.runners.select("race_id", "num", "horse_id", price.alias("price"))


@racing_query("param_cap", "SELECT race_id FROM races ORDER BY race_id LIMIT 1000", limit=5000)
def capped(r: Racing, limit: int) -> DataFrame:
    return r.races.select("race_id").orderBy("race_id").limit(page_size(limit))


@racing_query("param_date", "SELECT count(*) AS races FROM races WHERE race_date = DATE '1999-05-05'", on="1999-05-05")
def dated_count(r: Racing, on: str) -> DataFrame:
    return r.races.where(F.col("race_date") == F.lit(day(on))).agg(F.count("*").alias("races"))


@racing_query(
    "course_meetings",
    "SELECT race_date, course_id, count(*) AS races, min(off_min) AS first_off, max(off_min) AS last_off, CAST(sum(ran) AS BIGINT) AS runners, md5(concat_ws('|', CAST(race_date AS VARCHAR), CAST(course_id AS VARCHAR))) AS meeting_key FROM races WHERE course_id = 7 AND race_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' GROUP BY 1, 2",
    course_id=7,
    date_from="1999-01-01",
    date_to="1999-12-31",
)
def course_meetings(r: Racing, course_id: int, date_from: str, date_to: str) -> DataFrame:
    """Race days of a course with their key."""
    rows = r.races.where((F.col("course_id") == course_id) & F.col("race_date").between(F.lit(day(date_from)), F.lit(day(date_to))))
    out = rows.groupBy("race_date", "course_id").agg(F.count("*").alias("races"), F.min("off_min").alias("first_off"), F.max("off_min").alias("last_off"), F.sum("ran").alias("runners"))
    return out.withColumn("meeting_key", F.md5(F.concat_ws("|", F.col("race_date").cast("string"), F.col("course_id").cast("string")))).orderBy(F.desc("race_date"))


def meetings(r: Racing, on: str) -> DataFrame:
    """A day's meetings, nested: course -> races in order of time -> runners. Null course is -1."""
    races = r.races.where(F.col("race_date") == F.lit(day(on)))
    runners = r.runners.join(races.select("race_id"), "race_id").groupBy("race_id").agg(F.sort_array(F.collect_list(F.struct("num", "horse_id", "trainer_id", "jockey_id", "pos_num"))).alias("runners"))
    rows = races.join(runners, "race_id", "left").withColumn("course_id", F.coalesce("course_id", F.lit(-1)))
    race = F.struct("off_min", "race_id", "race_name", "race_type", "ran", "runners")
    out = rows.groupBy("course_id").agg(F.sort_array(F.collect_list(race)).alias("races"), F.min("off_min").alias("first_off"), F.max("off_min").alias("last_off"), F.array_join(F.sort_array(F.collect_set("race_type")), ", ").alias("types"))
    return out.join(r.courses.select("course_id", "course_name"), "course_id", "left")


@racing_query(
    "meetings_nested",
    """
SELECT coalesce(course_id, -1) AS course_id, min(off_min) AS first_off, max(off_min) AS last_off, array_to_string(list_sort(list_distinct(list(race_type))), ', ') AS types, count(*) AS n_races, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_runners, course_name,
  string_agg(CAST(race_id AS VARCHAR), ',' ORDER BY off_min, race_id) AS race_ids
FROM races LEFT JOIN (SELECT race_id, count(*) AS n FROM runners GROUP BY 1) USING (race_id) LEFT JOIN courses USING (course_id) WHERE race_date = DATE '1999-05-05' GROUP BY 1, course_name""",
    on="1999-05-05",
)
def meetings_digest(r: Racing, on: str) -> DataFrame:
    """The nested meetings, with arrays told by their sizes and ids."""
    m = meetings(r, on)
    sizes = F.aggregate(F.transform("races", lambda x: F.coalesce(F.size(x["runners"]), F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("course_id", "first_off", "last_off", "types", F.size("races").cast("long").alias("n_races"), sizes.alias("n_runners"), "course_name", F.array_join(F.transform("races", lambda x: x["race_id"].cast("string")), ",").alias("race_ids"))
