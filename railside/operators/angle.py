"""The near-miss angle: today's qualifiers, the back-test over the last-next snapshot, its summary."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railside.functions.columns import count_where
from railside.plans.months import in_months, stored
from railside.plans.racing import Racing, read_by
from railside.registry import racing_query

_RUN_ORDER = ["race_date", "race_id", "num", "trainer_id", "win_bsp"]
_ORDER_SQL = "race_date, race_id, num, trainer_id, win_bsp"


def runs_with_races(r: Racing) -> DataFrame:
    return r.runners.join(r.races, "race_id")


#: What is told of a run as the last one, and of the one that follows.
_LAST = {"last_race_id": "race_id", "last_date": "race_date", "last_pos": "pos_num", "last_btn": "btn", "last_or": "official", "last_race_type": "race_type", "last_class": "class", "last_dist_f": "dist_f", "last_surface": "surface", "last_going": "going", "last_course_id": "course_id"}
_NEXT = {"next_race_id": "race_id", "next_date": "race_date", "next_pos": "pos_num", "next_win": "win_flag", "next_or": "official", "next_bsp": "win_bsp", "next_dec": "dec_price", "next_ppwap": "win_ppwap", "next_dist_f": "dist_f", "next_surface": "surface"}


def _raw_runs(r: Racing) -> tuple[DataFrame, dict[str, str]]:
    """Runners with their races as the files hold them, and the columns of both as expressions over that."""
    (races, a), (runners, b) = r.raw("races"), r.raw("runners")
    race, runner = a["race_id"].strip("`"), b["race_id"].strip("`")
    rows = r.with_races(runners, races.withColumnRenamed(race, runner), runner)
    return rows, {c: e.replace(race, runner) for c, e in a.items()} | b


def _pairs(r: Racing) -> tuple[DataFrame, dict[str, str]]:
    """Each completed run with the horse's next as ``n``, both as the files hold them: what is shuffled and stored."""
    rows, columns = _raw_runs(r)
    rows = rows.select(*read_by(rows, columns, "horse_id", *_RUN_ORDER, *_LAST.values(), *_NEXT.values())).where(F.expr(columns["pos_num"]).isNotNull())
    w = Window.partitionBy(F.expr(columns["horse_id"])).orderBy(*[F.expr(columns[c]) for c in _RUN_ORDER])
    following = F.lead(F.struct(*read_by(rows, columns, *_NEXT.values()))).over(w)
    return r.dealt(rows, columns["horse_id"].strip("`")).withColumn("n", following).where("n is not null"), columns


def _told(pairs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of both runs of a pair."""
    last = pairs.select(F.expr(columns["horse_id"]).alias("last_horse_id"), *[F.expr(columns[c]).alias(name) for name, c in _LAST.items()], "n")
    both = last.select("last_horse_id", *_LAST, "n.*")
    out = both.select(F.col("last_horse_id").alias("horse_id"), *_LAST, *[F.expr(columns[c]).alias(name) for name, c in _NEXT.items()])
    return out.withColumn("dsr_next", F.datediff("next_date", "last_date"))


def last_next(r: Racing) -> DataFrame:
    """Each completed run with the horse's next: one lead over a struct, so that ties stay together."""
    return _told(*_pairs(r))


_LAST_NEXT = f"""
WITH o AS (SELECT *, lead(struct_pack(race_id, race_date, pos_num, win_flag, official, win_bsp, dec_price, win_ppwap, dist_f, surface)) OVER (PARTITION BY horse_id ORDER BY {_ORDER_SQL}) AS n FROM runners JOIN races USING (race_id) WHERE pos_num IS NOT NULL),
ln AS (SELECT horse_id, race_id AS last_race_id, race_date AS last_date, pos_num AS last_pos, btn AS last_btn, official AS last_or, race_type AS last_race_type, class AS last_class, dist_f AS last_dist_f, surface AS last_surface, n.race_id AS next_race_id, n.race_date AS next_date, n.pos_num AS next_pos, n.win_flag AS next_win, n.official AS next_or,
  date_diff('day', race_date, n.race_date) AS dsr_next, n.win_bsp AS next_bsp, n.dec_price AS next_dec, n.dist_f AS next_dist_f, n.surface AS next_surface FROM o WHERE n IS NOT NULL)"""
_LAST_NEXT = _LAST_NEXT.replace("struct_pack(race_id, race_date, pos_num, win_flag, official, win_bsp, dec_price, win_ppwap, dist_f, surface)", "struct_pack(" + ", ".join(f"{c} := {c}" for c in ("race_id", "race_date", "pos_num", "win_flag", "official", "win_bsp", "dec_price", "win_ppwap", "dist_f", "surface")) + ")")


@racing_query("w_lead_next", _LAST_NEXT + " SELECT horse_id, last_race_id, last_date, last_pos, next_race_id, next_date, next_pos, next_win, CAST(dsr_next AS INT) AS dsr_next FROM ln")
def lead_next(r: Racing) -> DataFrame:
    return last_next(r).select("horse_id", "last_race_id", "last_date", "last_pos", "next_race_id", "next_date", "next_pos", "next_win", "dsr_next")


def _near_miss(last: str, following: str, *, last_pos: int, btn_max: float, dsr: Column, dsr_max: int, or_delta_max: int, tolerance: float, same_surface: bool, include_null_or: bool, null_distance: bool) -> Column:
    """The angle's conditions. A null beaten distance never qualifies, nor does a null last rating;
    ``include_null_or`` lets a null next rating through. Null distances count as 0 if ``null_distance``."""
    a, b = F.col(f"{last}or"), F.col(f"{following}or")
    far, near = F.col(f"{following}dist_f"), F.col(f"{last}dist_f")
    if null_distance:
        far, near = F.coalesce(far, F.lit(0.0)), F.coalesce(near, F.lit(0.0))
    out = (F.col(f"{last}pos") == last_pos) & (F.coalesce(f"{last}btn", F.lit(99.0)) <= btn_max) & (dsr <= dsr_max) & (F.coalesce(b, a) - a <= or_delta_max) & (F.abs(far - near) <= tolerance)
    if not include_null_or:
        out = out & a.isNotNull() & b.isNotNull()
    return out & (F.col(f"{following}surface") == F.col(f"{last}surface")) if same_surface else out


_PAST_WHERE = "last_pos = 2 AND coalesce(last_btn, 99.0) <= 3 AND dsr_next <= 400 AND last_or IS NOT NULL AND next_or IS NOT NULL AND next_or - last_or <= 5 AND abs(next_dist_f - last_dist_f) <= 4 AND next_surface = last_surface AND last_date >= DATE '1996-01-01' AND last_date <= DATE '2000-12-31'"
_PAST = dict(date_from="1996-01-01", date_to="2000-12-31", dsr_max=400, or_delta_max=5, dist_f_tolerance=4.0, limit=200)


@racing_query(
    "near_miss_past",
    _LAST_NEXT + f" SELECT horse_name, horse_id, last_race_id, last_date, last_pos, round(last_btn, 4) AS last_btn, last_or, next_race_id, next_date, next_pos, next_win, next_or, CAST(dsr_next AS INT) AS dsr, next_or - last_or AS rating_change, abs(next_dist_f - last_dist_f) AS dist_f_diff, next_surface = last_surface AS same_surface, round(next_bsp, 4) AS price FROM ln JOIN horses USING (horse_id) WHERE {_PAST_WHERE} ORDER BY last_date DESC, horse_id, last_race_id, next_race_id, next_bsp LIMIT 200",
    **_PAST,
)
def near_miss_past(r: Racing, date_from: str | None = None, date_to: str | None = None, race_type: str | None = None, last_pos: int = 2, btn_max: float = 3.0, dsr_max: int = 14, or_delta_max: int = 0, dist_f_tolerance: float = 1.0, same_surface: bool = True, include_null_or: bool = False, require_next_win: bool = False, price_source: str = "bsp", limit: int = 200, offset: int = 0) -> DataFrame:
    """Past cases of the angle with the next run's result and price; an unknown price source gives null.

    Last and next runs are stored by month of the last one: the lead over each horse's runs is taken
    once for the files there are, and a range of days reads its months.
    """
    pairs, columns = _pairs(r)
    rows = _told(in_months(stored(r, "last_next", ["races", "runners"], lambda: pairs, F.expr(columns["race_date"])), "row_month", date_from, date_to), columns)
    if date_from:
        rows = rows.where(F.col("last_date") >= F.lit(date.fromisoformat(date_from)))
    if date_to:
        rows = rows.where(F.col("last_date") <= F.lit(date.fromisoformat(date_to)))
    if race_type:
        rows = rows.where(F.col("last_race_type") == race_type)
    rows = rows.where(_near_miss("last_", "next_", last_pos=last_pos, btn_max=btn_max, dsr=F.col("dsr_next"), dsr_max=dsr_max, or_delta_max=or_delta_max, tolerance=dist_f_tolerance, same_surface=same_surface, include_null_or=include_null_or, null_distance=False))
    if require_next_win:
        rows = rows.where("next_win")
    price = {"bsp": F.col("next_bsp"), "dec": F.col("next_dec"), "ppwap": F.col("next_ppwap")}.get(price_source, F.lit(None).cast("double"))
    rows = rows.join(r.horses.select("horse_id", "horse_name"), "horse_id").orderBy(F.desc("last_date"), "horse_id", "last_race_id", "next_race_id", "next_bsp").offset(offset).limit(limit)
    return rows.select("horse_name", "horse_id", "last_race_id", "last_date", "last_pos", F.round("last_btn", 4).alias("last_btn"), "last_or", "next_race_id", "next_date", "next_pos", "next_win", "next_or", F.col("dsr_next").alias("dsr"), (F.col("next_or") - F.col("last_or")).alias("rating_change"), F.abs(F.col("next_dist_f") - F.col("last_dist_f")).alias("dist_f_diff"), (F.col("next_surface") == F.col("last_surface")).alias("same_surface"), F.round(price, 4).alias("price"))


@racing_query(
    "angle_summary",
    _LAST_NEXT + f", page AS (SELECT next_win, round(next_bsp, 4) AS price FROM ln WHERE {_PAST_WHERE} ORDER BY last_date DESC, horse_id, last_race_id, next_race_id, next_bsp LIMIT 200) SELECT count(*) AS n, count(*) FILTER (next_win) AS wins, round(count(*) FILTER (next_win) / count(*)::DOUBLE, 6) AS win_rate, round(avg(CASE WHEN next_win THEN price - 1 ELSE -1 END) FILTER (price > 0), 6) AS roi FROM page",
    **_PAST,
)
def angle_summary(r: Racing, **params) -> DataFrame:
    """Cases, wins, win rate and level-stakes return of the page that ``near_miss_past`` returns."""
    page = near_miss_past(r, **params)
    gain = F.when(F.col("price") > 0, F.when(F.col("next_win"), F.col("price") - 1).otherwise(-1.0))
    return page.agg(F.count("*").alias("n"), count_where(F.col("next_win")).alias("wins"), F.round(F.avg(F.col("next_win").cast("double")), 6).alias("win_rate"), F.round(F.avg(gain), 6).alias("roi"))


_TODAY_SQL = f"""
WITH e AS (SELECT horse_id, official AS next_or, race_id AS next_race_id, race_date AS next_date, dist_f AS next_dist_f, surface AS next_surface, num FROM runners JOIN races USING (race_id) WHERE race_date BETWEEN DATE '2001-03-01' AND DATE '2001-05-31' AND pos_raw IS NULL),
l AS (SELECT horse_id, race_id AS last_race_id, race_date AS last_date, pos_num AS last_pos, btn AS last_btn, official AS last_or, dist_f AS last_dist_f, surface AS last_surface, row_number() OVER (PARTITION BY horse_id ORDER BY race_date DESC, race_id DESC, num DESC, trainer_id DESC, win_bsp DESC) AS rn FROM runners JOIN races USING (race_id) WHERE pos_num IS NOT NULL AND race_date < DATE '2001-03-01')
"""


@racing_query(
    "j_last_run_asof",
    _TODAY_SQL + "SELECT e.horse_id, next_race_id, num, last_race_id, last_date, last_pos, CAST(date_diff('day', last_date, next_date) AS INT) AS dsr FROM e JOIN l USING (horse_id) WHERE rn = 1",
    on="2001-03-01",
    until="2001-05-31",
)
def last_run_asof(r: Racing, on: str, until: str | None = None) -> DataFrame:
    """Racecard entries with the horse's last completed run before the day: the semantic as-of join.

    The last run is one row per horse by a partial maximum, not a window over all runs.
    """
    return _entries_with_last(r, on, until).select("horse_id", "next_race_id", "num", "last_race_id", "last_date", "last_pos", F.datediff("next_date", "last_date").alias("dsr"))


def _entries_with_last(r: Racing, on: str, until: str | None = None, race_type: str | None = None) -> DataFrame:
    first, last = date.fromisoformat(on), date.fromisoformat(until or on)
    races = r.races.where(F.col("race_date").between(F.lit(first), F.lit(last)))
    if race_type:
        races = races.where(F.col("race_type") == race_type)
    entries = r.runners.where("pos_raw is null").join(races, "race_id").select("horse_id", F.col("official").alias("next_or"), F.col("race_id").alias("next_race_id"), F.col("race_date").alias("next_date"), F.col("dist_f").alias("next_dist_f"), F.col("surface").alias("next_surface"), "num")
    done = r.runners.where("pos_num is not null").join(r.races.where(F.col("race_date") < F.lit(first)), "race_id")
    done = done.join(entries.select("horse_id").distinct(), "horse_id", "left_semi")
    newest = F.max(F.struct(*[F.col(c) for c in _RUN_ORDER], "pos_num", "btn", "official", "dist_f", "surface", "class")).alias("l")
    before = done.groupBy("horse_id").agg(newest)
    before = before.select("horse_id", F.col("l.race_id").alias("last_race_id"), F.col("l.race_date").alias("last_date"), F.col("l.pos_num").alias("last_pos"), F.col("l.btn").alias("last_btn"), F.col("l.official").alias("last_or"), F.col("l.dist_f").alias("last_dist_f"), F.col("l.surface").alias("last_surface"), F.col("l.class").alias("last_class"))
    return entries.join(before, "horse_id")


@racing_query(
    "near_miss_today",
    _TODAY_SQL
    + """SELECT horse_id, horse_name, next_race_id, next_date, next_or, last_race_id, last_date, last_pos, round(last_btn, 4) AS last_btn, last_or, CAST(date_diff('day', last_date, next_date) AS INT) AS dsr, coalesce(next_or, 0) - coalesce(last_or, 0) AS rating_change, abs(coalesce(next_dist_f, 0) - coalesce(last_dist_f, 0)) AS dist_f_diff, next_surface = last_surface AS same_surface
FROM e JOIN l USING (horse_id) JOIN horses USING (horse_id)
WHERE rn = 1 AND last_pos = 2 AND coalesce(last_btn, 99) <= 4 AND date_diff('day', last_date, next_date) <= 400 AND last_or IS NOT NULL AND coalesce(next_or, last_or) - last_or <= 20 AND abs(next_dist_f - last_dist_f) <= 8
ORDER BY next_date, next_race_id, horse_name, num, next_or LIMIT 200""",
    on="2001-03-01",
    until="2001-05-31",
    btn_max=4.0,
    dsr_max=400,
    or_delta_max=20,
    dist_f_tolerance=8.0,
    same_surface=False,
    include_null_or=True,
)
def near_miss_today(r: Racing, on: str, until: str | None = None, race_type: str | None = None, last_pos: int = 2, btn_max: float = 3.0, dsr_max: int = 14, or_delta_max: int = 0, dist_f_tolerance: float = 1.0, same_surface: bool = True, include_null_or: bool = False, limit: int = 200, offset: int = 0) -> DataFrame:
    """Entries on a day (or to ``until``) whose last run was a near miss; defaults are the report's."""
    rows = _entries_with_last(r, on, until, race_type)
    dsr = F.datediff("next_date", "last_date")
    rows = rows.where(_near_miss("last_", "next_", last_pos=last_pos, btn_max=btn_max, dsr=dsr, dsr_max=dsr_max, or_delta_max=or_delta_max, tolerance=dist_f_tolerance, same_surface=same_surface, include_null_or=include_null_or, null_distance=True))
    zero = F.lit(0)
    rows = rows.join(r.horses.select("horse_id", "horse_name"), "horse_id").orderBy("next_date", "next_race_id", "horse_name", "num", "next_or").offset(offset).limit(limit)
    return rows.select("horse_id", "horse_name", "next_race_id", "next_date", "next_or", "last_race_id", "last_date", "last_pos", F.round("last_btn", 4).alias("last_btn"), "last_or", dsr.alias("dsr"), (F.coalesce("next_or", zero) - F.coalesce("last_or", zero)).alias("rating_change"), F.abs(F.coalesce("next_dist_f", F.lit(0.0)) - F.coalesce("last_dist_f", F.lit(0.0))).alias("dist_f_diff"), (F.col("next_surface") == F.col("last_surface")).alias("same_surface"))
