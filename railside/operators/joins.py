"""Joins of the warehouse: star, semi and anti, range, band, best score, linkage of two feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railside.functions.text import jaro_winkler, jaro_winkler_bound, letter_counts, match_name, norm_text
from railside.plans.racing import Racing, with_racing
from railside.registry import racing_query, table_query


@racing_query("j_inner_star", "SELECT race_id, num, course_name, horse_name FROM runners JOIN races USING (race_id) JOIN courses USING (course_id) JOIN horses USING (horse_id) WHERE race_date = DATE '1999-05-05'", on="1999-05-05")
def inner_star(r: Racing, on: str) -> DataFrame:
    races = r.races.where(F.col("race_date") == F.lit(on).cast("date"))
    return r.runners.join(races, "race_id").join(r.courses, "course_id").join(r.horses, "horse_id").select("race_id", "num", "course_name", "horse_name")


@racing_query("j_left_dims", "SELECT race_id, num, horse_name, trainer_name, jockey_name FROM runners LEFT JOIN horses USING (horse_id) LEFT JOIN trainers USING (trainer_id) LEFT JOIN jockeys USING (jockey_id)")
def left_dims(r: Racing) -> DataFrame:
    return r.runners.join(r.horses, "horse_id", "left").join(r.trainers, "trainer_id", "left").join(r.jockeys, "jockey_id", "left").select("race_id", "num", "horse_name", "trainer_name", "jockey_name")


@racing_query("j_left_filtered", "SELECT races.race_id, count(ru.race_id) AS winners FROM races LEFT JOIN runners ru ON ru.race_id = races.race_id AND ru.pos_num = 1 GROUP BY 1")
def left_filtered(r: Racing) -> DataFrame:
    """A condition in the join's ON is a filter of the right side alone."""
    winners = r.runners.where("pos_num = 1").groupBy("race_id").agg(F.count("*").alias("winners"))
    return r.races.join(winners, "race_id", "left").select("race_id", F.coalesce("winners", F.lit(0).cast("long")).alias("winners"))


@racing_query("j_using", "SELECT race_id, num, race_date FROM runners JOIN races USING (race_id) WHERE num = 3")
def using(r: Racing) -> DataFrame:
    return r.runners.where("num = 3").join(r.races, "race_id").select("race_id", "num", "race_date")


@racing_query("j_left_anti", "SELECT race_id FROM races WHERE NOT EXISTS (SELECT 1 FROM runners WHERE runners.race_id = races.race_id)")
def without_runners(r: Racing) -> DataFrame:
    return r.races.join(r.runners.select("race_id"), "race_id", "left_anti").select("race_id")


@racing_query("j_not_in", "SELECT DISTINCT horse_id FROM runners WHERE horse_id NOT IN (SELECT horse_id FROM horses WHERE horse_id % 50 <> 0)")
def orphans(r: Racing) -> DataFrame:
    """Ids without a dimension row; the dimension's key is not null, so an anti join says the same."""
    return r.runners.select("horse_id").distinct().join(r.horses.where("horse_id % 50 <> 0").select("horse_id"), "horse_id", "left_anti")


@racing_query("j_exists", "SELECT race_id, race_date FROM races WHERE EXISTS (SELECT 1 FROM runners WHERE runners.race_id = races.race_id AND pos_num = 7)")
def with_seventh(r: Racing) -> DataFrame:
    return r.races.join(r.runners.where("pos_num = 7").select("race_id"), "race_id", "left_semi").select("race_id", "race_date")


@racing_query("j_in_subquery", "SELECT race_id, num, horse_id FROM runners WHERE race_id IN (SELECT race_id FROM races WHERE race_date = DATE '1999-05-05')", on="1999-05-05")
def in_scope(r: Racing, on: str) -> DataFrame:
    return r.runners.join(r.races.where(F.col("race_date") == F.lit(on).cast("date")).select("race_id"), "race_id", "left_semi").select("race_id", "num", "horse_id")


@racing_query(
    "j_self_range",
    """
WITH d AS (SELECT DISTINCT horse_id, trainer_id, race_date FROM runners JOIN races USING (race_id))
SELECT DISTINCT a.horse_id, a.trainer_id AS old_id, b.trainer_id AS new_id FROM d a JOIN d b ON a.horse_id = b.horse_id AND b.race_date > a.race_date AND b.trainer_id <> a.trainer_id
WHERE NOT EXISTS (SELECT 1 FROM d c WHERE c.horse_id = a.horse_id AND c.race_date > a.race_date AND c.race_date < b.race_date)""",
)
def next_trainers(r: Racing) -> DataFrame:
    """A horse's trainers on consecutive race days: the range self-join as a lead over days.

    Runs are dealt by race, then by horse, and stay so: days, their order and the last distinct are by horse.
    """
    runs = r.with_races(r.runners.select("race_id", "horse_id", "trainer_id"), r.races.select("race_id", "race_date"))
    days = r.dealt(runs.drop("race_id"), "horse_id").groupBy("horse_id", "race_date").agg(F.collect_set("trainer_id").alias("ts"))
    w = Window.partitionBy("horse_id").orderBy("race_date")
    both = days.withColumn("after", F.lead("ts").over(w)).where("after is not null")
    pairs = both.select("horse_id", F.explode("ts").alias("old_id"), "after").select("horse_id", "old_id", F.explode("after").alias("new_id"))
    return pairs.where("old_id <> new_id").distinct()


@racing_query("j_mv_lookup", "SELECT a.horse_id, a.race_id, b.race_name FROM runners a JOIN races b ON a.race_id = b.race_id WHERE a.num = 2 AND b.surface = 'AW'")
def snapshot_lookup(r: Racing) -> DataFrame:
    return r.runners.where("num = 2").join(r.races.where("surface = 'AW'"), "race_id").select("horse_id", "race_id", "race_name")


@racing_query("j_scalar_corr", "SELECT race_id, (SELECT count(*) FROM runners WHERE runners.race_id = races.race_id) AS n, (SELECT max(win_bsp) FROM runners WHERE runners.race_id = races.race_id) AS longest FROM races")
def scalar_lookups(r: Racing) -> DataFrame:
    """Correlated scalars as one aggregate joined once."""
    sums = r.runners.groupBy("race_id").agg(F.count("*").alias("n"), F.max("win_bsp").alias("longest"))
    return r.races.join(sums, "race_id", "left").select("race_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "longest")


@racing_query("j_norm_lookup", r"SELECT f.horse_id AS feed_id, h.horse_id FROM (SELECT horse_id, trim(regexp_replace(lower(concat(' ', upper(replace(horse_name, ' ', '-')), '.')), '[^a-z0-9]+', ' ', 'g')) AS k FROM horses) f JOIN (SELECT horse_id, trim(regexp_replace(lower(horse_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM horses) h USING (k)")
def normalised_lookup(r: Racing) -> DataFrame:
    """Names as a feed spells them, found by equal normalised names; each side is normalised once."""
    spelt = F.concat(F.lit(" "), F.upper(F.regexp_replace("horse_name", " ", "-")), F.lit("."))
    feed = r.horses.select(F.col("horse_id").alias("feed_id"), F.trim(F.regexp_replace(norm_text(spelt), " +", " ")).alias("k"))
    known = r.horses.select("horse_id", F.trim(F.regexp_replace(norm_text(F.col("horse_name")), " +", " ")).alias("k"))
    return feed.join(known, "k").select("feed_id", "horse_id")


@racing_query("j_composite", "SELECT a.horse_id AS a, b.horse_id AS b FROM horses a JOIN horses b USING (sire, dam, damsire) WHERE a.horse_id < b.horse_id")
def same_blood(r: Racing) -> DataFrame:
    """All pairs of horses of equal sire, dam and damsire, the smaller id first; pairs are as many as there are, streamed by the join."""
    a = r.horses.select(F.col("horse_id").alias("a"), "sire", "dam", "damsire")
    b = r.horses.select(F.col("horse_id").alias("b"), "sire", "dam", "damsire")
    # merged, not broadcast: pairs are made by as many tasks as the keys are dealt to
    return a.join(b.hint("merge"), ["sire", "dam", "damsire"]).where("a < b").select("a", "b")


def outer_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both feeds by key: unmatched ones of either side stay."""
    return left.join(right, keys, "full_outer")


@racing_query("j_full_outer_runner", "SELECT coalesce(a.race_id, b.race_id) AS race_id, coalesce(a.horse_id, b.horse_id) AS horse_id, p, q FROM (SELECT race_id, horse_id, min(pos_num) AS p FROM runners WHERE num <= 4 GROUP BY 1, 2) a FULL JOIN (SELECT race_id, horse_id, max(win_bsp) AS q FROM runners WHERE num >= 3 GROUP BY 1, 2) b ON a.race_id = b.race_id AND a.horse_id = b.horse_id")
def full_outer_runners(r: Racing) -> DataFrame:
    results = r.runners.where("num <= 4").groupBy("race_id", "horse_id").agg(F.min("pos_num").alias("p"))
    prices = r.runners.where("num >= 3").groupBy("race_id", "horse_id").agg(F.max("win_bsp").alias("q"))
    return outer_by_key(results, prices, ["race_id", "horse_id"]).select("race_id", "horse_id", "p", "q")


@racing_query("j_left_win_place", "SELECT race_id, horse_id, w, p FROM (SELECT race_id, horse_id, max(win_bsp) AS w FROM runners GROUP BY 1, 2) LEFT JOIN (SELECT race_id, horse_id, arg_max(place_bsp, (num, place_bsp)) AS p FROM runners WHERE num % 2 = 0 GROUP BY 1, 2) USING (race_id, horse_id)")
def win_with_place(r: Racing) -> DataFrame:
    """WIN rows with the last PLACE row of the same race and horse."""
    win = r.runners.groupBy("race_id", "horse_id").agg(F.max("win_bsp").alias("w"))
    place = r.runners.where("num % 2 = 0").groupBy("race_id", "horse_id").agg(F.max_by("place_bsp", F.struct("num", "place_bsp")).alias("p"))
    return win.join(place, ["race_id", "horse_id"], "left")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: Column, b: Column, width: int) -> DataFrame:
    """Pairs with equal keys and |a - b| <= width, integers, without comparing all pairs of a key.

    Both sides fall into buckets of ``width``; the left also visits the buckets beside its own, so an
    equi-join on the bucket finds every pair once.
    """
    bucket = F.floor(a / width)
    left = left.withColumn("_a", a).withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    right = right.withColumn("_b", b).withColumn("_bucket", F.floor(b / width))
    return left.join(right, [*keys, "_bucket"]).where(F.abs(F.col("_a") - F.col("_b")) <= width).drop("_a", "_b", "_bucket")


_FEEDS = """
WITH a AS (SELECT event_id AS a_id, user_id, CAST(ts AS DATE) AS d, date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS m, value AS v FROM events WHERE event_type = 'click'),
b AS (SELECT event_id AS b_id, user_id, CAST(ts AS DATE) AS d, date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) AS m, value AS w FROM events WHERE event_type = 'view')"""


def _feeds(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two feeds that name the same things: events of two types, by minute."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    minute = F.floor((F.unix_timestamp(F.date_trunc("minute", "ts")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 60).cast("long")
    rows = e.select("event_id", "user_id", F.to_date("ts").alias("d"), minute.alias("m"), "value", "event_type")
    a = rows.where("event_type = 'click'").select(F.col("event_id").alias("a_id"), "user_id", "d", "m", F.col("value").alias("v"))
    b = rows.where("event_type = 'view'").select(F.col("event_id").alias("b_id"), "user_id", "d", F.col("m").alias("bm"), F.col("value").alias("w"))
    return a, b


@table_query("j_band_10min", _FEEDS + " SELECT a_id, b_id, abs(a.m - b.m) AS gap FROM a JOIN b ON a.d = b.d AND abs(a.m - b.m) <= 10")
def band_10min(spark, sf_dir: str) -> DataFrame:
    """Candidate pairs of one day at most ten minutes apart."""
    a, b = _feeds(spark, sf_dir)
    return band_join(a, b, ["d"], F.col("m"), F.col("bm"), 10).select("a_id", "b_id", F.abs(F.col("m") - F.col("bm")).alias("gap"))


@table_query("j_band_1min", _FEEDS + " SELECT a_id, min(CASE WHEN b.m = a.m THEN b_id END) AS exact_id, coalesce(min(CASE WHEN b.m = a.m THEN b_id END), min(CASE WHEN b.m = a.m - 1 THEN b_id END), min(CASE WHEN b.m = a.m + 1 THEN b_id END)) AS b_id FROM a LEFT JOIN b ON a.d = b.d AND abs(a.m - b.m) <= 1 GROUP BY a_id")
def band_1min(spark, sf_dir: str) -> DataFrame:
    """The exact minute first, then the minute before, then the one after: one join on variants."""
    a, b = _feeds(spark, sf_dir)
    variants = a.select("a_id", "d", F.posexplode(F.array(F.col("m"), F.col("m") - 1, F.col("m") + 1)).alias("rank", "bm"))
    found = variants.join(b.select("b_id", "d", "bm"), ["d", "bm"], "left").groupBy("a_id").agg(F.min(F.when(F.col("rank") == 0, F.col("b_id"))).alias("exact_id"), F.min(F.when(F.col("b_id").isNotNull(), F.struct("rank", "b_id"))).alias("best"))
    return found.select("a_id", "exact_id", F.col("best.b_id").alias("b_id"))


_SCORED = _FEEDS + ", s AS (SELECT a_id, b_id, abs(a.m - b.m) AS gap, CAST(CASE WHEN a.user_id = b.user_id THEN 2 ELSE 0 END + CASE WHEN abs(v - w) < 5 THEN 1 ELSE 0 END + CASE WHEN abs(a.m - b.m) <= 2 THEN 1 ELSE 0 END AS INT) AS score FROM a JOIN b ON a.d = b.d AND abs(a.m - b.m) <= 10)"


#: Numbers of one rank, more than there are 64-bit ids.
_RANK = "20000000000000000000"


def _gap_and_score() -> tuple[Column, Column]:
    gap = F.abs(F.col("m") - F.col("bm"))
    return gap, F.when(F.col("user_id") == F.col("b_user"), 2).otherwise(0) + F.when(F.abs(F.col("v") - F.col("w")) < 5, 1).otherwise(0) + F.when(gap <= 2, 1).otherwise(0)


def _scored(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = _feeds(spark, sf_dir)
    pairs = band_join(a, b.withColumnRenamed("user_id", "b_user"), ["d"], F.col("m"), F.col("bm"), 10)
    gap, score = _gap_and_score()
    return a, pairs.select("a_id", "b_id", gap.alias("gap"), score.alias("score"))


@table_query("j_best_score", _SCORED + " SELECT a_id, b_id, score FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, gap, b_id) AS rn FROM s) WHERE rn = 1 AND score >= 2")
def best_score(spark, sf_dir: str, least: int = 2) -> DataFrame:
    """The best match of each left row, if good enough.

    Pairs of score 2 or more are of one user, or at most two minutes and less than 5 in value apart: two equi-joins
    find these alone (all pairs are compared if less will do). Score, gap and id become one number, so that the best is a hashed minimum and
    no pair is sorted.
    """
    a, b = _feeds(spark, sf_dir)
    b = b.withColumnRenamed("user_id", "b_user")
    same = band_join(a, b.withColumn("user_id", F.col("b_user")), ["d", "user_id"], F.col("m"), F.col("bm"), 10)
    cell = lambda x: F.floor(F.col(x) / 6)  # noqa: E731  wider than 5, so that rounding moves no value two cells
    left = a.withColumn("bm", F.explode(F.sequence(F.col("m") - 2, F.col("m") + 2))).withColumn("cell", F.explode(F.array(cell("v") - 1, cell("v"), cell("v") + 1)))
    near = left.join(b.withColumn("cell", cell("w")), ["d", "bm", "cell"]).where(F.abs(F.col("v") - F.col("w")) < 5)
    names = ["a_id", "user_id", "m", "v", "b_id", "b_user", "bm", "w"]
    gap, score = _gap_and_score()
    found = same.select(*names).unionByName(near.select(*names)) if least >= 2 else band_join(a, b, ["d"], F.col("m"), F.col("bm"), 10)
    found = found.where(score >= least)
    wide = F.lit(_RANK).cast("decimal(20,0)")
    rank = (100 - score * 16 + gap).cast("decimal(10,0)")
    best = found.groupBy("a_id").agg(F.min(rank * wide + F.col("b_id").cast("decimal(20,0)")).alias("x"))
    best = best.withColumn("r", F.floor(F.col("x") / wide + 0.5).cast("long"))
    # a gap is at most 10: 16 ranks a score
    return best.select("a_id", (F.col("x") - F.col("r").cast("decimal(10,0)") * wide).cast("long").alias("b_id"), F.ceil((100 - F.col("r")) / 16).cast("int").alias("score"))


@table_query("unmatched_report", _SCORED + ", m AS (SELECT a_id, max(score) AS best FROM s GROUP BY a_id) SELECT a_id, best, CASE WHEN best IS NULL THEN 'no candidate' WHEN best < 1 THEN 'nothing in common' ELSE 'score below threshold' END AS reason FROM a LEFT JOIN m USING (a_id) WHERE best IS NULL OR best < 2")
def unmatched_report(spark, sf_dir: str, least: int = 2) -> DataFrame:
    """Left rows without an accepted match, with the reason and the best score."""
    a, pairs = _scored(spark, sf_dir)
    rows = a.select("a_id").join(pairs.groupBy("a_id").agg(F.max("score").alias("best")), "a_id", "left")
    reason = F.when(F.col("best").isNull(), "no candidate").when(F.col("best") < 1, "nothing in common").otherwise("score below threshold")
    return rows.where(F.col("best").isNull() | (F.col("best") < least)).select("a_id", "best", reason.alias("reason"))


@racing_query(
    "j_market_to_race",
    """
WITH m AS (SELECT race_id AS market_id, race_date, course_id, off_min + CAST(race_id % 3 AS INT) AS market_min FROM races),
c AS (SELECT market_id, race_id, abs(market_min - off_min) AS gap FROM m JOIN races USING (race_date, course_id) WHERE abs(market_min - off_min) <= 1),
b AS (SELECT market_id, arg_min(race_id, (gap, race_id)) AS race_id FROM c GROUP BY market_id),
s AS (SELECT DISTINCT race_id AS market_id, 1000 + horse_id AS selection_id, horse_name AS name FROM runners JOIN horses USING (horse_id)),
r AS (SELECT DISTINCT race_id, horse_id, horse_name AS name FROM runners JOIN horses USING (horse_id))
SELECT b.market_id, b.race_id, selection_id, horse_id FROM b JOIN s USING (market_id) LEFT JOIN r ON r.race_id = b.race_id AND r.name = s.name""",
)
def market_to_race(r: Racing) -> DataFrame:
    """Markets to races by venue and time, a minute's difference allowed, the nearest first; then selections to runners by name.

    A selection without a runner of its name in the race has a null runner.
    """
    markets = r.races.select(F.col("race_id").alias("market_id"), "race_date", "course_id", (F.col("off_min") + (F.col("race_id") % 3).cast("int")).alias("market_min"))
    pairs = band_join(markets, r.races.select("race_id", "race_date", "course_id", "off_min"), ["race_date", "course_id"], F.col("market_min"), F.col("off_min"), 1)
    best = pairs.groupBy("market_id").agg(F.min(F.struct(F.abs(F.col("market_min") - F.col("off_min")).alias("gap"), "race_id")).alias("m")).select("market_id", F.col("m.race_id").alias("race_id"))
    named = r.runners.select("race_id", "horse_id").join(r.horses.select("horse_id", "horse_name"), "horse_id")
    feed = named.select(F.col("race_id").alias("market_id"), (F.col("horse_id") + 1000).alias("selection_id"), match_name(F.concat(F.lit(" "), F.upper("horse_name"))).alias("k")).distinct()
    runners = named.select("race_id", "horse_id", match_name(F.col("horse_name")).alias("k")).distinct()
    return best.join(feed, "market_id").join(runners, ["race_id", "k"], "left").select("market_id", "race_id", "selection_id", "horse_id")


@racing_query(
    "j_fuzzy_name",
    "SELECT a, b FROM (SELECT a.p_partkey AS a, b.p_partkey AS b, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS rn FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey AND jaro_winkler_similarity(lower(a.p_name), lower(b.p_name)) >= 0.77) WHERE rn = 1",
)
def fuzzy_names(r: Racing, least: float = 0.77) -> DataFrame:
    """The first similar name within a block of equal keys; only blocks are compared, and different names once."""
    names = r.horses.select("horse_id", F.col("damsire").alias("size"), "sire", F.lower(F.regexp_replace("horse_name", " [0-9]+$", "")).alias("name"))
    # of a name in a block the two smallest ids are enough: the first similar one is no other's
    known = names.groupBy("size", "sire", "name").agg(F.min("horse_id").alias("first"))
    second = names.join(known, ["size", "sire", "name"]).where("horse_id <> first").groupBy("size", "sire", "name").agg(F.min("horse_id").alias("second"))
    known = known.join(second, ["size", "sire", "name"], "left")
    x = known.select("size", "sire", F.col("name").alias("x"))
    y = known.select("size", "sire", F.col("name").alias("y"), F.col("first").alias("b"), "second")
    found = similar_pairs(x.join(y, ["size", "sire"]), "x", "y", least)
    a = names.select(F.col("horse_id").alias("a"), "size", "sire", F.col("name").alias("x"))
    other = F.when(F.col("a") != F.col("b"), F.col("b")).otherwise(F.col("second"))
    return a.join(found, ["size", "sire", "x"]).groupBy("a").agg(F.min(other).alias("b")).where("b is not null")


def candidate_pairs(pairs: DataFrame, x: str, y: str, least: float) -> DataFrame:
    """Pairs of names that can be so similar: a bound of their similarity, from letters, decides."""
    bounded = pairs.withColumn("_cx", letter_counts(F.col(x))).withColumn("_cy", letter_counts(F.col(y)))
    return bounded.where(jaro_winkler_bound(F.col(x), F.col(y), F.col("_cx"), F.col("_cy")) >= least - 1e-9).drop("_cx", "_cy")


def similar_pairs(pairs: DataFrame, x: str, y: str, least: float) -> DataFrame:
    """The pairs of names that are so similar; equal names are, and only what the bound leaves goes to Python."""
    some = candidate_pairs(pairs.where(F.col(x) != F.col(y)), x, y, least)
    return pairs.where(F.col(x) == F.col(y)).unionByName(some.where(jaro_winkler(x, y) >= least))


@racing_query("j_contains_course", "SELECT a.course_name AS x, b.course_name AS y FROM courses a JOIN courses b ON a.course_id <> b.course_id AND (contains(lower(a.course_name), lower(b.course_name)) OR contains(lower(b.course_name), lower(a.course_name)))")
def contained_names(r: Racing) -> DataFrame:
    """Course names that hold one another.

    A holder contains the first letters of what it holds, so pairs are sought among names that share
    the first trigram of the shorter (or all of a name of one or two letters): an equi-join, not a
    nested loop. Empty names are held by all in SQL's sense and are left out on both sides.
    """
    names = r.courses.select("course_id", "course_name", F.lower("course_name").alias("n"))
    places = F.sequence(F.lit(1), F.greatest(F.length("n"), F.lit(1)))

    def parts(size: int) -> Column:
        return F.transform(places, lambda i: F.substr(F.col("n"), i, F.lit(size)))

    grams = F.array_distinct(F.concat(parts(1), parts(2), parts(3)))
    holder = names.select(F.col("course_id").alias("hi"), F.col("course_name").alias("hx"), F.col("n").alias("hn"), F.explode(grams).alias("g"))
    held = names.select(F.col("course_id").alias("li"), F.col("course_name").alias("lx"), F.col("n").alias("ln"), F.substr(F.col("n"), F.lit(1), F.lit(3)).alias("g"))
    pairs = holder.join(held, "g").where((F.col("hi") != F.col("li")) & F.col("hn").contains(F.col("ln"))).select("hx", "lx").distinct()
    return pairs.select(F.col("hx").alias("x"), F.col("lx").alias("y")).union(pairs.select("lx", "hx")).distinct()


@table_query("j_selection_id", with_racing("SELECT race_id, num, horse_id, round(p, 4) AS price FROM runners JOIN (SELECT user_id AS horse_id, max(value) AS p FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 1) USING (horse_id)"))
def by_selection(spark, sf_dir: str) -> DataFrame:
    """A day's prices joined to runners by their exchange id."""
    r = Racing.from_tables(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.to_date("ts") == F.lit("2024-01-05").cast("date"))
    prices = events.groupBy(F.col("user_id").alias("horse_id")).agg(F.max("value").alias("p"))
    return r.runners.join(prices, "horse_id").select("race_id", "num", "horse_id", F.round("p", 4).alias("price"))


@racing_query(
    "j_cross_fanout",
    "SELECT a.horse_id, round(avg(a.rpr), 4) AS x, round(avg(b.rpr), 4) AS y, count(DISTINCT a.race_id) AS n, count(DISTINCT b.race_id) AS m FROM runners a JOIN runners b ON a.horse_id = b.horse_id WHERE a.num <= 3 AND b.num > 3 GROUP BY 1",
)
def fan_out_free(r: Racing) -> DataFrame:
    """Means and distinct counts over an m by n join, each side summed by itself."""
    a = r.runners.where("num <= 3").groupBy("horse_id").agg(F.round(F.avg("rpr"), 4).alias("x"), F.countDistinct("race_id").alias("n"))
    b = r.runners.where("num > 3").groupBy("horse_id").agg(F.round(F.avg("rpr"), 4).alias("y"), F.countDistinct("race_id").alias("m"))
    return a.join(b, "horse_id").select("horse_id", "x", "y", "n", "m")


@racing_query(
    "j_diff_sets",
    "SELECT race_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT race_id FROM races WHERE race_id % 5 <> 0) e FULL JOIN (SELECT race_id, count(*) AS n FROM runners GROUP BY 1) l USING (race_id) WHERE n IS NULL OR race_id % 5 = 0",
)
def diff_sets(r: Racing) -> DataFrame:
    """Keys expected but not loaded, and the reverse."""
    expected = r.races.where("race_id % 5 <> 0").select("race_id")
    loaded = r.runners.select("race_id").distinct()
    return expected.join(loaded, "race_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(loaded.join(expected, "race_id", "left_anti").withColumn("side", F.lit("extra")))

