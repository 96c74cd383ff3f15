"""Scalar functions over strings that are derived from the order tables, with the SQL that they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.functions import racing as R
from railside.functions import text as T
from railside.registry import table_query

#: Both engines read this select list.
CASES = """o_orderkey AS k
concat(CASE o_orderkey % 4 WHEN 0 THEN 'Éclair d' WHEN 1 THEN 'St. Mary-Lad' WHEN 2 THEN 'BLUE  Moon' ELSE 'sea.wind' END, CASE WHEN o_orderkey % 3 = 0 THEN chr(39) ELSE ' ' END, 'x', o_orderkey % 97, CASE o_orderkey % 7 WHEN 1 THEN ' II' WHEN 2 THEN ' i' WHEN 3 THEN ' iv' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN ' (IRE)' ELSE '' END) AS name
concat(CASE o_orderkey % 3 WHEN 0 THEN 'Kempton' WHEN 1 THEN 'Newton-Abbot' ELSE 'Bangor On Dee' END, CASE o_orderkey % 4 WHEN 0 THEN ' (AW)' WHEN 1 THEN ' aw' ELSE '' END) AS course
CASE o_orderkey % 5 WHEN 0 THEN concat(o_orderkey % 10, ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) WHEN 1 THEN concat(10 + o_orderkey % 13, ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), ':30') WHEN 2 THEN concat(1 + o_orderkey % 9, lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) WHEN 3 THEN concat(10 + o_orderkey % 13, lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) ELSE 'late' END AS off
concat(lpad(CAST(1 + o_orderkey % 31 AS STRING), 2, '0'), '-', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '-2024 ', lpad(CAST(o_orderkey % 24 AS STRING), 2, '0'), ':05') AS stamp
concat(CASE o_orderkey % 3 WHEN 0 THEN 'Ascot ' WHEN 1 THEN 'Ayr' ELSE '' END, o_orderkey % 31, 'th Jan') AS menu
CASE o_orderkey % 6 WHEN 0 THEN 'PU' WHEN 1 THEN '1' WHEN 2 THEN '12' WHEN 3 THEN '1dh' WHEN 4 THEN 'DSQ' END AS pos
concat(CASE o_orderkey % 2 WHEN 0 THEN '£' ELSE '' END, CAST(o_orderkey % 9 AS STRING), ',', lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'), CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '.257' END) AS money
CAST(o_orderkey % 300 AS DOUBLE) / 100 AS price
concat(8 + o_orderkey % 4, '-', o_orderkey % 14) AS weight
CASE o_orderkey % 4 WHEN 0 THEN concat(1 + o_orderkey % 3, 'm') WHEN 1 THEN concat(1 + o_orderkey % 3, 'm', o_orderkey % 8, 'f') WHEN 2 THEN concat(5 + o_orderkey % 3, '½f') ELSE 'far' END AS dist
concat(1 + o_orderkey % 3, 'm', o_orderkey % 8, 'f', o_orderkey % 200, 'yds') AS yards
CASE o_orderkey % 9 WHEN 0 THEN 'snk' WHEN 1 THEN 'nk' WHEN 2 THEN 'shd' WHEN 3 THEN 'hd' WHEN 4 THEN 'nse' WHEN 5 THEN 'dist' WHEN 6 THEN concat(o_orderkey % 20, '½') WHEN 7 THEN '¾' ELSE '-' END AS margin
CASE o_orderkey % 9 WHEN 0 THEN 'Good' WHEN 1 THEN 'Soft' WHEN 2 THEN 'Standard' WHEN 3 THEN 'Heavy' WHEN 4 THEN 'Good To Soft' WHEN 5 THEN 'Muddy' WHEN 6 THEN 'Slow' WHEN 7 THEN '' ELSE 'Abandoned' END AS going
concat(o_orderkey % 5, ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0'), '.4') AS clock
CASE o_orderkey % 4 WHEN 0 THEN concat(o_orderkey % 20, '/', 1 + o_orderkey % 3) WHEN 1 THEN 'Evens' WHEN 2 THEN concat(o_orderkey % 20, '/1F') ELSE '&' END AS fraction
concat(CASE o_orderkey % 8 WHEN 0 THEN 'Gold Cup (Group 1)' WHEN 1 THEN 'Maiden Hurdle (Class C)' WHEN 2 THEN 'Fillies & Mares Listed Race' WHEN 3 THEN 'Novices Chase Class 4' WHEN 4 THEN 'National Hunt Flat Race (Grade II)' WHEN 5 THEN 'Mares Handicap, "open"' WHEN 6 THEN 'Colts & Geldings Stakes' ELSE 'Sprint (Premier Handicap)' END, ' ', o_orderkey % 10) AS race
CAST(1000 + o_orderkey % 3000 AS DOUBLE) AS distance_m""".split("\n")
_CASES_SQL = f"WITH c AS (SELECT {', '.join(CASES)} FROM orders) "


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*CASES)


def scalar(name: str, sql: str | None, build: Callable[[], Column] | Column) -> None:
    """Register k and the function's value as ``v``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cases(spark, sf_dir).select("k", (build() if callable(build) else build).alias("v"))

    table_query(name, f"{_CASES_SQL}SELECT k, {sql} AS v FROM c" if sql else None)(query)


def _rx(value: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        value = f"regexp_replace({value}, '{pattern}', '{to}', 'g')"
    return value


def _norm(value: str) -> str:
    return _rx(f"strip_accents(lower({value}))", (r"\s*\([a-z]{2,3}\)\s*$", ""), ("[^a-z0-9]", " "))


def _normal(value: str) -> str:
    return f"trim({_rx(_norm(f'trim({value})'), (' +', ' '))})"


_HEAD = "split_part(name, '(', 1)"
_HHMM = r"CASE WHEN regexp_matches(off, '^\d{1,2}:\d{2}') THEN concat(lpad(split_part(off, ':', 1), 2, '0'), ':', split_part(off, ':', 2)) WHEN regexp_matches(off, '^\d{3,4}$') THEN concat(left(lpad(off, 4, '0'), 2), ':', right(off, 2)) ELSE off END"
_MIN = f"(SELECT CASE WHEN h LIKE '__:__' THEN CAST(left(h, 2) AS INT) * 60 + CAST(right(h, 2) AS INT) END FROM (SELECT {_HHMM} AS h))"
_CLOCK = "(SELECT concat(lpad(CAST(m // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(m % 60 AS VARCHAR), 2, '0')) FROM (SELECT ({} + 1440) % 1440 AS m))"
c = F.col

scalar("norm_text", _norm("name"), lambda: T.norm_text(c("name")))
scalar("normalize_text", _normal("name"), lambda: T.normalize_text(c("name")))
scalar("normalize_name_go", f"trim({_rx(f'strip_accents(trim(lower({_HEAD})))', (r'\s+(i|ii|iii|iv|v|vi)$', ''), (chr(39) * 2, ''), ('[-.,]', ' '), (r'\s+', ' '))})", lambda: T.match_name(c("name")))
scalar("normalize_name_py", f"lower(trim({_rx(f'trim({_HEAD})', (r'(?i)\s+(i|ii)$', ''), (r'\.', ' '), (chr(39) * 2, ''), (r'\s+', ' '))}))", lambda: F.lower(T.title_name(c("name"))))
scalar("bsp_clean_name", _rx(f"lower({_HEAD})", ("[ i]+$", ""), (chr(39) * 2, "")), lambda: T.exchange_name(c("name")))
scalar("norm_course", _rx("trim(lower(course))", (r" (\(aw\)|aw)$", ""), ("[ -]", "")), lambda: T.norm_course(c("course")))
scalar("clean_string", f"trim({_rx('race', ('[,\"]', ''), (r'\s+', ' '))})", lambda: T.clean_string(c("race")))
scalar("clean_race_name", f"trim({_rx('race', (r'(?i)\(?class [a-h0-9]\)?', ''), (r'(?i)\(?(group|grade) [0-9ivx]+\)?', ''), (r'Listed Race|\(Listed\)', ''), ('[,\"]', ''), (r'\s+', ' '))})", lambda: T.clean_race_name(c("race")))
scalar("time_variants", f"CASE WHEN off <> 'late' THEN concat_ws(',', {_CLOCK.format(_MIN)}, {_CLOCK.format(_MIN + ' - 1')}, {_CLOCK.format(_MIN + ' + 1')}) ELSE '' END", lambda: F.array_join(R.time_variants(c("off")), ","))
scalar("norm_hhmm", _HHMM, lambda: R.hhmm(c("off")))
scalar("time_diff_min", f"abs({_MIN} - 720)", lambda: R.minutes_apart(c("off"), F.lit("12:00")))
scalar("event_dt_parse", "strftime(try_strptime(stamp, '%d-%m-%Y %H:%M'), '%Y-%m-%d %H:%M')", lambda: F.date_format(R.event_time(c("stamp")), "yyyy-MM-dd HH:mm"))
scalar("venue_extract", "trim(regexp_extract(menu, '^([^0-9]+)[0-9]', 1))", lambda: R.venue(c("menu")))
scalar("pos_num", "TRY_CAST(regexp_extract(pos, '^([0-9]+)', 1) AS INT)", lambda: R.leading_position(c("pos")))
scalar("win_flag", "coalesce(TRY_CAST(regexp_extract(pos, '^([0-9]+)', 1) AS INT) = 1, false)", lambda: R.won(c("pos")))
_KEY = f"md5(concat_ws('|', '2024-01-05', 'gb', {_normal('course')}, {_HHMM}, {_normal('race')}, 'flat'))"
scalar("race_key", _KEY, lambda: R.race_key(F.lit("2024-01-05"), F.lit("GB"), c("course"), c("off"), c("race"), F.lit("Flat")))
scalar("runner_key", f"md5(concat_ws('|', 'r', {_normal('name')}, CASE WHEN k % 3 <> 0 THEN CAST(k % 3 AS VARCHAR) WHEN k % 5 <> 0 THEN CAST(k % 5 AS VARCHAR) ELSE '' END))", lambda: R.runner_key(F.lit("r"), c("name"), c("k") % 3, c("k") % 5))
scalar("meeting_key", "md5(concat('2024-01-05|GB|', course))", lambda: R.key_of(F.lit("2024-01-05"), F.lit("GB"), c("course")))
scalar("clean_numeric", "round(TRY_CAST(regexp_replace(money, '[£€$,–-]', '', 'g') AS DOUBLE), 2)", lambda: R.number_of(c("money")))
scalar("sentinel_price", "CASE WHEN price >= 1.01 THEN price END", lambda: R.sound_price(c("price")))
scalar("zero_to_null", "nullif(price, 0)", lambda: R.known(c("price")))
scalar("weight_lbs", "CAST(split_part(weight, '-', 1) AS INT) * 14 + CAST(split_part(weight, '-', 2) AS INT)", lambda: R.pounds(c("weight")))
scalar("dist_furlongs", "CAST(CASE k % 4 WHEN 0 THEN (1 + k % 3) * 8 WHEN 1 THEN (1 + k % 3) * 8 + k % 8 WHEN 2 THEN 5.5 + k % 3 END AS DOUBLE)", lambda: R.furlongs(c("dist")))
scalar("dist_metres", "CAST(round((1 + k % 3) * 1609.34 + k % 8 * 201.168 + k % 200 * 0.914) AS INT)", lambda: R.metres(c("yards")))
scalar("dist_yards", "CAST(round(round((1 + k % 3) * 1609.34 + k % 8 * 201.168 + k % 200 * 0.914) * 1.0936) AS INT)", lambda: F.round(R.metres(c("yards")) * F.lit(1.0936).cast("double")).cast("int"))
_MARGIN = "CAST(CASE k % 9 WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 WHEN 2 THEN 0.1 WHEN 3 THEN 0.2 WHEN 4 THEN 0.05 WHEN 5 THEN 30 WHEN 6 THEN k % 20 + 0.5 WHEN 7 THEN 0.75 END AS DOUBLE)"
scalar("beaten_dist", _MARGIN, lambda: R.beaten_lengths(c("margin")))
scalar("btn_adjust", f"round(CASE WHEN price > 1 AND {_MARGIN} < 0.25 THEN price + {_MARGIN} ELSE price END, 4)", lambda: F.round(R.full_margin(R.beaten_lengths(c("margin")), c("price")), 4))
_LPS = "CASE WHEN going = '' THEN CASE WHEN k % 2 = 0 THEN 6.0 ELSE 5.0 END WHEN going = 'Standard' OR (going = 'Slow' AND k % 2 = 0) THEN CASE WHEN k % 2 = 0 THEN 6.0 ELSE 5.0 END WHEN going LIKE 'Good%' THEN CASE WHEN k % 2 = 0 THEN 6.0 ELSE 5.0 END WHEN going IN ('Soft', 'Heavy', 'Slow') THEN CASE WHEN k % 2 = 0 THEN 5.0 ELSE 4.0 END ELSE 5.0 END"
scalar("est_time", f"round(90 + price / ({_LPS}), 4)", lambda: F.round(90 + c("price") / R.lengths_per_second(c("going"), c("course"), c("k") % 2 == 0), 4))
scalar("time_to_secs", "round(k % 5 * 60 + k % 60 + 0.4, 2)::DOUBLE", lambda: R.seconds(c("clock")))
scalar("frac_to_dec", "round(CAST(CASE k % 4 WHEN 0 THEN (k % 20)::DOUBLE / (1 + k % 3) + 1 WHEN 1 THEN 2 WHEN 2 THEN k % 20 + 1 END AS DOUBLE), 2)", lambda: R.decimal_odds(c("fraction")))
scalar("going_surface", "CASE WHEN going IN ('Standard', 'Slow') THEN 'AW' WHEN going = 'Muddy' THEN 'Dirt' WHEN going IN ('Good', 'Soft', 'Heavy', 'Good To Soft') THEN 'Turf' ELSE '' END", lambda: R.surface_of(c("going")))
scalar("race_class", "CASE k % 8 WHEN 1 THEN 'Class 3' WHEN 3 THEN 'Class 4' WHEN 7 THEN 'Class 2' ELSE '' END", lambda: R.race_class(c("race")))
scalar("race_pattern", "CASE k % 8 WHEN 0 THEN 'Group 1' WHEN 2 THEN 'Listed' WHEN 4 THEN 'Grade Ii' ELSE '' END", lambda: R.race_pattern(c("race")))
scalar("sex_restriction", "CASE k % 8 WHEN 2 THEN 'F & M' WHEN 5 THEN 'M' WHEN 6 THEN 'C & G' ELSE '' END", lambda: R.sex_restriction(c("race")))
scalar("race_bands", "CASE WHEN k % 2 = 0 THEN concat(2 + k % 4, 'yo+|0-', k % 100) ELSE '3yo|' END", lambda: F.concat_ws("|", *R.bands(F.when(c("k") % 2 == 0, F.concat(F.lit("("), (2 + c("k") % 4).cast("string"), F.lit("yo+, 0-"), (c("k") % 100).cast("string"), F.lit(")"))).otherwise("(3yo)"))))
scalar("race_type_pages", "CASE WHEN k % 5 = 0 AND k % 8 <> 4 THEN 'Flat' WHEN k % 3 = 0 THEN 'Hurdle' WHEN k % 3 = 1 THEN 'Chase' WHEN distance_m < 2400 THEN 'Flat' WHEN k % 8 = 1 THEN 'Hurdle' WHEN k % 8 = 3 THEN 'Chase' WHEN k % 8 = 4 THEN 'NH Flat' ELSE 'Flat' END", lambda: R.race_type(c("race"), c("distance_m"), F.when(c("k") % 5 == 0, "flat"), F.when(c("k") % 3 == 0, "8 Hurdles").when(c("k") % 3 == 1, "12 fences")))
scalar("race_type", "CASE WHEN distance_m < 2400 THEN 'Flat' WHEN k % 8 = 1 THEN 'Hurdle' WHEN k % 8 = 3 THEN 'Chase' WHEN k % 8 = 4 THEN 'NH Flat' ELSE 'Flat' END", lambda: R.race_type(c("race"), c("distance_m")))
scalar("non_completion", "CASE WHEN pos IN ('1', '12', 'DSQ') THEN price END", lambda: R.completed(c("pos"), c("price")))
scalar("microstructure", "concat_ws('|', round(price * 0.5, 4)::VARCHAR, CASE WHEN price > 0 THEN '0.5' ELSE '' END)", lambda: F.concat_ws("|", F.round(c("price") - c("price") / 2, 4).cast("string"), F.when(c("price") > 0, (c("price") / 2 / c("price")).cast("string")).otherwise("")))
scalar("move_pct", "round(100 * (price - 1.5) / nullif(price, 0), 2)", lambda: F.round(100 * F.try_divide(c("price") - 1.5, c("price")), 2))
scalar("scalar_mix", "round(greatest(coalesce(nullif(price, 0), 9), least(k % 7, 3)) + ln(1 + abs(price - 2)), 4)", lambda: F.round(F.greatest(F.coalesce(F.nullif(c("price"), F.lit(0.0)), F.lit(9.0)), F.least(c("k") % 7, F.lit(3)).cast("double")) + F.log1p(F.abs(c("price") - 2)), 4))
scalar("jaccard", "(SELECT round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) FROM (SELECT [CAST(k % 5 AS INT), CAST(k % 7 AS INT) + 5, 1] AS a, [CAST(k % 3 AS INT), 1, 6] AS b))", lambda: F.round(T.overlap(F.array((c("k") % 5).cast("int"), (c("k") % 7).cast("int") + 5, F.lit(1)), F.array((c("k") % 3).cast("int"), F.lit(1), F.lit(6))), 6))


@table_query("tz_local", "SELECT event_id, strftime(timezone('Europe/London', ts::TIMESTAMPTZ + INTERVAL 180 DAY), '%Y-%m-%d %H:%M') AS local FROM events")
def london_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC stamps as clocks in London show them, summer time included."""
    later = F.col("ts") + F.expr("INTERVAL 180 DAY")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_format(F.from_utc_timestamp(later, "Europe/London"), "yyyy-MM-dd HH:mm").alias("local"))


_AS_OF = "2024-01-15 12:00:00"


@table_query("market_status", f"SELECT event_id, CASE WHEN TIMESTAMP '{_AS_OF}' > ts + INTERVAL 30 MINUTE THEN 'Finished' WHEN TIMESTAMP '{_AS_OF}' > ts - INTERVAL 10 MINUTE THEN 'Active' ELSE 'Upcoming' END AS status FROM events")
def market_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", R.status(F.col("ts"), F.lit(_AS_OF).cast("timestamp")).alias("status"))


@table_query("price_freshness", f"SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'No price' WHEN (epoch(TIMESTAMP '{_AS_OF}') - floor(epoch(ts))) / 60 < 5 THEN 'Fresh' WHEN (epoch(TIMESTAMP '{_AS_OF}') - floor(epoch(ts))) / 60 < 60 THEN 'Current' ELSE 'Stale' END AS age FROM events")
def price_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 9 != 0, F.col("ts"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", R.freshness(stamp, F.lit(_AS_OF).cast("timestamp")).alias("age"))


@table_query("json", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, CAST(len(json_keys(props)) AS INT) AS n FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field and the number of fields of JSON objects."""
    keys = F.json_object_keys("props")
    fields = F.from_json("props", "map<string,string>")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.try_element_at(fields, keys[0]).alias("first_value"), F.size(keys).alias("n"))


@table_query("jaro_winkler", "SELECT p_partkey AS k, round(jaro_winkler_similarity(lower(p_name), lower(reverse(p_name) || p_type)), 6) AS v, round(jaro_winkler_similarity(lower(p_name), lower(left(p_name, 6) || p_type)), 6) AS w FROM part")
def jaro_winkler_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    pairs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), name.alias("a"), F.lower(F.concat(F.reverse("p_name"), "p_type")).alias("b"), F.lower(F.concat(F.left("p_name", F.lit(6)), "p_type")).alias("d"))
    return pairs.select("k", F.round(T.jaro_winkler("a", "b"), 6).alias("v"), F.round(T.jaro_winkler("a", "d"), 6).alias("w"))


#: An order's lines as a ladder: the price and size arrays of its traded volume and offers.
_LADDER = "SELECT l_orderkey AS k, list(struct_pack(price := floor(l_extendedprice / 10) / 100, size := l_quantity) ORDER BY floor(l_extendedprice / 10) DESC, l_quantity) AS ladder FROM lineitem GROUP BY 1"


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market k, traded, back, lay: arrays of (price, size), and the last traded price."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), (F.floor(F.col("l_extendedprice") / 10) / 100).alias("price"), F.col("l_quantity").alias("size"))
    sort = F.sort_array(F.collect_list(F.struct((-F.col("price")).alias("p"), F.col("size"))))
    book = lines.groupBy("k").agg(F.transform(sort, lambda x: F.struct((-x["p"]).alias("price"), x["size"].alias("size"))).alias("ladder"))
    none = F.filter("ladder", lambda x: F.lit(False))
    return book.select("k", F.when(F.col("k") % 3 == 0, none).otherwise(F.col("ladder")).alias("traded"), F.when(F.col("k") % 5 == 0, none).otherwise(F.col("ladder")).alias("back"), F.reverse("ladder").alias("lay"))


@table_query("vwap", f"WITH b AS ({_LADDER}) SELECT k, CASE WHEN k % 3 <> 0 THEN list_sum(list_transform(ladder, lambda x: x.price * x.size)) / list_sum(list_transform(ladder, lambda x: x.size)) WHEN k % 5 = 0 THEN 0 ELSE (ladder[1].price + ladder[-1].price) / 2 END AS v FROM b")
def vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders(spark, sf_dir).select("k", R.weighted_price(F.col("traded"), F.col("back"), F.col("lay")).alias("v"))


@table_query("best_back", f"WITH b AS ({_LADDER}) SELECT k, CASE WHEN k % 5 <> 0 THEN ladder[1].price WHEN k % 2 = 0 THEN 3.5 END AS v FROM b")
def best_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders(spark, sf_dir).select("k", R.best_back(F.col("back"), F.when(F.col("k") % 2 == 0, 3.5)).alias("v"))


@table_query("best_odds", "SELECT l_orderkey AS k, arg_max(l_suppkey, (l_extendedprice, -l_suppkey)) AS bookmaker, round(max(l_extendedprice), 4) AS odds FROM lineitem GROUP BY 1")
def best_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the offers in an array, the smallest bookmaker among equals."""
    offers = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("odds"), (-F.col("l_suppkey")).alias("b"))).alias("offers"))
    best = F.array_max("offers")
    return offers.select("k", (-best["b"]).alias("bookmaker"), F.round(best["odds"], 4).alias("odds"))


@table_query("trigram_similarity", "WITH p AS (SELECT p_partkey AS id, p_name, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM part), g AS (SELECT id, p_name, list_distinct(flatten(list_transform(ws, lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM p), q AS (SELECT list_distinct(flatten(list_transform(['blue', 'widget'], lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS q) SELECT id, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS score FROM g, q WHERE len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) >= 0.3")
def trigram_matches(spark: SparkSession, sf_dir: str, query: str = "Blue widget", least: float = 0.3) -> DataFrame:
    score = T.trigram_similarity(F.col("p_name"), F.lit(query))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), score.alias("s")).where(F.col("s") >= least).select("id", F.round("s", 6).alias("score"))
