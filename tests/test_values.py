"""Upsert modes, bands, similarity and edge cases on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from railside.functions import racing as R
from railside.functions.text import jaro_winkler_bound, letter_counts, norm_text, similar_names, trigram_similarity
from railside.operators.joins import band_join, candidate_pairs
from railside.operators.mutations import upsert
from railside.operators.race import default_window, page_size
from railside.plans.racing import Racing
from railside.streaming.ticks import ingest
from tests.oracle import SMALL


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, x string, y double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", 7.0)], "k int, x string, y double")
    rows = {r.k: (r.x, r.y) for r in upsert(old, new, ["k"], {"x": "fill", "y": "new"}).collect()}
    assert rows == {1: ("a", 1.0), 2: ("b", 5.0), 3: ("c", 7.0)}
    assert {r.k: r.x for r in upsert(old, new, ["k"], {"x": "new"}).collect()}[2] is None


def test_band_join_finds_each_pair_once(spark):
    left = spark.createDataFrame([(0, 9), (1, 10), (2, 31)], "a int, m int")
    right = spark.createDataFrame([(0, 0), (1, 19), (2, 20), (3, 41), (4, 42)], "b int, n int")
    got = sorted((r.a, r.b) for r in band_join(left.withColumn("d", F.lit(1)), right.withColumn("d", F.lit(1)), ["d"], F.col("m"), F.col("n"), 10).collect())
    assert got == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 3)] or got == sorted((a, b) for a, m in ((0, 9), (1, 10), (2, 31)) for b, n in ((0, 0), (1, 19), (2, 20), (3, 41), (4, 42)) if abs(m - n) <= 10)


def test_names(spark):
    assert one(spark, norm_text(F.lit("Élan D'Or (IRE)"))) == "elan d or"
    assert similar_names("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similar_names("", "") == 1.0 and similar_names(None, "a") is None
    assert one(spark, trigram_similarity(F.lit(""), F.lit(""))) == 0.0


def test_values(spark):
    assert one(spark, R.hhmm(F.lit("105"))) == "01:05"
    assert one(spark, R.time_variants(F.lit("0:00"))) == ["00:00", "23:59", "00:01"]
    assert one(spark, R.beaten_lengths(F.lit("snk"))) == 0.2
    assert one(spark, R.decimal_odds(F.lit("5/2F"))) == 3.5
    assert one(spark, R.furlongs(F.lit("far"))) is None
    assert one(spark, R.number_of(F.lit("£1,234.50"))) == 1234.5


def test_parameters():
    assert [page_size(x) for x in (None, 0, 7, 5000)] == [50, 50, 7, 1000]
    assert default_window(None, None, "2024-03-01") == ("2023-03-02", "2024-03-01")
    assert default_window("2024-01-01", None, "2024-03-01") == ("2024-01-01", None)


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.sql("SELECT CAST(1 AS LONG) AS event_id, TIMESTAMP '2024-01-01 00:00:00' AS ts, CAST(5 AS LONG) AS user_id, 2.0D AS value")
    rows.union(rows).write.parquet(str(tmp_path / "ticks"))
    assert ingest(spark, str(tmp_path / "ticks")).count() == 1


def test_short_price_rows_are_dropped(spark, tmp_path):
    from railside.sources import feeds

    whole = ",".join(str(i) for i in range(17))
    (tmp_path / "a.csv").write_text("\n".join([",".join(feeds.PRICE_COLUMNS), whole, "1,2,3"]) + "\n")
    assert [r["event_id"] for r in feeds.read_prices(spark, str(tmp_path)).select("event_id").collect()] == ["0"]


def test_stitched_rows_of_both_layouts(spark, tmp_path):
    from railside.sources.pages import STITCHED_COLUMNS, read_stitched

    new = ["d", "o", "e", "v", "h", *["1"] * 21, ""]
    old = ["d", "o", "e", "h2", *["1"] * 21, "0"]
    lines = [STITCHED_COLUMNS, new, old, ["d", "o", "e"]]
    (tmp_path / "a.csv").write_text("\n".join(",".join(x) for x in lines) + "\n")
    rows = read_stitched(spark, str(tmp_path)).select("horse", "venue", "place_win_lose").orderBy("horse").collect()
    assert [tuple(r) for r in rows] == [("h", "v", None), ("h2", None, "0")]


def test_profile_without_state_takes_its_address(spark):
    from railside.sources.pages import profiles

    pages = spark.createDataFrame([("https://a.test/profile/horse/7/old-boy", "<html></html>"), ("https://a.test/profile/horse/8/x", None)], "url string, html string")
    assert sorted(tuple(r) for r in profiles(pages).collect()) == [(7, "Old Boy", None), (8, "X", None)]


def test_no_name_is_more_similar_than_its_bound(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcde fgxyz'É9") for _ in range(draw.randrange(0, 12)))
    pairs = [(word(), word()) for _ in range(1500)] + [(w, w[:k] + draw.choice("abz") + w[k + 1 :]) for w in (word() + "abcdef" for _ in range(500)) for k in (0, 3)] + [("", ""), ("", "a"), ("abc", "abc"), ("ABC", "XYZ")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    bound = jaro_winkler_bound(F.col("a"), F.col("b"), letter_counts(F.col("a")), letter_counts(F.col("b")))
    rows = frame.withColumn("bound", bound).collect()
    assert all(r.bound >= similar_names(r.a, r.b) - 1e-12 for r in rows)
    left = {r.i for r in candidate_pairs(frame, "a", "b", 0.77).collect()}
    true = {r.i for r in rows if similar_names(r.a, r.b) >= 0.77}
    assert true <= left and len(left) < 0.75 * len(pairs)


def test_python_sees_a_small_share_of_the_pairs(spark):
    names = Racing.from_tables(spark, SMALL).horses.select(F.lower(F.regexp_replace("horse_name", " [0-9]+$", "")).alias("n")).distinct()
    pairs = names.select(F.col("n").alias("x")).join(names.select(F.col("n").alias("y"))).where("x <> y")
    share = candidate_pairs(pairs, "x", "y", 0.77).count() / pairs.count()
    assert 0 < share < 0.3


def test_all_rules_of_a_race_type(spark):
    rows = [("National Hunt Flat Race", 3000, "flat", None, "NH Flat"), ("Stakes", 1200, "flat", "8 hurdles", "Flat"), ("Stakes", 1200, "jumps", "8 hurdles", "Hurdle"), ("Stakes", 1200, "jumps", "9 fences", "Chase"), ("Novice Hurdle", 3200, "jumps", "", "Hurdle"), ("Novice Hurdle", 2000, "jumps", None, "Flat"), ("Plain", 4000, None, None, "Flat")]
    frame = spark.createDataFrame(rows, "name string, m int, code string, fences string, t string")
    assert [r.t for r in frame.select("t", R.race_type(F.col("name"), F.col("m"), F.col("code"), F.col("fences")).alias("v")).where("t <> v").collect()] == []
