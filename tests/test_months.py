"""Date-bounded reports on the facts by month: what is read, what is shuffled, and that rows stay the same."""

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from railside import registry
from railside.operators.angle import last_next, near_miss_past
from railside.operators.market import inplay_moves, market_movers
from railside.plans.months import MonthStore, month_of
from railside.plans.racing import Racing
from tests.oracle import SMALL


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def racing(spark):
    return Racing.from_tables(spark, SMALL)


@pytest.mark.parametrize(("report", "months"), [(lambda r: market_movers(r, "1998-03-01", "1998-03-31", 5, "steamer"), {"199803"}), (lambda r: inplay_moves(r, "1998-03-01", "1998-04-30"), {"199803", "199804"})])
def test_a_report_reads_its_months_only(racing, report, months):
    frame = report(racing)
    plan = _plan(frame)
    assert plan.count("PartitionFilters: [isnotnull(race_month") >= 2 and "Exchange hashpartitioning" not in plan
    facts = [f for f in frame.inputFiles() if "race_month=" in f]
    assert facts and {re.search(r"race_month=(\d+)", f)[1] for f in facts} == months


def test_races_meet_runners_without_a_shuffle(spark, racing):
    store = MonthStore(racing, buckets=4)
    part = store.between(racing, "1995-01-01", "1996-12-31")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = part.runners.join(part.races, "race_id")
        plan = _plan(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    direct = racing.runners.join(racing.races.where("race_date between DATE '1995-01-01' and DATE '1996-12-31'"), "race_id")
    order = sorted(direct.columns)
    assert sorted(map(repr, joined.select(order).collect())) == sorted(map(repr, direct.select(order).collect()))


def test_months_are_pruned_at_run_time(racing):
    store = MonthStore(racing)
    few = racing.races.where("prize_fund > 100000 and course_id = 3")
    frame = store.of_races((F.col("prize_fund") > 100000) & (F.col("course_id") == 3))
    rows = frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(race_month" in plan and "Exchange hashpartitioning" not in plan
    assert rows and sorted((r.race_id, r.num, r.horse_id) for r in rows) == sorted((r.race_id, r.num, r.horse_id) for r in racing.runners.join(few, "race_id").collect())


def test_one_file_for_each_month_and_bucket(spark, racing):
    store = MonthStore(racing, buckets=3)
    files = spark.table(store.runners).inputFiles()
    months = racing.races.select(month_of("race_date")).distinct().count()
    assert len(files) <= 3 * months
    spark.catalog.refreshTable(store.runners)
    again = MonthStore(racing, buckets=3)
    assert again.runners == store.runners and spark.table(again.runners).inputFiles() == files


def test_changed_files_make_new_tables(spark, tmp_path):
    for t in ("orders", "lineitem", "part", "nation"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    r = Racing.from_tables(spark, str(tmp_path))
    before = MonthStore(r)
    os.utime(tmp_path / "orders.parquet", (1, 1))
    assert MonthStore(r).runners != before.runners
    frames = Racing(spark, races=r.races, runners=r.runners, courses=r.courses, horses=r.horses)
    assert market_movers(frames, "1998-03-01", "1998-03-31").count() == market_movers(r, "1998-03-01", "1998-03-31").count() > 0


def test_other_rows_of_the_same_files_make_other_tables(spark, racing):
    some = racing.having(runners=racing.runners.where("num = 1"))
    assert MonthStore(some).runners != MonthStore(racing).runners == MonthStore(Racing.from_tables(spark, SMALL)).runners
    assert {r.num for r in MonthStore(some).between(some, None, None).runners.select("num").distinct().collect()} == {1}


def test_no_races_at_all(spark, racing):
    empty = racing.having(races=racing.races.where("false"), runners=racing.runners.where(F.lit(False)))
    assert market_movers(empty, "1998-03-01", "1998-03-31").collect() == []
    assert set(registry.QUERIES) >= {"market_movers", "inplay_moves", "market_movers_range", "inplay_swing"}


def test_last_and_next_runs_are_stored_by_month(spark, racing):
    first = near_miss_past(racing, "1996-01-01", "1996-03-31", dsr_max=4000, or_delta_max=99, btn_max=99, dist_f_tolerance=99)
    plan = _plan(first)
    assert "Window" not in plan and "PartitionFilters: [isnotnull(row_month" in plan
    assert {int(re.search(r"row_month=(\d+)", f)[1]) for f in first.inputFiles() if "row_month=" in f} <= {199601, 199602, 199603}
    direct = last_next(racing).where("last_date between DATE '1996-01-01' and DATE '1996-03-31' and last_pos = 2 and last_btn <= 99 and last_or is not null and next_or is not null and dsr_next <= 4000 and next_or - last_or <= 99 and next_surface = last_surface")
    assert first.count() == min(200, direct.count()) > 0


def test_tables_hold_what_the_files_hold(spark, tmp_path, monkeypatch):
    for t in ("orders", "lineitem", "part", "nation"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    r = Racing.from_tables(spark, str(tmp_path))
    monkeypatch.setattr("railside.plans.months.BUCKET_BYTES", r.state("races", "runners", "courses", "horses")[1] // 5)
    store = MonthStore(r)
    assert store.buckets == 5  # all months' bytes count, since a task joins a bucket of a whole range
    assert set(spark.table(store.runners).columns) - {"race_month"} < set(spark.read.parquet(f"{SMALL}/lineitem.parquet").columns)
    assert store.between(r, None, None).runners.columns == r.runners.columns


def test_pairs_of_runs_are_stored_as_the_files_hold_them(spark, racing):
    near_miss_past(racing).collect()
    table = next(t.name for t in spark.catalog.listTables() if t.name.startswith("railside_last_next_") and t.name.endswith(racing.state("races", "runners")[0]))
    files = {c for t in ("orders", "lineitem") for c in spark.read.parquet(f"{SMALL}/{t}.parquet").columns}
    assert set(spark.table(table).columns) - {"n", "row_month"} < files and set(spark.table(table).schema["n"].dataType.names) < files
    frames = Racing(spark, races=racing.races, runners=racing.runners)
    assert sorted(map(repr, last_next(frames).collect())) == sorted(map(repr, last_next(racing).collect()))
