"""Versions, pinned readers, refreshed months; prices merged batch by batch, replayed and restarted."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from railside.operators.mutations import replace_days
from railside.plans.snapshots import Conflict, Snapshots
from railside.streaming.ticks import TICK, Mirror

MONTHS = "race_id long, num int, race_month string"


def _folders(table: Snapshots) -> dict[str, list[str]]:
    return {p: sorted(os.listdir(f"{table.path}/data/{f}")) for p, f in table.manifest().parts.items()}


def test_a_reader_keeps_its_version(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path), "race_month")
    with pytest.raises(LookupError):
        table.read()
    rows = spark.createDataFrame([(1, 1, "2024-01"), (2, 1, "2024-02"), (3, 1, None)], MONTHS)
    first, changed = table.refresh(rows)
    assert changed == ["2024-01", "2024-02", None]
    pinned, before = table.read(), _folders(table)
    second, changed = table.refresh(rows.where("race_id <> 2").unionByName(spark.createDataFrame([(4, 1, "2024-03"), (3, 2, None)], MONTHS)))
    assert changed == ["2024-02", "2024-03", None]
    assert sorted(r.race_id for r in pinned.collect()) == [1, 2, 3]
    assert sorted((r.race_id, r.num) for r in table.read().collect()) == [(1, 1), (3, 1), (3, 2), (4, 1)]
    assert sorted(r.race_id for r in table.read(table.manifest(1)).collect()) == [1, 2, 3]
    assert second.parts["race_month=2024-01"] == first.parts["race_month=2024-01"] and _folders(table)["race_month=2024-01"] == before["race_month=2024-01"]
    assert "race_month=2024-02" not in second.parts
    assert table.refresh(table.read())[1] == [] and table.manifest().version == 2


def test_two_writers_and_an_aborted_write(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path), "race_month")
    base = table.manifest()
    rows = spark.createDataFrame([(1, 1, "2024-01")], MONTHS)
    table.replace(rows, base=base)
    with pytest.raises(Conflict):
        table.replace(rows, base=base)
    with pytest.raises(ValueError, match="outside"):
        table.replace(rows, ["2024-02"])
    with pytest.raises(Exception, match="no such day"):
        table.replace(rows.withColumn("num", F.raise_error(F.lit("no such day")).cast("int")))
    assert table.manifest().version == 1 and [r.race_id for r in table.read().collect()] == [1]
    table.replace(rows.where("false"), ["2024-01"])
    assert table.read().collect() == [] and table.read().columns == rows.columns
    assert table.vacuum(keep=1) >= 3 and table.read().collect() == []


def test_a_filter_on_the_month_reads_its_folders_only(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path), "race_month")
    table.replace(spark.createDataFrame([(i, 1, f"2024-{1 + i % 9:02d}") for i in range(90)], MONTHS))
    rows = table.read().where("race_month between '2024-02' and '2024-03'")
    assert rows.count() == 20
    read = rows.select("race_id", F.input_file_name().alias("f")).select("f").distinct().collect()
    assert {r.f.split("race_month=")[1].split("/")[0] for r in read} == {"2024-02", "2024-03"}
    assert "PartitionFilters: [isnotnull(race_month" in rows._jdf.queryExecution().executedPlan().toString()


def _ticks(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, TICK).coalesce(1).write.mode(mode).parquet(path)


def _at(hour: int, minute: int = 0) -> datetime:
    return datetime(2024, 1, 15, hour, minute)


def test_prices_are_merged_replayed_and_restarted(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/table", "day")
    day = date(2024, 1, 15)
    schema = "user_id long, value double, seen timestamp, tick long, high double, low double, day date"
    table.replace(spark.createDataFrame([(1, 5.0, None, None, 6.0, 4.0, day), (2, None, None, None, None, None, day), (3, 7.0, None, None, 7.0, 7.0, day), (3, 9.0, None, None, 9.0, 9.0, date(2024, 1, 14))], schema))
    feed, state = f"{tmp_path}/feed", f"{tmp_path}/state"
    _ticks(spark, feed, [(1, _at(13), 1, 5.5), (2, _at(13), 2, 3.0), (9, _at(13), 99, 1.0)])
    _ticks(spark, feed, [(3, _at(14), 1, 4.5), (4, _at(14), 1, None), (5, None, 1, 77.0)])
    ticks = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(feed)
    Mirror(table, state).run(ticks, state)
    today = {r.user_id: (r.value, r.high, r.low) for r in table.read(parts=[day]).collect()}
    assert today == {1: (4.5, 6.0, 4.0), 2: (3.0, 3.0, 3.0), 3: (7.0, 7.0, 7.0)}
    untouched = table.manifest().parts["day=2024-01-14"]
    version = table.manifest().version
    Mirror(table, state).apply(spark.createDataFrame([(7, _at(20), 1, 99.0)], TICK), 1)  # the last batch, run again
    assert table.manifest().version == version
    _ticks(spark, feed, [(6, _at(12, 30), 1, 8.0), (1, _at(13), 1, 5.5), (2, _at(13), 2, 3.0), (8, _at(14), 1, 4.6), (7, _at(12), 3, 0.0)])  # late, repeated, of one time, zero
    Mirror(table, state).run(ticks, state)
    rows = {(r.user_id, str(r.day)): (r.value, r.high, r.low) for r in table.read().collect()}
    assert rows == {(1, "2024-01-15"): (4.6, 8.0, 4.0), (2, "2024-01-15"): (3.0, 3.0, 3.0), (3, "2024-01-15"): (7.0, 7.0, 7.0), (3, "2024-01-14"): (9.0, 9.0, 9.0)}
    assert table.manifest().parts["day=2024-01-14"] == untouched
    version = table.manifest().version
    Mirror(table, state).run(ticks, state)  # nothing new
    assert table.manifest().version == version


def _day_files(path: str) -> dict[str, list[str]]:
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("day=")}


def test_a_day_is_replaced_as_a_whole_or_not_at_all(spark, tmp_path):
    path, schema = f"{tmp_path}/days", "id long, day string"
    replace_days(spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "d2"), (4, "d3")], schema), path, "day")
    before = _day_files(path)
    replace_days(spark.createDataFrame([(5, "d1"), (6, "d4")], schema), path, "day")
    after = _day_files(path)
    assert {r.id for r in spark.read.parquet(path).collect()} == {3, 4, 5, 6}
    assert after["day=d2"] == before["day=d2"] and after["day=d3"] == before["day=d3"] and after["day=d1"] != before["day=d1"]
    broken = spark.createDataFrame([(7, "d2"), (8, "d3")], schema).repartition(2, "day").withColumn("id", F.when(F.col("id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        replace_days(broken, path, "day")
    assert _day_files(path) == after and {r.id for r in spark.read.parquet(path).collect()} == {3, 4, 5, 6}
    replace_days(spark.createDataFrame([], schema), path, "day")
    assert _day_files(path) == after
