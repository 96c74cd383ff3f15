"""Feeds that are told by the names of their files."""

from datetime import date

from railside.sources import feeds


def _write(path, text: str = "race_id,num\n1,1\n") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_incomplete_months_are_skipped(spark, tmp_path):
    _write(tmp_path / "file=1999-05" / "a.csv", "race_id,num\n1,1\n1,2\n")
    _write(tmp_path / "file=1999-05_INCOMPLETE" / "a.csv", "race_id,num\n9,1\n")
    _write(tmp_path / "file=1999-06" / "a.csv", "race_id,num\n8,1\n")
    rows = feeds.read_month(spark, str(tmp_path), "1999-05", "race_id", "num").collect()
    assert sorted(map(tuple, rows)) == [("1", "1"), ("1", "2")]


def test_file_names_tell_the_days(spark, tmp_path):
    _write(tmp_path / "race_type=Flat" / "2024_02_27-2024_03_01.csv")
    _write(tmp_path / "race_type=Flat" / "2024_03_01-2024_03_01.csv")
    _write(tmp_path / "race_type=Flat" / "notes.csv")
    _write(tmp_path / "race_type=Chase" / "2024_01_01-2024_01_02.csv")
    days = {(r.race_type, r.day) for r in feeds.days_covered(spark, str(tmp_path), "race_type").collect()}
    assert days == {("Flat", date(2024, 2, 27)), ("Flat", date(2024, 2, 28)), ("Flat", date(2024, 2, 29)), ("Flat", date(2024, 3, 1)), ("Chase", date(2024, 1, 1)), ("Chase", date(2024, 1, 2))}
    latest = feeds.file_ranges(spark, str(tmp_path), "race_type").groupBy("race_type").agg({"last": "max"}).collect()
    assert sorted(map(tuple, latest)) == [("Chase", date(2024, 1, 2)), ("Flat", date(2024, 3, 1))]


def test_price_files_with_the_columns_and_enough_rows(spark, tmp_path):
    head = "event_id,\"bsp\",extra\n"
    _write(tmp_path / "uk_2024_01_05.csv", head + "1,2.5,\n" * 3)
    _write(tmp_path / "uk_2024_01_06.csv", head + "1,2.5,\n" * 2)
    _write(tmp_path / "uk_2024_01_07.csv", "event_id,price\n" + "1,2.5\n" * 9)
    _write(tmp_path / "notes.csv", head + "1,2.5,\n" * 9)
    _write(tmp_path / "file=ie_2024_01_08.csv" / "part-0.csv", head + "1,2.5,\n" * 2)
    _write(tmp_path / "file=ie_2024_01_08.csv" / "part-1.csv", head + "1,2.5,\n" * 2)
    files = feeds.file_index(spark.newSession(), f"{tmp_path}/*", ["event_id", "bsp"])
    assert sorted(map(tuple, files.collect())) == [("ie_2024_01_08.csv", date(2024, 1, 8), 4), ("uk_2024_01_05.csv", date(2024, 1, 5), 3)]


def test_a_day_is_fetched_once(spark, tmp_path):
    asked = []

    def fetch(days):
        asked.append([d.day for d in days])
        rows = [(d.day * 10 + i, d) for d in days if d.day != 3 for i in range(2)]
        return spark.createDataFrame(rows, "id long, day date")

    cache = feeds.DayCache(spark, str(tmp_path))
    days = [date(2024, 1, d) for d in (1, 2, 3, 4)]
    assert sorted(r.id for r in cache.through(days[:3], fetch).collect()) == [10, 11, 20, 21]
    assert sorted(r.id for r in cache.through(days, fetch).collect()) == [10, 11, 20, 21, 40, 41]
    assert sorted(r.id for r in feeds.DayCache(spark, str(tmp_path)).through(days[1:3], fetch).collect()) == [20, 21]
    assert asked == [[1, 2, 3], [4]]  # the third had no rows, and is known to have none


def test_append_twice(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, p string")
    for _ in range(2):
        feeds.append_new(spark, rows, f"{tmp_path}/new", ["k"], ["p"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/new").count() == 2


def test_the_index_tells_no_name_by_the_line(spark, tmp_path):
    (tmp_path / "uk_2024_01_05.csv").write_text("event_id,bsp\n" + "1,2\n" * 3)
    frame = feeds.file_index(spark, str(tmp_path), ["event_id", "bsp"])
    assert [tuple(r) for r in frame.collect()] == [("uk_2024_01_05.csv", date(2024, 1, 5), 3)]
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan[plan.rindex("Aggregate") :]
