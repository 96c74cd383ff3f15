"""Reports on small frames."""

from types import SimpleNamespace

from railside.operators.reports import orphan_keys


def test_orphans_of_every_id_are_found(spark):
    runners = spark.createDataFrame([(1, 1, 7), (1, 2, 80), (2, 1, 41), (2, 2, 3), (3, 1, None)], "race_id long, num int, horse_id long")
    horses = spark.createDataFrame([(3,), (80,), (41,)], "horse_id long")
    got = orphan_keys(SimpleNamespace(runners=runners, horses=horses)).collect()
    assert sorted((r.race_id, r.num, r.horse_id) for r in got if r.horse_id is not None) == [(1, 1, 7), (1, 2, 80)]
    assert [(r.race_id, r.num) for r in got if r.horse_id is None] == [(3, 1)]
