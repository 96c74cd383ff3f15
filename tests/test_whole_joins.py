"""Joins that give all their rows, and keep little of what they compare."""

from railside import registry
from railside.operators.joins import best_score, same_blood
from railside.plans.racing import Racing
from tests.oracle import SMALL, differences


def test_composite_keys_give_every_pair(spark):
    horses = spark.createDataFrame([(1, "s", "d", "g"), (2, "s", "d", "g"), (3, "s", "d", "g"), (4, "s", "d", None), (5, "s", "d", None), (6, "s", "e", "g")], "horse_id long, sire string, dam string, damsire string")
    assert sorted(tuple(r) for r in same_blood(Racing(spark, horses=horses)).select("a", "b").collect()) == [(1, 2), (1, 3), (2, 3)]
    assert "a.horse_id < b.horse_id" in registry.ORACLES["j_composite"]


def test_best_scores_sort_no_pairs(spark, tmp_path):
    assert "SortAggregate" not in best_score(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    rows = [(i, f"2024-01-05 10:{(i * 7) % 30:02d}:00", i % 5, "click" if i % 2 else "view", (i * 37 % 101) / 4, "{}") for i in range(400)]
    rows += [(2**62, "2024-01-05 23:59:00", 9, "view", 5.0, "{}"), (2**62 + 1, "2024-01-05 23:57:00", 8, "click", 9.99, "{}"), (-5, "2024-01-05 23:57:00", 8, "click", 10.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "e"))
    next((tmp_path / "e").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert differences(best_score(spark, str(tmp_path)), str(tmp_path), registry.ORACLES["j_best_score"]) == []
