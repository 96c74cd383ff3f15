"""Jobs over all runs: dealt into more partitions where files grow, no task with all races or all of a hash map."""

import pytest

from railside.operators.joins import next_trainers
from railside.operators.reports import horse_history
from railside.plans import racing
from railside.plans.racing import Racing
from tests.oracle import SMALL


@pytest.mark.parametrize("job", [horse_history, next_trainers])
def test_partitions_grow_with_the_files(spark, monkeypatch, job):
    r = Racing.from_tables(spark, SMALL)
    size = r.state("races", "runners")[1]
    rows = []
    for parts in (16, 32):
        monkeypatch.setattr(racing, "PART_BYTES", size // parts)
        frame = job(r)
        rows.append(sorted(map(tuple, frame.collect())))
        plan = frame._jdf.queryExecution().executedPlan().toString()
        n = r.parts("races", "runners")
        assert n >= parts and "Broadcast" not in plan
        assert "hashpartitioning(race_id#" in plan and f", {n}), REPARTITION_BY_NUM" in plan
    assert rows[0] == rows[1]


def test_a_run_in_the_same_race_is_no_run_before(spark):
    races = spark.sql("select * from values (1L, DATE '2024-01-01'), (2L, DATE '2024-01-01'), (3L, DATE '2024-01-05') as t(race_id, race_date)")
    runners = spark.sql("select * from values (1L, 7L), (1L, 7L), (2L, 7L), (3L, 7L), (3L, 7L), (3L, 8L), (9L, 8L), (3L, null), (3L, null) as t(race_id, horse_id)")
    found = horse_history(Racing(spark, races=races, runners=runners)).collect()
    assert sorted(((r.horse_id, r.race_id, r.dsr) for r in found), key=str) == sorted([(7, 1, None), (7, 2, 0), (7, 3, 4), (8, 3, None), (None, 3, None)], key=str)


def test_a_refresh_joins_nothing_again(spark, monkeypatch):
    from railside.plans.snapshots import Snapshots
    from railside.sources.queries import refreshed_snapshot

    plans, refresh = [], Snapshots.refresh
    monkeypatch.setattr(Snapshots, "refresh", lambda self, rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), refresh(self, rows))[1])
    assert refreshed_snapshot(Racing.from_tables(spark, SMALL)).count() > 0
    assert len(plans) == 2 and not any("Join" in p for p in plans)
