"""The warehouse that operators work on: facts ``races`` and ``runners`` and their dimensions.

On a deployment the frames come from month-partitioned Parquet. On the driver's order tables they are
views by analogy: an order is a race, an order line a runner, a part a horse, a supplier a trainer, a
customer a jockey and an owner, a nation a course. The same select lists serve Spark and the checking SQL.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession

from railside.plans.snapshots import state_of

RACES = """o_orderkey AS race_id
CAST(o_orderdate AS DATE) AS race_date
o_custkey % 25 AS course_id
CAST(720 + o_orderkey * 7 % 480 AS INT) AS off_min
CASE WHEN o_orderkey % 3 = 0 THEN concat('Race ', o_orderkey, ' Handicap') ELSE concat('Race ', o_orderkey) END AS race_name
CASE WHEN o_orderkey % 4 < 2 THEN 'Flat' WHEN o_orderkey % 4 = 2 THEN 'Hurdle' ELSE 'Chase' END AS race_type
o_orderstatus AS class
CASE o_orderkey % 5 WHEN 0 THEN 'Group 1' WHEN 1 THEN 'Listed' WHEN 2 THEN 'Listed' END AS pattern
CAST(5 + o_orderkey % 12 AS DOUBLE) AS dist_f
CASE o_custkey % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'Good To Soft' WHEN 2 THEN 'Heavy' ELSE 'Standard' END AS going
CASE WHEN o_custkey % 5 = 0 THEN 'AW' ELSE 'Turf' END AS surface
CAST(1 + o_custkey % 7 AS INT) AS ran
o_totalprice AS prize_fund""".split("\n")

RUNNERS = """l_orderkey AS race_id
l_partkey AS horse_id
l_suppkey AS trainer_id
(l_partkey * 7 + l_suppkey) % 150 AS jockey_id
l_linenumber AS num
l_linenumber AS draw
CASE WHEN l_quantity % 10 = 9 THEN NULL ELSE l_linenumber END AS pos_num
CASE WHEN l_quantity % 10 <> 9 THEN CAST(l_linenumber AS STRING) WHEN l_tax <= 0.04 THEN 'PU' END AS pos_raw
l_quantity % 10 <> 9 AND l_linenumber = 1 AS win_flag
CASE WHEN l_quantity % 10 <> 9 AND l_linenumber = 1 THEN 1 ELSE 0 END AS win_lose
CASE WHEN l_quantity % 10 <> 9 THEN l_discount * 40 END AS btn
CASE WHEN l_quantity % 7 <> 0 THEN CAST(l_quantity AS INT) + 40 END AS official
CASE WHEN l_quantity % 5 <> 0 THEN CAST(l_quantity * 2 % 61 AS INT) + 50 END AS rpr
1 + l_extendedprice / 5000 AS win_bsp
CASE WHEN l_discount > 0 THEN 1 + l_extendedprice / 5500 END AS dec_price
1 + l_extendedprice / 5200 AS win_ppwap
(1 + l_extendedprice / 5000) * (0.8 + l_tax * 8) AS win_ppmax
(1 + l_extendedprice / 5000) * (0.9 - l_tax) AS win_ppmin
(1 + l_extendedprice / 5000) * (1 - l_discount * 9) AS win_ipmin
(1 + l_extendedprice / 5000) * (1 + l_tax * 10) AS win_ipmax
1 + l_extendedprice / 20000 AS place_bsp
l_extendedprice * l_quantity AS pre_vol
l_extendedprice / 10 AS prize""".split("\n")

HORSES = ["p_partkey AS horse_id", "concat(p_name, ' ', p_partkey) AS horse_name", "p_brand AS sire", "p_type AS dam", "CAST(p_size AS STRING) AS damsire"]
TRAINERS = ["s_suppkey AS trainer_id", "s_name AS trainer_name"]
JOCKEYS = ["c_custkey AS jockey_id", "c_name AS jockey_name"]
OWNERS = ["c_custkey AS owner_id", "concat(c_mktsegment, ' Widget ', c_custkey) AS owner_name"]
COURSES = ["CAST(n_nationkey AS BIGINT) AS course_id", "n_name AS course_name", "n_regionkey AS region_id"]

_VIEWS = {"races": ("orders", RACES), "runners": ("lineitem", RUNNERS), "horses": ("part", HORSES), "trainers": ("supplier", TRAINERS), "jockeys": ("customer", JOCKEYS), "owners": ("customer", OWNERS), "courses": ("nation", COURSES)}

#: Common table expressions of the same views.
VIEWS_SQL = ",\n".join(f"{name} AS (SELECT {', '.join(columns)} FROM {table})" for name, (table, columns) in _VIEWS.items())


#: Bytes of the facts' files whose rows one task holds, about.
PART_BYTES = 8 << 20


def with_racing(sql: str) -> str:
    """SQL over the views; ``sql`` may start with its own WITH."""
    sql = sql.strip()
    if sql[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {VIEWS_SQL},\n{sql[14:]}"
    return f"WITH {VIEWS_SQL},\n{sql[4:]}" if sql[:5].upper().split()[0] == "WITH" else f"WITH {VIEWS_SQL}\n{sql}"


class Racing:
    """Facts and dimensions; dimensions are small and joined by broadcast where Spark finds them so.

    Each is a frame, or a function that gives it when it is first asked for: a report opens the
    tables that it reads and no others.
    """

    races: DataFrame
    runners: DataFrame
    horses: DataFrame
    trainers: DataFrame
    jockeys: DataFrame
    owners: DataFrame
    courses: DataFrame

    def __init__(self, spark: SparkSession, paths: dict[str, str] | None = None, **frames: DataFrame | Callable[[], DataFrame]):
        self.spark, self.paths, self._frames = spark, paths or {}, frames

    def __getattr__(self, name: str) -> DataFrame:
        frame = self.__dict__.get("_frames", {}).get(name)
        if frame is None:
            raise AttributeError(name)
        frame = frame if isinstance(frame, DataFrame) else frame()
        setattr(self, name, frame)
        return frame

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Racing:
        paths = {name: f"{sf_dir}/{table}.parquet" for name, (table, _) in _VIEWS.items()}
        return cls(spark, paths, **{name: partial(_view, spark, paths[name], columns) for name, (_, columns) in _VIEWS.items()})

    def state(self, *tables: str) -> tuple[str, int]:
        """A name for what tables are now, by their files and, where they are no plain views, their plans; and the files' bytes."""
        files = [p for t in tables for p in ([self.paths[t]] if t in self.paths else getattr(self, t).inputFiles())]
        name, size = state_of(self.spark, files)
        plans = [f"{t}{getattr(self, t).semanticHash()}" for t in tables if t not in self.paths]
        return hashlib.sha256("|".join([name, *plans]).encode()).hexdigest()[:16], size

    def raw(self, name: str) -> tuple[DataFrame, dict[str, str]]:
        """A table as its files hold it, and its columns as expressions over that.

        What is shuffled or stored is then what the files hold: many columns come from few of theirs.
        A frame that is no plain view is its own.
        """
        if name not in self.paths:
            rows = getattr(self, name)
            return rows, {c: f"`{c}`" for c in rows.columns}
        columns = dict(reversed(c.rsplit(" AS ", 1)) for c in _VIEWS[name][1])
        rows = self.spark.read.parquet(self.paths[name])
        return rows.select(*read_by(rows, columns, *columns)), columns

    def parts(self, *tables: str) -> int:
        """Into how many partitions rows of these tables are dealt: so many that a task holds no more where the files grow."""
        return max(self.spark.sparkContext.defaultParallelism, self.state(*tables)[1] // PART_BYTES)

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of the facts by a key, so many in a task whatever the size of the facts."""
        return rows.repartition(self.parts("races", "runners"), key)

    def with_races(self, runners: DataFrame, races: DataFrame, key: str = "race_id") -> DataFrame:
        """Runners with their races, both dealt by race: no task holds all races, so its memory does not grow with them."""
        return self.dealt(runners, key).join(races.hint("merge"), key)

    def having(self, **frames: DataFrame) -> Racing:
        """The same warehouse with other frames for some of its tables."""
        return Racing(self.spark, {n: p for n, p in self.paths.items() if n not in frames}, **{**self._frames, **frames})

    @cached_property
    def base(self) -> DataFrame:
        """Each runner with its race: the snapshot that profile queries read."""
        return self.runners.join(self.races, "race_id")


def read_by(rows: DataFrame, columns: dict[str, str], *names: str) -> list[str]:
    """Those columns of a raw table that some of the table's columns come from."""
    return [c for c in rows.columns if any(re.search(rf"\b{c}\b", columns[n]) for n in names)]


def selected(columns: dict[str, str]) -> list[str]:
    """The select list of the columns of a raw table."""
    return [f"{e} AS {c}" for c, e in columns.items()]


def _view(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).selectExpr(*columns)
