"""The facts by month: catalog tables that date-bounded reports prune, bucketed so that races meet runners in place.

Both facts lie in folders by ``race_month`` and, within them, in buckets by ``race_id``. A report on
some days reads their months' files only, since the month is a partition column of the runners too,
and its join by race needs no exchange, since both sides come in equal buckets. The tables hold the
columns of the warehouse's files; the facts' columns are worked out as they are read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railside.plans.racing import Racing, selected
from railside.plans.scratch import scratch

#: Bytes that one bucket of all months holds, about: what a task reads that joins a bucket over a range of whatever length.
BUCKET_BYTES = 128 << 20
#: Stands in the tables' names: a new number where their columns change.
FORMAT = 2
#: Dimensions whose names stand in the reports.
DIMENSIONS = ("courses", "horses")


def month_of(day: Column | str) -> Column:
    return F.year(day) * 100 + F.month(day)


def stored(r: Racing, name: str, tables: list[str], build: Callable[[], DataFrame], day: Column) -> DataFrame:
    """The rows of ``build`` as a catalog table by the month of a day, made once for the files that ``tables`` come from."""
    table = f"railside_{name}_{FORMAT}_{r.state(*tables)[0]}"
    if not r.spark.catalog.tableExists(table):
        rows = build().withColumn("row_month", month_of(day))
        rows.hint("rebalance", "row_month").write.partitionBy("row_month").mode("overwrite").option("path", scratch(r.spark, table)).saveAsTable(table)
    return r.spark.table(table)


def in_months(rows: DataFrame, month: str, date_from: str | None, date_to: str | None) -> DataFrame:
    """The months' rows that an inclusive range of days touches: a filter that prunes folders."""
    for bound, side in ((date_from, F.col(month).__ge__), (date_to, F.col(month).__le__)):
        if bound:
            at = date.fromisoformat(bound)
            rows = rows.where(side(at.year * 100 + at.month))
    return rows


class MonthStore:
    """``races`` and ``runners`` of one warehouse by month and bucket, and the dimensions that reports name.

    Runners without a race, and races without a day, have no month and are not held. Tables are made once for the files that they come from and found again by those files' names,
    lengths and times: changed files make new tables.
    """

    def __init__(self, r: Racing, buckets: int | None = None):
        self.spark = r.spark
        name, size = r.state("races", "runners", *DIMENSIONS)
        name = f"{FORMAT}_{name}" + (f"_{buckets}" if buckets else "")
        self.races, self.runners, *dimensions = (f"railside_{t}_{name}" for t in ("races", "runners", *DIMENSIONS))
        self.dimensions = dict(zip(DIMENSIONS, dimensions, strict=True))
        (races, self._races), (runners, self._runners) = r.raw("races"), r.raw("runners")
        if not self.spark.catalog.tableExists(self.runners):
            race, runner = self._races["race_id"].strip("`"), self._runners["race_id"].strip("`")
            day = F.expr(self._races["race_date"])
            known = races.where(day.isNotNull()).withColumn("race_month", month_of(day))
            self.buckets, self.parts = buckets or max(1, size // BUCKET_BYTES), r.parts("races", "runners")
            for dimension, table in self.dimensions.items():
                getattr(r, dimension).write.mode("overwrite").option("path", scratch(self.spark, table)).saveAsTable(table)
            self._save(known, self.races, race)
            months = known.select(F.col(race).alias(runner), "race_month")
            self._save(r.with_races(runners, months, runner), self.runners, runner)

    def _save(self, rows: DataFrame, name: str, key: str) -> None:
        # one file for each month and bucket, written by one task
        dealt = rows.repartition(self.parts, F.col("race_month"), F.pmod(F.hash(key), F.lit(self.buckets)))
        writer = dealt.write.partitionBy("race_month").bucketBy(self.buckets, key).sortBy(key)
        writer.mode("overwrite").option("path", scratch(self.spark, name)).saveAsTable(name)

    def _read(self) -> tuple[DataFrame, DataFrame]:
        """Races and runners with their months."""
        tables = ((self.races, self._races), (self.runners, self._runners))
        return tuple(self.spark.table(t).selectExpr(*selected(columns), "race_month") for t, columns in tables)

    def between(self, r: Racing, date_from: str | None, date_to: str | None) -> Racing:
        """The warehouse with the facts of an inclusive range of days."""
        races, runners = (in_months(rows, "race_month", date_from, date_to) for rows in self._read())
        for bound, side in ((date_from, F.col("race_date").__ge__), (date_to, F.col("race_date").__le__)):
            races = races.where(side(F.lit(date.fromisoformat(bound)))) if bound else races
        named = {dimension: self.spark.table(table) for dimension, table in self.dimensions.items()}
        return r.having(races=races.drop("race_month"), runners=runners.drop("race_month"), **named)

    def of_races(self, condition: Column) -> DataFrame:
        """Runners with their races, of the races that meet a condition on whatever column.

        Which months these lie in is found at run time: the runners' scan waits for it and reads no
        others' files (dynamic partition pruning), as long as the races are few enough to be broadcast.
        """
        races, runners = self._read()
        return runners.join(races.where(condition), ["race_month", "race_id"]).drop("race_month")
