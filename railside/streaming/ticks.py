"""Live prices as a stream: ticks deduplicated within a watermark, and merged into the runner table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.plans.scratch import scratch
from railside.plans.snapshots import Snapshots
from railside.registry import table_query

TICK = "event_id long, ts timestamp, user_id long, value double"


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Tick files as a stream. A runner's tick of a time counts once; ticks over five minutes late may go."""
    ticks = spark.readStream.schema(TICK).parquet(path)
    return ticks.withWatermark("ts", "5 minutes").dropDuplicatesWithinWatermark(["user_id", "ts"])


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """All files that are there, through the stream, into a new table."""
    table, state = scratch(spark, "ticks"), scratch(spark, "state")
    query = tick_stream(spark, path).writeStream.format("parquet").option("path", table).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(TICK).parquet(table)


class Mirror:
    """Live prices in the runner table: every micro-batch of ticks is merged with what the table holds.

    The table has a row per day and runner: its price, highest and lowest so far, and when the
    price was seen (null for one that was loaded). A batch replaces the days that it touches, as a
    new version. Its number stands in that version's marks, so a batch that is run again changes
    nothing: neither one that died before its version was there nor one that died after.
    Late and repeated ticks are welcome, since newest, highest and lowest do not depend on order.
    """

    KEYS = ("day", "user_id")

    def __init__(self, table: Snapshots, stream: str):
        self.table, self.stream = table, stream

    @staticmethod
    def news(ticks: DataFrame) -> DataFrame:
        """What ticks with a price say by day and runner; newest, highest and lowest are partial aggregates.

        A price of 0 is none. Ticks without runner or time say nothing.
        """
        priced = ticks.where("user_id is not null and ts is not null and value > 0")
        known = priced.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"), F.max("value").alias("high"), F.min("value").alias("low"))
        return known.select("day", "user_id", F.col("m.ts").alias("seen"), F.col("m.event_id").alias("tick"), F.col("m.value").alias("value"), "high", "low")

    def apply(self, ticks: DataFrame, batch: int) -> None:
        """Merge one batch. Ticks of runners that the table does not hold are left out; no tick, no change."""
        base = self.table.manifest()
        done = base.marks.get("streams", {})
        if done.get(self.stream, -1) >= batch:
            return
        news = self.news(ticks).persist()
        try:
            days = [r.day for r in news.select("day").distinct().collect()]  # a row a day
            old = self.table.read(base, days).alias("o")
            both = old.join(news.alias("n"), list(self.KEYS), "left")
            # of two prices the newer; of one time, the tick with the larger number
            newer = F.col("n.seen").isNotNull() & (F.col("o.seen").isNull() | (F.struct("n.seen", "n.tick") > F.struct("o.seen", "o.tick")))
            choose = [F.when(newer, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("value", "seen", "tick")]
            merged = both.select("user_id", *choose, F.greatest("o.high", "n.high").alias("high"), F.least("o.low", "n.low").alias("low"), "day")
            self.table.replace(merged, days, {"streams": {**done, self.stream: batch}}, base)
        finally:
            news.unpersist()

    def run(self, ticks: DataFrame, checkpoint: str) -> None:
        """All ticks that are there, from where the checkpoint's last run ended."""
        query = ticks.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def loaded_prices(ticks: DataFrame) -> DataFrame:
    """The runner table as loaded before the stream: prices of unknown time."""
    return Mirror.news(ticks).select("user_id", "value", F.lit(None).cast("timestamp").alias("seen"), F.lit(None).cast("long").alias("tick"), "high", "low", "day")


@table_query("ticks_ingest", "SELECT event_id, user_id, round(value, 4) AS value FROM events")
def ticks_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, each row twice, streamed: every tick arrives once."""
    path = scratch(spark, "feed")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    events.unionByName(events).write.parquet(path)
    return ingest(spark, path).select("event_id", "user_id", F.round("value", 4).alias("value"))


_NOW = "2024-01-15 12:00:00"


@table_query(
    "ticks_mirror",
    """
WITH t AS (SELECT CAST(ts AS DATE) AS day, user_id, ts, event_id, value, hour(ts) < 12 AS loaded FROM events WHERE value > 0),
runners AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events),
old AS (SELECT day, user_id, arg_max(value, (ts, event_id)) FILTER (loaded) AS value, max(value) FILTER (loaded) AS high, min(value) FILTER (loaded) AS low FROM t GROUP BY 1, 2),
live AS (SELECT day, user_id, arg_max(value, (ts, event_id)) AS value, max(value) AS high, min(value) AS low, max(ts) AS seen FROM t WHERE NOT loaded GROUP BY 1, 2)
SELECT day, user_id, round(coalesce(live.value, old.value), 4) AS price, round(greatest(old.high, live.high), 4) AS highest, round(least(old.low, live.low), 4) AS lowest, seen FROM runners LEFT JOIN old USING (day, user_id) LEFT JOIN live USING (day, user_id)""",
)
def ticks_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mornings are loaded as the runner table; later ticks come in several files, every third one twice and late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    early, late = events.where("hour(ts) < 12"), events.where("hour(ts) >= 12")
    table = Snapshots(spark, scratch(spark, "runner_prices"), "day")
    runners = events.select(F.to_date("ts").alias("day"), "user_id").distinct()
    table.replace(runners.join(loaded_prices(early), list(Mirror.KEYS), "left").select("user_id", "value", "seen", "tick", "high", "low", "day"))
    feed = scratch(spark, "feed")
    for k in (1, 0, 2):  # file after file, each out of order with the others
        late.where(F.col("event_id") % 3 == k).unionByName(late.where(F.col("event_id") % 9 == k)).coalesce(1).write.mode("append").parquet(feed)
    state = scratch(spark, "state")
    ticks = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(feed)
    Mirror(table, state).run(ticks, state)
    return table.read().select("day", "user_id", F.round("value", 4).alias("price"), F.round("high", 4).alias("highest"), F.round("low", 4).alias("lowest"), "seen")


@table_query("ticks_active", f"SELECT event_id FROM events WHERE TIMESTAMP '{_NOW}' < ts + INTERVAL 30 MINUTE")
def active(spark: SparkSession, sf_dir: str, as_of: str = _NOW) -> DataFrame:
    """Markets that are not half an hour past their off."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(F.lit(as_of).cast("timestamp") < F.col("ts") + F.expr("INTERVAL 30 MINUTES")).select("event_id")


@table_query("price_staleness", f"SELECT count(*) AS prices, min(ts) AS oldest, count(*) FILTER (ts < TIMESTAMP '{_NOW}' - INTERVAL 60 MINUTE) AS stale FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("to_date(ts) = DATE '2024-01-15'")
    return rows.agg(F.count("*").alias("prices"), F.min("ts").alias("oldest"), F.count_if(F.col("ts") < F.lit(_NOW).cast("timestamp") - F.expr("INTERVAL 60 MINUTES")).alias("stale"))
