"""Streaming jobs on forecast readings.

The operators take a streaming table (aoi_id, valid_time, heat_index_c, ...) and
return a streaming table; ``run_available`` processes what is there and returns
the result as a batch table.  Every operator states a watermark, so state is
bounded by the lateness that is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from heatloom import constants as C
from heatloom.functions.heat import heat_index
from heatloom.operators.rundir import run_dir

LATENESS = "2 days"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_forecast_stream(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 1_000
) -> DataFrame:
    """Forecast files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def with_stream_heat_index(readings: DataFrame) -> DataFrame:
    return readings.withColumn("heat_index_c", heat_index(F.col("t2m_c"), F.col("rh_pct")))


def stream_daily_max(readings: DataFrame, lateness: str = LATENESS, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Highest heat index per day."""
    w = F.window("valid_time", "1 day")
    return readings.withWatermark("valid_time", lateness).groupBy(*by, w).agg(
        F.max("heat_index_c").alias("max_hi")
    ).select(*by, F.to_date("window.start").alias("day"), "max_hi")


def stream_rolling_hi(readings: DataFrame, lateness: str = LATENESS, by: Sequence[str] = ("aoi_id",)) -> DataFrame:
    """Mean heat index over three days, starting every day."""
    w = F.window("valid_time", "3 days", "1 day")
    return readings.withWatermark("valid_time", lateness).groupBy(*by, w).agg(
        F.avg("heat_index_c").alias("mean_hi"), F.count(F.lit(1)).alias("n")
    ).select(*by, F.to_date("window.start").alias("start_day"), "mean_hi", "n")


def stream_heat_episodes(
    readings: DataFrame, threshold: float, gap: str = "1 day", lateness: str = LATENESS, by: Sequence[str] = ("aoi_id",)
) -> DataFrame:
    """Sessions of hot readings that lie at most ``gap`` apart, for append mode.

    A session is written once, when the watermark passes its end, and its state is
    dropped then.  All readings move the watermark, cool ones too, so an area's last
    session is closed by whatever comes after it.
    """
    timed = readings.withWatermark("valid_time", lateness)
    # A condition that reads the event time stays above the watermark; a plain one would be
    # pushed below it, and then hot readings alone would close sessions.
    hot = timed.where(F.when(F.unix_micros("valid_time") > F.lit(-(2**63)), F.col("heat_index_c") > threshold))
    s = F.session_window("valid_time", gap)
    return hot.groupBy(*by, s).agg(F.count(F.lit(1)).alias("n"), F.max("heat_index_c").alias("max_hi")).select(
        *by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "max_hi"
    )


def stream_latest_run(
    readings: DataFrame, values: Sequence[str], run: str = "run_time", lateness: str = LATENESS, by: Sequence[str] = ("aoi_id",)
) -> DataFrame:
    """Reading of the newest forecast run per valid time."""
    latest = F.max_by(F.struct(run, *values), run).alias("r")
    return readings.withWatermark("valid_time", lateness).groupBy(*by, "valid_time").agg(latest).select(
        *by, "valid_time", "r.*"
    )


class HotRuns(StatefulProcessor):
    """Runs of consecutive hot days of one area, as intervals of days.

    A run stays in the state while a reading that is not late can still lengthen or join
    it: until the watermark reaches ``until``, the end of the day after its last one.  A
    timer at the earliest such moment drops what is over; an area without open runs has
    no state and no timer.
    """

    def __init__(self, by: str, min_days: int):
        self.by, self.min_days = by, min_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        days, times = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
        self.runs = handle.getValueState("runs", T.StructType([
            T.StructField("starts", days), T.StructField("ends", days), T.StructField("untils", times)]))

    def _keep(self, runs: list[tuple[int, int, int]], watermark: int) -> None:
        """Store the runs that are open, with a timer for the first one to end."""
        open_runs = [r for r in runs if r[2] > watermark]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not open_runs:
            self.runs.clear()
            return
        self.runs.update(tuple([int(r[i]) for r in open_runs] for i in range(3)))
        self.handle.registerTimer(min(int(r[2]) for r in open_runs))

    def _stored(self) -> list[tuple[int, int, int]]:
        return list(zip(*self.runs.get())) if self.runs.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = self._stored()
        for pdf in rows:
            days = pdf.drop_duplicates("day")
            runs += [(int(d), int(d), int(u)) for d, u in zip(days["day"], days["until"])]
        joined: list[tuple[int, int, int]] = []
        for start, end, until in sorted(runs):
            if joined and start <= joined[-1][1] + 1:
                first, last, over = joined[-1]
                joined[-1] = (first, max(end, last), max(until, over))
            else:
                joined.append((start, end, until))
        self._keep(joined, timerValues.getCurrentWatermarkInMs())
        first, last, _ = joined[-1]
        days = last - first + 1
        yield pd.DataFrame({self.by: [key[0]], "last_day": [last], "run_days": [days], "alert": [days >= self.min_days]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._stored(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def stream_heatwave_alert(
    readings: DataFrame, threshold: float, min_days: int = C.HEATWAVE_DAYS, lateness: str = LATENESS, by: str = "aoi_id",
) -> DataFrame:
    """Current run of consecutive hot days per area, with an alert flag; a row per area and batch with hot readings.

    Readings that arrive late or out of order, but within ``lateness``, still lengthen
    or join runs.  What no such reading can change any more leaves the state (see
    ``HotRuns``), so the state is bounded by the lateness, and a quiet area keeps none.
    Readings are reduced to hot days before they reach Python.  The query needs the
    RocksDB state store (``run_available(..., state_store=ROCKSDB)``).
    """
    timed = readings.withWatermark("valid_time", lateness)
    hot = timed.where(F.when(F.unix_micros("valid_time") > F.lit(-(2**63)), F.col("heat_index_c") > threshold))
    day = F.to_date("valid_time")
    days = hot.select(
        by, "valid_time", F.datediff(day, F.lit("1970-01-01").cast("date")).alias("day"),
        F.unix_millis((day + F.expr("interval 2 days")).cast("timestamp")).alias("until"))
    out = T.StructType([
        days.schema[by], T.StructField("last_day", T.IntegerType()),
        T.StructField("run_days", T.IntegerType()), T.StructField("alert", T.BooleanType()),
    ])
    return days.groupBy(by).transformWithStateInPandas(HotRuns(by, min_days), out, "Update", "EventTime")


def run_batches(stream: DataFrame, folder: str, mode: str = "update", state_store: str | None = None) -> StreamingQuery:
    """Process everything that is available and return the finished query.

    Each micro-batch is written to ``<folder>/out/batch=<id>``, so a repeated batch
    replaces itself; called again with the same folder, the stream goes on where it
    stopped.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    if state_store:
        spark.conf.set(setting, state_store)  # a query takes the settings of its start
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).foreachBatch(sink).start()
        )
    finally:
        spark.conf.set(setting, before)
    query.awaitTermination()
    return query


def run_available(
    stream: DataFrame, name: str, keys: Sequence[str], mode: str = "update", folder: str | None = None, state_store: str | None = None,
) -> DataFrame:
    """Process everything that is available and return the final rows.

    In update mode the row of the latest batch holds per key, in complete mode the
    latest batch, and in append mode every row.
    """
    spark = stream.sparkSession
    folder = folder or run_dir(spark, name)
    schema = stream.schema
    run_batches(stream, folder, mode, state_store)
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(full).parquet(f"{folder}/out")
    if mode == "append":
        return written.select(*schema.names)
    if mode == "complete":
        last = written.agg(F.max("batch")).first()[0]
        return written.where(F.col("batch") == last).select(*schema.names)
    rest = [c for c in schema.names if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*schema.names)
