"""Run telemetry as streams: events from JSON lines, running counters, state of each run, and windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylake.session import shared_dir

EVENT = "type string, run_id string, site string, rank int, stage string, status string, processed bigint, total bigint, total_sites bigint, kept_sites bigint, status_counts map<string,bigint>, timestamp string"


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, log lines) of text lines: a JSON object with a ``type`` is an event, everything else a log line."""
    d = lines.withColumn("e", F.from_json("value", EVENT)).withColumn("is_event", F.try_parse_json("value").isNotNull() & F.col("e.type").isNotNull())
    events = d.where("is_event").select("e.*").withColumn("ts", F.try_to_timestamp("timestamp"))
    return events, d.where("not is_event").select("value")


def progress(events: DataFrame) -> DataFrame:
    """``run_id, status, n``: finished sites by status, batch or stream (complete or update mode)."""
    return events.where("type = 'site_finished'").groupBy("run_id", F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def run_states(events: DataFrame) -> DataFrame:
    """One row per run: the latest stage, site and counters, and whether it is running."""
    last = lambda c, cond: F.expr(f"max_by({c}, timestamp) FILTER (WHERE {cond})")
    return events.groupBy("run_id").agg(
        last("site", "site is not null").alias("latest_site"), last("stage", "type = 'site_stage'").alias("latest_stage"), last("processed", "processed is not null").alias("processed"),
        last("total", "total is not null").alias("total"), last("type <> 'run_completed'", "type in ('run_started', 'run_completed')").alias("running"), F.max("timestamp").alias("updated_at"),
    )


def tail(events: DataFrame, ts: str, k: int = 50) -> DataFrame:
    """The last ``k`` rows, newest first."""
    return events.orderBy(F.col(ts).desc()).limit(k)


def event_counts(events: DataFrame, by: str = "event_type") -> DataFrame:
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def distinct_events(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within the time that late rows are waited for."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, ts: str, width: str, by: str, late: str = "1 day") -> DataFrame:
    """Counts per window and key; an extension beside the run's own events."""
    g = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: str, late: str = "1 day") -> DataFrame:
    """Counts per session of a key."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("session_start"), by, "n")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    Complete results replace each other, appended ones add up; both are written as parquet to the shared folder.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/policylake/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(df: DataFrame, epoch: int) -> None:
        # The same epoch writes the same folder again, so a repeated batch adds nothing.
        df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    names = stream.columns
    d = spark.read.schema(stream.schema if mode == "complete" else T.StructType([*stream.schema.fields, T.StructField("epoch", T.IntegerType())])).parquet(out) if q.lastProgress else spark.createDataFrame([], stream.schema)
    return d.select(*names)


def file_stream(spark: SparkSession, folder: str, schema, glob: str) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder)


def emit(df: DataFrame, sink: Callable[[str], None] = print) -> None:
    """Rows as JSON lines to a sink, one at a time; for a bounded number of events."""
    for line in df.toJSON().toLocalIterator():
        sink(line)
