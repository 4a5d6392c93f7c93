"""The feedback log as a stream: windows, exposures that wait for feedback, and counters of sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.session import new_folder
from ..sources.model import PROJECTION


def read(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """The feedback rows of the event files in a folder, with their time as ``at``; new files are new rows."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/events*.parquet")  # files or folders of them
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = spark.sql(PROJECTION["feedback"].replace("FROM events", "FROM {events}").replace("FROM documents", "FROM {documents}"), events=events, documents=documents)
    return rows.withColumn("at", F.timestamp_seconds("created_at"))


def window_rollup(feedback: DataFrame, seconds: int, late: int) -> DataFrame:
    """Feedback of each source in windows of time; a window comes out once, when rows ``late`` seconds later have been seen."""
    kept = feedback.withWatermark("at", f"{late} seconds").groupBy(F.window("at", f"{seconds} seconds").alias("w"), "source")
    rows = kept.agg(F.count("*").alias("n"), F.round(F.avg("valence"), 6).alias("mean_valence"))
    return rows.select(F.unix_timestamp("w.start").alias("start"), "source", "n", "mean_valence")


def answered_exposures(feedback: DataFrame, other: DataFrame, grace: int, late: int, passive: str = "view") -> DataFrame:
    """Exposures with each explicit feedback on the same belief within ``grace`` seconds; both sides' state ends with the watermark."""
    shown = feedback.where(F.col("source") == passive).withWatermark("at", f"{late} seconds")
    shown = shown.select("feedback_id", F.col("belief_id").alias("shown_id"), F.col("at").alias("shown_at"))
    said = other.where(F.col("source") != passive).withWatermark("at", f"{late} seconds").select("belief_id", F.col("feedback_id").alias("answer_id"), "at")
    within = (F.col("belief_id") == F.col("shown_id")) & (F.col("at") >= F.col("shown_at")) & (F.col("at") <= F.col("shown_at") + F.expr(f"INTERVAL {grace} SECONDS"))
    return shown.join(said, within).select("feedback_id", "belief_id", "answer_id")


def first_in_window(feedback: DataFrame, late: int) -> DataFrame:
    """Rows without repeats of a ``feedback_id`` that come within ``late`` seconds of each other."""
    return feedback.withWatermark("at", f"{late} seconds").dropDuplicatesWithinWatermark(["feedback_id"]).drop("at")


def session_counters(feedback: DataFrame) -> DataFrame:
    """Each event's number in its session; the state of a session is one number, which later batches go on from.

    A session's rows of one batch are sorted together: ``files_per_trigger`` bounds them.
    """

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        ids = sorted(i for frame in frames for i in frame["feedback_id"])
        state.update((seen + len(ids),))
        yield pd.DataFrame({"session_id": key[0], "feedback_id": ids, "fire_idx": range(seen + 1, seen + len(ids) + 1)})

    rows = feedback.select("session_id", "feedback_id").groupBy("session_id")
    return rows.applyInPandasWithState(number, "session_id long, feedback_id long, fire_idx long", "seen long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream has now, as written by its sink."""
    spark, out = stream.sparkSession, new_folder(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
