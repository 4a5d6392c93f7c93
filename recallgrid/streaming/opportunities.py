"""Opportunities to ask for a belief that isn't there, found turn by turn: one for each reason and topic, a few for each session.

A session's state is a value (when it was last seen, how many it had) and a map of the topics it had. A session that was silent for
longer than ``idle`` begins anew; a timer drops the state of those that never come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.session import new_folder

# Reasons in the order in which they take a session's budget, and the budget.
REASONS = ("gap", "new_entity", "contradiction")
MOST_FIRES = 3

FOUND = "session_id long, feedback_id long, reason string, topic string"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def candidates(feedback: DataFrame, reason: Column, topic: Column) -> DataFrame:
    """(``session_id``, ``feedback_id``, ``at``, ``reason``, ``topic``) of the rows that have a reason; all rows, as a turn without one shows that its session lives."""
    return feedback.select("session_id", "feedback_id", "at", reason.alias("reason"), topic.alias("topic"))


class Opportunities(StatefulProcessor):
    def __init__(self, most: int, idle: int):
        self.most, self.idle = most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", T.StructType().add("last_at", "long").add("fires", "long"))
        self.seen = handle.getMapState("seen", T.StructType().add("topic", "string"), T.StructType().add("feedback_id", "long"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        frame = pd.concat(list(rows)).sort_values("feedback_id")
        known = self.session.get() if self.session.exists() else None
        last, fires = (known[0], known[1]) if known is not None else (None, 0)
        found = []
        for row in frame.itertuples(index=False):
            at = int(row.seconds)
            if last is not None and at - last > self.idle:
                self.seen.clear()
                last, fires = None, 0
            # What was contradicted before the session began is no news: its first turn sets the baseline.
            counts = row.reason in REASONS and not (row.reason == "contradiction" and last is None)
            if counts and fires < self.most:
                topic = f"{row.reason}:{row.topic}"
                if not self.seen.containsKey((topic,)):
                    self.seen.updateValue((topic,), (int(row.feedback_id),))
                    found.append((key[0], row.feedback_id, row.reason, row.topic))
                    fires += 1
            last = at
        self.session.update((last, fires))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((last + self.idle) * 1000 + 1)
        yield pd.DataFrame(found, columns=["session_id", "feedback_id", "reason", "topic"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.session.clear()
        self.seen.clear()
        yield pd.DataFrame({"session_id": [], "feedback_id": [], "reason": [], "topic": []}).astype({"session_id": "int64", "feedback_id": "int64", "reason": "str", "topic": "str"})

    def close(self) -> None:
        pass


def opportunities(rows: DataFrame, idle: int, late: int, most: int = MOST_FIRES) -> DataFrame:
    """Of a stream of candidates those that fire. Rows of a session are taken in order of ``feedback_id`` within a batch; those of one batch are sorted together."""
    keyed = rows.withColumn("seconds", F.unix_timestamp("at")).withWatermark("at", f"{late} seconds").groupBy("session_id")
    return keyed.transformWithStateInPandas(Opportunities(most, idle), FOUND, "Append", "EventTime")


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """All that the stream has now, as written by its sink; with the folder of an earlier run it goes on from there. Its state is kept in RocksDB, which
    the session is set to only while the query starts."""
    spark, out = stream.sparkSession, folder or new_folder(stream.sparkSession, name)
    option = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option, None)
    spark.conf.set(option, _ROCKSDB)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(option) if before is None else spark.conf.set(option, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
