"""An audit log of JSON lines that is followed as a stream, and the ring of each key that starts afresh with a new session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A ring holds so many.
RING_MAX = 200


def parsed(lines: DataFrame, kind: str, since: int | None = None, filters: dict[str, str] | None = None) -> DataFrame:
    """The records of lines (``value``) that are JSON objects, by a schema that has ``ts`` (seconds); blank and broken lines are left out, and what
    follows a whole object on its line. ``since``: records of an earlier
    time, or without one, are left out; ``filters``: so are those whose fields have other values."""
    found = lines.where(F.trim("value").startswith("{")).select(F.from_json("value", f"{kind}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r")).where("r._broken IS NULL")
    rows = found.select("r.*").drop("_broken")
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    for name, value in (filters or {}).items():
        rows = rows.where(F.col(name).cast("string") == value)
    return rows


def followed(spark: SparkSession, folder: str, kind: str, since: int | None = None, filters: dict[str, str] | None = None, files_per_trigger: int = 64) -> DataFrame:
    """The same of the files in a folder as a stream; a rotated file and the one that follows it are two files, each read once."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder), kind, since, filters)


def rings(rows: DataFrame, key: Column, session: Column, number: Column, ring_max: int = RING_MAX) -> DataFrame:
    """For each event (``key``, ``session``, ``n``) the place it has in its session (``fire_idx`` from 0), how many the ring holds after it and how many fell out: an event whose
    session isn't that of the key's last event starts a fresh ring.

    The state of a key is its session and how many events that had, whatever the ring's size. A key's rows of one batch are
    sorted together; later batches have greater numbers.
    """

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, 0)
        frame = pd.concat(list(frames)).sort_values("n")
        places = []
        for now in frame["session"].tolist():
            last, seen = now, seen + 1 if now == last else 1
            places.append(seen)
        state.update((last, seen))
        at = pd.Series(places, dtype="int64")
        yield pd.DataFrame({"key": of[0], "n": frame["n"].to_numpy(), "session": frame["session"].to_numpy(), "fire_idx": at - 1, "held": at.clip(upper=ring_max), "evicted": (at - ring_max).clip(lower=0)})

    keyed = rows.select(key.cast("long").alias("key"), session.cast("string").alias("session"), number.cast("long").alias("n")).groupBy("key")
    return keyed.applyInPandasWithState(step, "key long, n long, session string, fire_idx long, held long, evicted long", "session string, seen long", "append", GroupStateTimeout.NoTimeout)
