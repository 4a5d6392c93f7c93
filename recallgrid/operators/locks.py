"""Locks that candidates contradict in a value, without pairing all values of a key.

For a number the values within the tolerance make an interval around it, so the first lock outside it is one that is less, or greater,
than all locks before it: only those that set such a record are joined. For words of state the locks of a category are joined by
the distinct sets of groups that they name, of which the vocabulary allows a few. The lock that conflicts is sought once for each distinct
value or set of groups of the candidates, so that a key that all of them have costs no pairs of candidates and locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect
from ..plans.session import new_folder

# Keys that name versions, years of the calendar, and how far apart close numbers may be.
VERSION_KEYS = ("v", "version", "rev", "release")
FIRST_YEAR, LAST_YEAR = 1900, 2100
TOLERANCE = 0.01
#: Parts that the locks of a key are dealt into before their records are sought.
PARTS = 64


def annotation_slots(text: Column) -> Column:
    """(``numbers``: ``key``, ``value``; ``states``: ``category``, ``groups``) of a text that can show a conflict: keys with several values, of versions and with years
    of the calendar are left out."""

    def filtered(x: Column) -> Column:
        def says_one(s: Column) -> Column:
            return ~F.exists(x["n"], lambda o: (o["key"] == s["key"]) & (F.round(o["value"], 12) != F.round(s["value"], 12)))

        year = lambda v: (v == F.floor(v)) & v.between(FIRST_YEAR, LAST_YEAR)
        numbers = F.filter(x["n"], lambda s: says_one(s) & ~s["key"].isin(*VERSION_KEYS) & ~year(s["value"]))
        categories = F.array_distinct(F.transform(x["e"], lambda s: s["category"]))
        groups = F.transform(categories, lambda c: F.struct(c.alias("category"), F.array_sort(F.array_distinct(F.transform(F.filter(x["e"], lambda s: s["category"] == c), lambda s: s["group_id"]))).alias("groups")))
        return F.struct(numbers.alias("numbers"), groups.alias("states"))

    # The step stands in an array of one element, so that slots are made once.
    return F.get(F.transform(F.array(F.struct(detect.numeric_slots(text).alias("n"), detect.enum_slots(text).alias("e"))), filtered), F.lit(0))


def close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return (a == b) | (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))


def _records(rows: DataFrame) -> DataFrame:
    """Of (``key``, ``value``, ``rank``, ``lock_id``) those whose value is less, or greater, than all of the key's before them. A record of all is one of any part, so that
    parts are searched first."""

    def within(df: DataFrame, *by: str) -> DataFrame:
        before = Window.partitionBy("key", *by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        least, most = F.min("value").over(before), F.max("value").over(before)
        return df.withColumns({"_least": least, "_most": most}).where("_least IS NULL OR value < _least OR value > _most").drop("_least", "_most")

    first = rows.groupBy("key", "value").agg(F.min(F.struct("rank", "lock_id")).alias("f")).select("key", "value", "f.*")
    return within(within(first.withColumn("_part", F.pmod(F.xxhash64("lock_id"), F.lit(PARTS))), "_part").drop("_part"))


def conflicting_locks(candidates: DataFrame, locks: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(``id``, ``lock_id``): for each candidate (``id``, ``text``) that contradicts a lock (``lock_id``, ``rank``, ``text``) in a slot the first such lock by ``rank``. Candidates without a
    conflict are left out. Numbers of one key conflict where they aren't close, states of one category where they share no group."""
    # Slots are written, as numbers and states are both read from them and the patterns are what costs.
    folder = new_folder(candidates.sparkSession, "slots")
    candidates.select("id", annotation_slots(F.col("text")).alias("s")).write.parquet(f"{folder}/candidates")
    locks.select("lock_id", "rank", annotation_slots(F.col("text")).alias("s")).write.parquet(f"{folder}/locks")
    c, k = (candidates.sparkSession.read.parquet(f"{folder}/{n}") for n in ("candidates", "locks"))
    first = F.min(F.struct("rank", "lock_id")).alias("f")
    numbers = c.select("id", F.explode("s.numbers").alias("n")).select("id", "n.key", F.col("n.value").alias("own"))
    records = _records(k.select("lock_id", "rank", F.explode("s.numbers").alias("n")).select("lock_id", "rank", "n.key", "n.value"))
    met = numbers.select("key", "own").distinct().join(records, "key").where(~close(F.col("own"), F.col("value"), tolerance)).groupBy("key", "own").agg(first)
    by_number = numbers.join(met, ["key", "own"]).select("id", "f.*")
    states = c.select("id", F.explode("s.states").alias("e")).select("id", "e.category", F.col("e.groups").alias("own"))
    sets = k.select("lock_id", "rank", F.explode("s.states").alias("e")).groupBy("e.category", "e.groups").agg(first)
    apart = states.select("category", "own").distinct().join(sets.select("category", "groups", "f.*"), "category").where(~F.arrays_overlap("own", "groups")).groupBy("category", "own").agg(first)
    by_state = states.join(F.broadcast(apart), ["category", "own"]).select("id", "f.*")
    both = by_number.select("id", "rank", "lock_id").unionByName(by_state.select("id", "rank", "lock_id"))
    return both.groupBy("id").agg(F.min(F.struct("rank", "lock_id"))["lock_id"].alias("lock_id"))
