"""Operators in which the order of rows counts: the session spine, rings, ranks, budgets, cadences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import estimated_tokens
from ..sources.model import Store
from .scan import Ranges

SPINE_TYPE, SPINE_WEIGHT = "TEMPORAL_NEXT", 0.8


def session_order(store: Store) -> DataFrame:
    """Each belief with its place in its session."""
    return _in_session(store).places().select("session_id", "id", "place")


def _in_session(store: Store) -> Ranges:
    rows = store.beliefs.where("session_id IS NOT NULL").select("session_id", "id", "created_at", "seq")
    return Ranges(rows, ["session_id"], [F.col("created_at"), F.col("seq")])


def spine(store: Store) -> DataFrame:
    """An edge from each belief to the one before it in its session."""
    linked = _in_session(store).previous(dst="id").select(F.col("id").alias("src"), "dst")
    return linked.where("dst IS NOT NULL").withColumns({"type": F.lit(SPINE_TYPE), "weight": F.lit(SPINE_WEIGHT)})


def spine_divergence(store: Store, shipped: DataFrame) -> DataFrame:
    """How shipped spine edges differ from those of the full history: on both sides, only shipped, only recomputed."""
    a = shipped.select("src", "dst").distinct().withColumn("s", F.lit(1))
    b = spine(store).select("src", "dst").withColumn("r", F.lit(1))
    side = F.when(F.col("s").isNull(), "recomputed_only").when(F.col("r").isNull(), "shipped_only").otherwise("both")
    return a.join(b, ["src", "dst"], "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def value_places(rows: DataFrame, by: str, value: str) -> DataFrame:
    """For each group and value how many rows have it (``c``) and how many a lesser one (``before``). Rows are counted by value first, and the
    counts are summed over ranges, so that no task holds a group. Null values don't count."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    return Ranges(counts, [by], [F.col(value)]).running_sums(before=F.col("c")).withColumn("before", F.col("before") - F.col("c"))


def average_ranks(rows: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """Ranks from 1; equal values share the mean of their places."""
    places = value_places(rows, by, value).select(by, value, (F.col("before") + (F.col("c") + 1) / 2).alias("average_rank"))
    return rows.select(by, key, value).join(places, [by, value])


def budget_prefix(rows: DataFrame, by: str, order: list[Column], text: str, budget: int) -> DataFrame:
    """Rows of each group, in order, until the first that the token budget doesn't hold, without the text that they are priced by."""
    priced = rows.withColumn("tokens", estimated_tokens(F.col(text))).drop(text)
    return Ranges(priced, [by], order).running_sums(spent=F.col("tokens")).where(F.col("spent") <= budget)


def ring(rows: DataFrame, by: str, order: list[Column], size: int, place: bool = False) -> DataFrame:
    """The latest ``size`` rows of each group, with their ``place`` if that is asked for."""
    w = Window.partitionBy(by).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size)
    return kept.withColumnRenamed("_n", "place") if place else kept.drop("_n")


def correction_frequency(store: Store, window: int = 5, share: float = 0.4) -> DataFrame:
    """Feedback of each session at which negatives are ``share`` or more of the last ``window``."""
    w = Window.partitionBy("session_id").orderBy("feedback_id").rowsBetween(1 - window, 0)
    rows = store.feedback.select("session_id", "feedback_id", F.count_if(F.col("valence") < 0).over(w).alias("negatives"), F.count("*").over(w).alias("n"))
    return rows.where((F.col("n") >= window) & (F.col("negatives") / F.col("n") >= share))


def temporal_decay_rerank(rows: DataFrame, by: str, rank: str, age: str, half_life: float, locked: str) -> DataFrame:
    """New places: locked rows first as they were, the others by 1 / (rank + 1) * 2 ** (-age / half life)."""
    key = F.when(F.col(locked), F.lit(float("inf"))).otherwise(1 / (F.col(rank) + 1) * F.pow(F.lit(2.0), -F.col(age) / half_life))
    return Ranges(rows.withColumn("_key", key), [by], [F.desc("_key"), F.col(rank)]).places().drop("_key")


def consecutive_duplicates(turns: DataFrame) -> DataFrame:
    """Turns without those that repeat the role and text of the turn before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = (F.lag("text").over(w) == F.col("text")) & (F.lag("role").over(w) == F.col("role"))
    return turns.select("conv_id", "turn", "role", same.alias("_same")).where("_same IS NULL OR NOT _same").drop("_same")


def cadence(store: Store, every: int) -> DataFrame:
    """Feedback events of a session at which something falls due: each ``every``-th."""
    return _events(store, "feedback_id").where(F.col("fire_idx") % every == 0).select("session_id", "feedback_id", "fire_idx")


def _events(store: Store, *columns: str) -> DataFrame:
    """Feedback with its number in its session."""
    return Ranges(store.feedback.select("session_id", *columns), ["session_id"], [F.col("feedback_id")]).places("fire_idx")


def touches(store: Store, kinds: dict[str, int]) -> DataFrame:
    """State of each belief in each session: last touch (number of the event in the session), times, kinds as bits."""
    bit = F.lit(0)
    for name, b in kinds.items():
        bit = F.when(F.col("source") == name, b).otherwise(bit)
    rows = _events(store, "feedback_id", "belief_id", "source").select("session_id", "belief_id", "fire_idx", bit.alias("kind"))
    return rows.groupBy("session_id", "belief_id").agg(F.max("fire_idx").alias("last_fire"), F.count("*").alias("times"), F.bit_or("kind").alias("kinds"))


def hot(store: Store, kinds: dict[str, int], window: int) -> DataFrame:
    """Touched beliefs whose last touch is in the last ``window`` events of their session."""
    t = touches(store, kinds)
    latest = t.groupBy("session_id").agg(F.max("last_fire").alias("now"))
    return t.join(latest, "session_id").where(F.col("last_fire") >= F.col("now") - window).select("session_id", "belief_id", "last_fire")


def deferred(store: Store, now: int, grace: int = 1800, passive: str = "view") -> DataFrame:
    """Exposures whose grace is over at ``now``; ``cancelled`` where explicit feedback came within it."""
    from .relational import explicit_feedback_in_window

    due = store.feedback.where((F.col("source") == passive) & (F.col("created_at") <= now - grace)).select("feedback_id", "belief_id")
    hit = explicit_feedback_in_window(store, grace, passive).select("feedback_id", F.lit(True).alias("hit"))
    return due.join(hit, "feedback_id", "left").select("feedback_id", "belief_id", F.coalesce("hit", F.lit(False)).alias("cancelled"))


def window_rollup(store: Store, start: int, end: int) -> DataFrame:
    """Feedback in a span of time by source: how many, their mean valence and how many beliefs."""
    rows = store.feedback.where((F.col("created_at") >= start) & (F.col("created_at") < end))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("valence"), 6).alias("mean_valence"), F.countDistinct("belief_id").alias("beliefs"))


def posterior_fold(store: Store) -> DataFrame:
    """Evidence after all feedback: positive valence adds to alpha, negative to beta; locked beliefs keep theirs."""
    sums = store.feedback.groupBy(F.col("belief_id").alias("id")).agg(F.sum(F.greatest("valence", F.lit(0.0))).alias("up"), F.sum(F.greatest(-F.col("valence"), F.lit(0.0))).alias("down"))
    free = F.when(F.col("lock_level") == "none", 1.0).otherwise(0.0)
    rows = store.beliefs.join(sums, "id", "left")
    return rows.select("id", (F.col("alpha") + free * F.coalesce("up", F.lit(0.0))).alias("alpha"), (F.col("beta") + free * F.coalesce("down", F.lit(0.0))).alias("beta"))


def meta_decay(store: Store, now: int, half_life: float) -> DataFrame:
    """Evidence of each source of feedback, halved each half-life: as decay is linear, a sum replaces the fold."""
    weight = F.pow(F.lit(0.5), (now - F.col("created_at")) / half_life)
    e = (F.col("valence") + 1) / 2
    return store.feedback.where(F.col("created_at") <= now).groupBy("source").agg(F.round(0.5 + F.sum(e * weight), 6).alias("alpha"), F.round(0.5 + F.sum((1 - e) * weight), 6).alias("beta"))


# Fixed value: what a meta-belief's prior weighs.
PRIOR_MASS = 1.0


def meta_events(events: DataFrame) -> DataFrame:
    """Events (``at``, ``evidence`` and others) as segments of one event each."""
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("evidence")))
    return events.withColumns({"first_at": F.col("at"), "last_at": F.col("at"), "faded": F.lit(0.0), "up": e, "down": 1 - e}).drop("at", "evidence")


def joined_segments(segments: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The segments of each key (``keys``, ``half_life``, ``first_at``, ``last_at``, ``faded``, ``up``, ``down``), in the order in which they came, as one.

    An event halves the evidence beyond the prior for every half-life since the event before it, which may have a later time (then
    nothing fades), and adds its own. That is an affine map of the evidence, and the maps of a stretch of events are one map again:
    ``faded`` are the half-lives from its first event to its last. So a log may be cut anywhere; neighbours and sums are carried
    over ranges, and a key's events are never in one task. A half-life that isn't positive fades nothing.
    """
    ordered = Ranges(segments, keys, order).previous(_before="last_at")
    gap = F.greatest(F.lit(0.0), F.col("first_at") - F.coalesce("_before", F.col("first_at"))) / F.col("half_life")
    step = F.when(F.col("half_life") > 0, gap).otherwise(0.0) + F.col("faded")
    timed = Ranges(ordered.withColumn("_step", step).drop("_before"), keys, order).running_sums(_age=F.col("_step"), _n=F.lit(1))
    # The first segment's own length is in its age, but what the whole fades begins with its first event.
    whole = timed.groupBy(*keys).agg(F.max("_age").alias("_all"), F.max("half_life").alias("half_life"), F.min_by("first_at", "_n").alias("first_at"), F.max_by("last_at", "_n").alias("last_at"))
    aged = timed.drop("half_life", "first_at", "last_at").join(whole, keys).withColumn("_w", F.pow(F.lit(2.0), F.col("_age") - F.col("_all")))
    sums = aged.groupBy(*keys, "half_life", "first_at", "last_at", F.col("_all").alias("faded"))
    return sums.agg(F.sum(F.col("up") * F.col("_w")).alias("up"), F.sum(F.col("down") * F.col("_w")).alias("down"))


def meta_posteriors(segments: DataFrame, keys: list[str], default: Column) -> DataFrame:
    """(``keys``, ``alpha``, ``beta``, ``last_at``) of joined segments over the prior whose mean is ``default``."""
    mean = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), default))
    return segments.select(*keys, (PRIOR_MASS * mean + F.col("up")).alias("alpha"), (PRIOR_MASS * (1 - mean) + F.col("down")).alias("beta"), "last_at")


def latest_state(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key: an upsert table folded from its log."""
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.col(order))
    return events.groupBy(key).agg(last.alias("_s")).select(key, "_s.*")


def lock_expiry(store: Store, now: int) -> DataFrame:
    """All beliefs with locks that have run out at ``now`` taken off."""
    over = (F.col("lock_level") == "user") & (F.col("lock_expires_at") <= now)
    return store.beliefs.select("id", F.when(over, "none").otherwise(F.col("lock_level")).alias("lock_level"), F.coalesce(over, F.lit(False)).alias("expired"))
