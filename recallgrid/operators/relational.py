"""Listings, audits and counts over a belief store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import origin_rank, posterior_mean
from ..sources.model import Store

# ---- listings -----------------------------------------------------------------------------------------------------------


def review_candidates(store: Store, limit: int = 10) -> DataFrame:
    """Active unlocked beliefs, those never confirmed or never retrieved first, then the oldest."""
    order = [F.col(c).asc_nulls_first() for c in ("last_confirmed_at", "last_retrieved_at")]
    return store.active.where("lock_level = 'none'").orderBy(*order, "created_at", "id").limit(limit).select("id", "last_confirmed_at", "last_retrieved_at")


def speculative(store: Store, origin: str | None = None) -> DataFrame:
    """Unlocked active beliefs of one origin or all, by evidence."""
    rows = store.active.where("lock_level = 'none'")
    return (rows.where(F.col("origin") == origin) if origin else rows).select("id", "origin", "alpha")


def phantoms(store: Store) -> DataFrame:
    """Active beliefs whose type and origin are speculative."""
    return store.active.where("type = 'speculative' AND origin = 'speculative'").select("id", "created_at")


def low_evidence(store: Store, most: float = 2.0) -> DataFrame:
    """Beliefs of unknown origin with little evidence."""
    return store.active.where("origin = 'unknown'").where(F.col("alpha") + F.col("beta") <= most).select("id", "alpha", "beta")


def locked(store: Store) -> DataFrame:
    """Active locked beliefs with their place: latest lock first, then id."""
    rows = store.active.where("lock_level <> 'none'")
    return rows.select("id", "locked_at", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("locked_at"), "id")).alias("place"), "session_id")


def expiring_locks(store: Store, before: int) -> DataFrame:
    return store.active.where("lock_level = 'user'").where(F.col("lock_expires_at") <= before).select("id", "lock_expires_at")


def stale(store: Store, created_before: int, retrieved_before: int) -> DataFrame:
    """Active beliefs that are old and weren't retrieved lately, or never."""
    unseen = F.col("last_retrieved_at").isNull() | (F.col("last_retrieved_at") < retrieved_before)
    return store.active.where((F.col("created_at") < created_before) & unseen).select("id", "created_at", "last_retrieved_at")


def core(store: Store, corroborations: DataFrame, least_times: int = 2, least_mass: float = 4.0, least_mean: float = 0.66) -> DataFrame:
    """Locked beliefs and those that sightings or evidence bear out; ``tier`` 0 is locked."""
    seen = store.active.join(corroborations, store.active.content_hash == corroborations.hash, "left")
    mean, mass = posterior_mean(F.col("alpha"), F.col("beta")), F.col("alpha") + F.col("beta")
    is_locked = F.col("lock_level") != "none"
    borne = (F.coalesce("times", F.lit(0)) >= least_times) | ((mass >= least_mass) & (mean >= least_mean))
    return seen.where(is_locked | borne).select("id", F.when(is_locked, 0).otherwise(1).alias("tier"), F.round(mean, 6).alias("mean"))


def phantom_gc(store: Store, cutoff: int, alpha: float = 0.3, beta: float = 1.0, passive: str = "view") -> DataFrame:
    """Phantoms older than ``cutoff`` that still have the evidence they began with, without feedback but exposure, and that no
    RESOLVES edge touches at either end."""
    old = store.active.where("type = 'speculative' AND origin = 'speculative'").where(F.col("created_at") < cutoff)
    old = old.where((F.col("alpha") <= alpha + 1e-9) & (F.col("beta") <= beta + 1e-9))
    touched = store.feedback.where(F.col("source") != passive).select(F.col("belief_id").alias("id"))
    ends = store.edges.where("type = 'RESOLVES'")
    settled = ends.select(F.col("src").alias("id")).unionByName(ends.select(F.col("dst").alias("id")))
    return old.join(touched, "id", "left_anti").join(settled, "id", "left_anti").select("id")


def in_project(store: Store, context: str | None) -> DataFrame:
    """Beliefs of the active project: those of wider scope, of no project, or of this one; all without a project."""
    if context is None:
        return store.active.select("id", "scope", "project_context")
    wide = F.coalesce(F.col("scope"), F.lit("project")) != "project"
    return store.active.where(wide | (F.col("project_context") == "") | (F.col("project_context") == context)).select("id", "scope", "project_context")


# ---- joins --------------------------------------------------------------------------------------------------------------


def never_surfaced(store: Store) -> DataFrame:
    """Unlocked active beliefs without any feedback."""
    return store.active.where("lock_level = 'none'").join(store.feedback, F.col("belief_id") == F.col("id"), "left_anti").select("id")


def dangling_edges(store: Store) -> DataFrame:
    """By type, edges whose source or target doesn't exist."""
    ids = store.beliefs.select("id")
    checked = (
        store.edges.join(ids.select(F.col("id").alias("src_id")), F.col("src") == F.col("src_id"), "left")
        .join(ids.select(F.col("id").alias("dst_id")), F.col("dst") == F.col("dst_id"), "left")
        .where("src_id IS NULL OR dst_id IS NULL")
    )
    return checked.groupBy("type").agg(F.count_if(F.col("src_id").isNull()).alias("missing_src"), F.count_if(F.col("dst_id").isNull()).alias("missing_dst"), F.count("*").alias("n"))


def orphan_feedback(store: Store) -> DataFrame:
    """Feedback on beliefs that don't exist, by source."""
    rows = store.feedback.join(store.beliefs.select(F.col("id").alias("belief_id")), "belief_id", "left_anti")
    return rows.groupBy("source").agg(F.count("*").alias("n"))


def contradicting_pairs(store: Store, only_locked: bool = False) -> DataFrame:
    """Unordered pairs of active (or locked) beliefs joined by a CONTRADICTS edge, least id first."""
    ids = (store.active.where("lock_level <> 'none'") if only_locked else store.active).select("id")
    e = store.edges.where("type = 'CONTRADICTS'")
    both = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def unresolved_contradictions(store: Store) -> DataFrame:
    """Contradicting pairs of which neither supersedes the other."""
    done = store.edges.where("type = 'SUPERSEDES'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return contradicting_pairs(store).join(done, ["a", "b"], "left_anti")


#: Precedence of origins when two beliefs contradict each other.
_CLASS = {"user_stated": 6, "user_corrected": 5, "user_validated": 4, "user_transcript": 3, "agent_inferred": 1}


def precedence() -> Column:
    """The class of a belief in a contradiction: a lock counts as stated by the user; of other origins a correction is 5, the rest 2."""
    rank = F.when(F.col("type") == "correction", 5).otherwise(2)
    for origin, r in _CLASS.items():
        rank = F.when(F.col("origin") == origin, r).otherwise(rank)
    return F.when(F.col("lock_level") == "user", 6).otherwise(rank)


def contradiction_winners(store: Store) -> DataFrame:
    """Of each unresolved pair the belief that stays: by class, then the later one, then the lesser id."""

    def side(name: str) -> DataFrame:
        return store.active.select(F.col("id").alias(name), F.struct((-precedence()).alias("rank"), (-F.col("created_at")).alias("age"), "id").alias(f"_{name}"))

    rows = unresolved_contradictions(store).join(side("a"), "a").join(side("b"), "b")
    best, worst = F.least("_a", "_b"), F.greatest("_a", "_b")
    return rows.select(best["id"].alias("winner"), worst["id"].alias("loser"))


def promotable(store: Store, least: int = 3, sessions: int = 2) -> DataFrame:
    """Active beliefs with positive feedback often enough, from several sessions, that nothing contradicts."""
    seen = store.feedback.where("valence > 0").groupBy(F.col("belief_id").alias("id")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("n_sessions"))
    against = store.edges.where("type = 'CONTRADICTS'").select(F.col("dst").alias("id"))
    return store.active.join(seen.where((F.col("n") >= least) & (F.col("n_sessions") >= sessions)), "id").join(against, "id", "left_anti").select("id", "n", "n_sessions")


def superseded(store: Store) -> DataFrame:
    return store.active.join(store.edges.where("type = 'SUPERSEDES'").select(F.col("dst").alias("id")), "id", "left_semi").select("id")


def explicit_feedback_in_window(store: Store, seconds: int, passive: str = "view") -> DataFrame:
    """Exposures that explicit feedback on the same belief followed within ``seconds``, and the first such.

    A window over the times of each belief finds the first; no pairs of events are made.
    """
    ahead = Window.partitionBy("belief_id").orderBy("created_at").rangeBetween(0, seconds)
    first = F.min(F.when(F.col("source") != passive, F.col("created_at"))).over(ahead)
    rows = store.feedback.select("feedback_id", "source", first.alias("first_at"))
    return rows.where((F.col("source") == passive) & F.col("first_at").isNotNull()).select("feedback_id", "first_at")


def federated(rows: DataFrame, limit: int) -> DataFrame:
    """The best rows of all peers (``owner``, ``id``, ``scope``, ``score``) that are shared; ties by peer and id."""
    shared = rows.where("scope = 'global' OR scope LIKE 'shared:%'").select("id", "scope", "score", "owner")
    return shared.orderBy(F.desc("score"), "owner", "id").limit(limit)


def triangle_closure(store: Store, types: tuple[str, ...]) -> DataFrame:
    """Pairs of sources that share a target. A target of n sources makes n (n - 1) / 2 pairs, which are the result; adaptive execution
    splits the join of a target that many share."""
    e = store.edges.where(F.col("type").isin(*types)).select("src", "dst").distinct()
    other = e.select(F.col("src").alias("b"), "dst")
    pairs = e.select(F.col("src").alias("a"), "dst").join(other, "dst").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def compare_slots(left: DataFrame, right: DataFrame) -> DataFrame:
    """(``slot``, ``value``) rows of two stores held against each other; of the right store the first value of a slot counts
    (by ``seq``). ``verdict``: duplicate, contradiction, left only, right only."""
    first = right.withColumn("_n", F.row_number().over(Window.partitionBy("slot").orderBy("seq"))).where("_n = 1").select("slot", F.col("value").alias("right_value"))
    both = left.select("slot", F.col("value").alias("left_value")).join(first, "slot", "full_outer")
    verdict = F.when(F.col("right_value").isNull(), "left_only").when(F.col("left_value").isNull(), "right_only").when(F.col("left_value") == F.col("right_value"), "duplicate").otherwise("contradiction")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


# ---- counts -------------------------------------------------------------------------------------------------------------


def count_by(rows: DataFrame, column: Column, name: str) -> DataFrame:
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def phantom_lifecycle(store: Store) -> DataFrame:
    """How many speculative beliefs live, were retired, were promoted; and when the last was made."""
    s = F.col("type") == "speculative"
    return store.beliefs.agg(
        F.count_if(s & F.col("valid_to").isNull()).alias("live"),
        F.count_if(s & F.col("valid_to").isNotNull()).alias("retired"),
        F.count_if(~s & (F.col("origin") == "speculative")).alias("promoted"),
        F.max(F.when(s, F.col("created_at"))).alias("last_made"),
    )


def health(store: Store) -> DataFrame:
    """Numeric state of a store: mean and median confidence, mean evidence, locks per 1000, edges per belief."""
    mean = posterior_mean(F.col("alpha"), F.col("beta"))
    # Beliefs are counted by their mean first, so that the median is sought among distinct means.
    by_mean = store.active.groupBy(mean.alias("mean")).agg(F.count("*").alias("n"), F.sum(F.col("alpha") + F.col("beta")).alias("mass"), F.count_if(F.col("lock_level") != "none").alias("locks"))
    b = by_mean.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_beliefs"),
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("confidence_mean"),
        F.percentile("mean", F.lit(0.5), F.col("n")).alias("confidence_median"),
        (F.sum("mass") / F.sum("n")).alias("mass_mean"),
        (1000 * F.sum("locks") / F.sum("n")).alias("lock_per_1000"),
    )
    return b.crossJoin(F.broadcast(store.edges.agg(F.count("*").alias("n_edges")))).withColumn("edge_per_belief", F.col("n_edges") / F.col("n_beliefs"))


#: Feature, supersede range from, to, ignore value, whether higher speaks for supersede.
_ANCHORS = (
    ("confidence_mean", 0.501, 0.750, 0.377, True),
    ("confidence_median", 0.500, 0.750, 0.375, True),
    ("mass_mean", 2.007, 4.056, 1.616, True),
    ("lock_per_1000", 0.113, 0.355, 0.000, True),
    ("edge_per_belief", 0.464, 1.139, 2.410, False),
)


def confidence_buckets(store: Store) -> DataFrame:
    """Active beliefs by fifths of confidence."""
    mean = posterior_mean(F.col("alpha"), F.col("beta"))
    return store.active.groupBy(F.least(F.floor(mean * 5), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def duplicate_groups(store: Store) -> DataFrame:
    """Beliefs with one content: the oldest survives (ties: least id) with the evidence of all and the best origin."""
    grouped = store.beliefs.groupBy("content_hash").agg(
        F.count("*").alias("n"),
        F.min(F.struct("created_at", "id"))["id"].alias("survivor"),
        F.sum("alpha").alias("alpha"),
        F.sum("beta").alias("beta"),
        F.when(F.bool_or(F.col("lock_level") == "user"), "user").otherwise("none").alias("lock_level"),
        F.max(origin_rank(F.col("origin"))).alias("origin_rank"),
        F.max("last_retrieved_at").alias("last_retrieved_at"),
    )
    return grouped.where("n > 1")


def version_vector(store: Store) -> DataFrame:
    return count_by(store.beliefs, F.coalesce("scope", F.lit("project")), "scope")


def reference_signal(store: Store) -> DataFrame:
    """By session, how exposures ended: resolved, pending, positive, and beliefs that were referenced."""
    r = F.when(F.col("valence") > 0, 1).when(F.col("valence") < 0, 0)
    return store.feedback.groupBy("session_id").agg(
        F.count(r).alias("resolved"), F.count_if(r.isNull()).alias("pending"), F.coalesce(F.sum(r), F.lit(0)).alias("positive"), F.countDistinct(F.when(r == 1, F.col("belief_id"))).alias("referenced")
    )


def floor_rank_percentile(rows: DataFrame, by: str, value: str, percent: int) -> DataFrame:
    """The element at place max(1, floor(n * percent / 100)) of each group."""
    from .ordered import value_places

    places = value_places(rows, by, value)
    size = places.groupBy(by).agg(F.max(F.col("before") + F.col("c")).alias("n"))
    place = F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100))
    return places.join(size, by).where((F.col("before") < place) & (place <= F.col("before") + F.col("c"))).select(by, value)


def linear_percentile(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """The value at place (n - 1) * share of each group, from 0, between its neighbours in proportion; 6 decimal places."""
    from .ordered import value_places

    places = value_places(rows, by, value)
    size = places.groupBy(by).agg(F.max(F.col("before") + F.col("c")).alias("n"))
    at = (F.col("n") - 1) * share
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("c"))
    found = places.join(size, by).where(holds(F.floor(at)) | holds(F.ceil(at)))
    ends = found.groupBy(by, "n").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return ends.select(by, F.round(F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at)), 6).alias(value))


def utterance_logodds(rows: DataFrame, text: str, flag: str, least: int) -> DataFrame:
    """For each word, the smoothed log-odds that a text of one class has it rather than one of the other."""
    totals = rows.agg(F.count_if(F.col(flag)).alias("n1"), F.count_if(~F.col(flag)).alias("n0"))
    words = rows.select(flag, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))).alias("word"))
    df = words.groupBy("word").agg(F.count_if(F.col(flag)).alias("d1"), F.count_if(~F.col(flag)).alias("d0")).where(F.col("d1") + F.col("d0") >= least)
    odds = F.log((F.col("d1") + 0.5) / (F.col("n1") + 1)) - F.log((F.col("d0") + 0.5) / (F.col("n0") + 1))
    return df.crossJoin(F.broadcast(totals)).select("word", "d1", "d0", F.round(odds, 6).alias("log_odds"))


def best_origin_first(store: Store, limit: int) -> DataFrame:
    """Active beliefs by evidence, ties by the rank of their origin, then id."""
    rows = store.active.withColumn("rank", origin_rank(F.col("origin")))
    return rows.orderBy(F.desc("alpha"), F.desc("rank"), "id").limit(limit).select("id", "alpha", "rank")




def regime(store: Store, least_beliefs: int = 100) -> DataFrame:
    """What the health figures speak for: each is 1 inside its supersede range and falls linearly to 0 at the ignore value."""
    h = health(store)
    scores = []
    for name, low, high, ignore, upward in _ANCHORS:
        v = F.col(name)
        scores.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - ignore) / (low - ignore) if upward else (ignore - v) / (ignore - high))))
    mean = sum(scores[1:], scores[0]) / len(scores)
    kind = F.when(F.col("n_beliefs") < least_beliefs, "insufficient_data").when(mean >= 0.7, "supersede").when(mean <= 0.3, "ignore").otherwise("mixed")
    return h.select(kind.alias("regime"), F.round(mean, 6).alias("mean_score"))
