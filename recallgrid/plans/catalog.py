"""The engine's queries over the test tables, each with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import graph, metrics, ordered, recall, relational, retrieval, similarity
from ..operators.scan import Ranges
from ..sources.model import Store, oracle_tables, table
from ..streaming import feedback as streams
from .registry import ASKED_SQL, BASE, MEAN, ORACLE_SQL, QUERIES, asked, on_store, on_tables, one_byte

# ---- listings -----------------------------------------------------------------------------------------------------------


@on_store("beliefs", "SELECT id, last_confirmed_at, last_retrieved_at FROM beliefs WHERE valid_to IS NULL AND lock_level = 'none' ORDER BY last_confirmed_at NULLS FIRST, last_retrieved_at NULLS FIRST, created_at, id LIMIT 10")
def review_candidates(s):
    return relational.review_candidates(s)


@on_store("beliefs", "SELECT id, origin, alpha FROM beliefs WHERE valid_to IS NULL AND lock_level = 'none' AND origin = 'speculative'")
def speculative_beliefs(s):
    return relational.speculative(s, "speculative")


@on_store("beliefs", "SELECT id, created_at FROM beliefs WHERE valid_to IS NULL AND type = 'speculative' AND origin = 'speculative'")
def active_phantoms(s):
    return relational.phantoms(s)


@on_store("beliefs", "SELECT id, alpha, beta FROM beliefs WHERE valid_to IS NULL AND origin = 'unknown' AND alpha + beta <= 3.0")
def low_evidence(s):
    return relational.low_evidence(s, 3.0)


@on_store("beliefs", "SELECT id, locked_at, session_id, row_number() OVER (PARTITION BY session_id ORDER BY locked_at DESC, id) AS place FROM beliefs WHERE valid_to IS NULL AND lock_level <> 'none'")
def locked_beliefs(s):
    return relational.locked(s)


@on_store("beliefs", f"SELECT id, lock_expires_at FROM beliefs WHERE valid_to IS NULL AND lock_level = 'user' AND lock_expires_at <= {BASE + 1_000_000}")
def expiring_locks(s):
    return relational.expiring_locks(s, BASE + 1_000_000)


@on_store("beliefs", f"SELECT id, created_at, last_retrieved_at FROM beliefs WHERE valid_to IS NULL AND created_at < {BASE + 30000} AND (last_retrieved_at IS NULL OR last_retrieved_at < {BASE + 60000})")
def stale_beliefs(s):
    return relational.stale(s, BASE + 30000, BASE + 60000)


@on_store(
    "beliefs",
    f"""SELECT b.id, CASE WHEN lock_level <> 'none' THEN 0 ELSE 1 END AS tier, round({MEAN}, 6) AS mean FROM beliefs b
    JOIN (SELECT content_hash, count(*) AS times FROM beliefs GROUP BY content_hash) c ON c.content_hash = b.content_hash
    WHERE valid_to IS NULL AND (lock_level <> 'none' OR times >= 2 OR alpha + beta >= 4.0 AND {MEAN} >= 0.66)""",
)
def core_beliefs(s):
    return relational.core(s, s.beliefs.groupBy(F.col("content_hash").alias("hash")).agg(F.count("*").alias("times")))


@on_store(
    "beliefs edges feedback",
    f"""SELECT id FROM beliefs WHERE valid_to IS NULL AND type = 'speculative' AND origin = 'speculative' AND created_at < {BASE + 40000}
    AND alpha <= 0.3 + 1e-9 AND beta <= 1.0 + 1e-9 AND id NOT IN (SELECT belief_id FROM feedback WHERE source <> 'view')
    AND id NOT IN (SELECT src FROM edges WHERE type = 'RESOLVES' UNION SELECT dst FROM edges WHERE type = 'RESOLVES')""",
)
def phantom_gc(s):
    return relational.phantom_gc(s, BASE + 40000)


@on_store("beliefs", "SELECT id, scope, project_context FROM beliefs WHERE valid_to IS NULL AND (coalesce(scope, 'project') <> 'project' OR project_context IN ('', 'p1'))")
def project_context_filter(s):
    return relational.in_project(s, "p1")


@on_store("beliefs", "SELECT id, alpha, CASE origin WHEN 'user_stated' THEN 6 WHEN 'user_corrected' THEN 5 WHEN 'user_validated' THEN 4 WHEN 'user_transcript' THEN 3 WHEN 'agent_inferred' THEN 1 ELSE 2 END AS rank FROM beliefs WHERE valid_to IS NULL ORDER BY alpha DESC, rank DESC, id LIMIT 25")
def origin_tie_break(s):
    return relational.best_origin_first(s, 25)


# ---- joins --------------------------------------------------------------------------------------------------------------


@on_store("beliefs feedback", "SELECT id FROM beliefs WHERE valid_to IS NULL AND lock_level = 'none' AND NOT EXISTS (SELECT 1 FROM feedback WHERE belief_id = id)")
def never_surfaced(s):
    return relational.never_surfaced(s)


@on_store(
    "beliefs edges",
    """SELECT e.type, count(*) FILTER (WHERE a.id IS NULL) AS missing_src, count(*) FILTER (WHERE b.id IS NULL) AS missing_dst, count(*) AS n
    FROM edges e LEFT JOIN beliefs a ON a.id = e.src LEFT JOIN beliefs b ON b.id = e.dst WHERE a.id IS NULL OR b.id IS NULL GROUP BY e.type""",
)
def dangling_edges(s):
    return relational.dangling_edges(s)


@on_store("beliefs feedback", "SELECT source, count(*) AS n FROM feedback WHERE belief_id NOT IN (SELECT id FROM beliefs) GROUP BY source")
def orphan_feedback(s):
    return relational.orphan_feedback(s)


CONTRA = """SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges e
    JOIN beliefs x ON x.id = src AND x.valid_to IS NULL JOIN beliefs y ON y.id = dst AND y.valid_to IS NULL WHERE e.type = 'CONTRADICTS'"""
OPEN = f"SELECT a, b FROM ({CONTRA}) p WHERE NOT EXISTS (SELECT 1 FROM edges WHERE type = 'SUPERSEDES' AND least(src, dst) = a AND greatest(src, dst) = b)"


@on_store("beliefs edges", CONTRA)
def active_contradictions(s):
    return relational.contradicting_pairs(s)


@on_store("beliefs edges", CONTRA + " AND x.lock_level <> 'none' AND y.lock_level <> 'none'")
def locked_contradictions(s):
    return relational.contradicting_pairs(s, True)


@on_store("beliefs edges", OPEN)
def unresolved_contradictions(s):
    return relational.unresolved_contradictions(s)


RANK = "-(CASE WHEN {0}.lock_level = 'user' OR {0}.origin = 'user_stated' THEN 6 WHEN {0}.origin = 'user_corrected' THEN 5 WHEN {0}.origin = 'user_validated' THEN 4 WHEN {0}.origin = 'user_transcript' THEN 3 WHEN {0}.origin = 'agent_inferred' THEN 1 WHEN {0}.type = 'correction' THEN 5 ELSE 2 END)"


@on_store(
    "beliefs edges",
    f"""SELECT CASE WHEN first THEN a ELSE b END AS winner, CASE WHEN first THEN b ELSE a END AS loser FROM (
    SELECT o.a, o.b, ({RANK.format('x')}, -x.created_at, x.id) <= ({RANK.format('y')}, -y.created_at, y.id) AS first
    FROM ({OPEN}) o JOIN beliefs x ON x.id = o.a JOIN beliefs y ON y.id = o.b) w""",
)
def contradiction_winners(s):
    return relational.contradiction_winners(s)


@on_store(
    "beliefs edges feedback",
    """SELECT id, n, n_sessions FROM beliefs JOIN (SELECT belief_id, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM feedback WHERE valence > 0 GROUP BY 1) f ON belief_id = id
    WHERE valid_to IS NULL AND n >= 3 AND n_sessions >= 2 AND id NOT IN (SELECT dst FROM edges WHERE type = 'CONTRADICTS')""",
)
def promotable_beliefs(s):
    return relational.promotable(s)


@on_store("beliefs edges", "SELECT id FROM beliefs WHERE valid_to IS NULL AND id IN (SELECT dst FROM edges WHERE type = 'SUPERSEDES')")
def superseded_beliefs(s):
    return relational.superseded(s)


@on_store(
    "feedback",
    """SELECT v.feedback_id, min(a.created_at) AS first_at FROM feedback v JOIN feedback a ON a.belief_id = v.belief_id AND a.source <> 'view'
    AND a.created_at BETWEEN v.created_at AND v.created_at + 400000 WHERE v.source = 'view' GROUP BY 1""",
)
def explicit_feedback_window(s):
    return relational.explicit_feedback_in_window(s, 400_000)


@on_tables(
    """SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'global' ELSE 'shared:' || n_name END AS scope, round(s_acctbal, 2) AS score, r_name AS owner
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_suppkey % 4 > 0 ORDER BY score DESC, owner, id LIMIT 20"""
)
def federated_search(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    scope = F.when(F.col("s_suppkey") % 4 == 0, "project").when(F.col("s_suppkey") % 3 == 0, "global").otherwise(F.concat(F.lit("shared:"), "n_name"))
    return relational.federated(rows.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), scope.alias("scope"), F.round("s_acctbal", 2).alias("score"), F.col("r_name").alias("owner")), 20)


@on_store(
    "edges",
    """SELECT a.src AS a, b.src AS b, count(*) AS shared FROM (SELECT DISTINCT src, dst FROM edges WHERE type IN ('SUPPORTS', 'CITES')) a
    JOIN (SELECT DISTINCT src, dst FROM edges WHERE type IN ('SUPPORTS', 'CITES')) b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2""",
)
def triangle_closure(s):
    return relational.triangle_closure(s, ("SUPPORTS", "CITES"))


@on_store(
    "beliefs",
    """, l AS (SELECT 'k' || (seq % 400) AS slot, type AS value FROM beliefs),
    r AS (SELECT slot, value AS right_value FROM (SELECT 'k' || (seq % 500) AS slot, type AS value, row_number() OVER (PARTITION BY seq % 500 ORDER BY seq) AS n FROM beliefs) q WHERE n = 1)
    SELECT CASE WHEN right_value IS NULL THEN 'left_only' WHEN value IS NULL THEN 'right_only' WHEN value = right_value THEN 'duplicate' ELSE 'contradiction' END AS verdict, count(*) AS n
    FROM l FULL JOIN r ON l.slot = r.slot GROUP BY 1""",
)
def compare_slots(s):
    """Every belief on both sides, under keys of two different widths."""

    def slots(mod: int) -> DataFrame:
        return s.beliefs.select(F.concat(F.lit("k"), F.col("seq") % mod).alias("slot"), F.col("type").alias("value"), "seq")

    return relational.compare_slots(slots(400), slots(500))


# ---- counts -------------------------------------------------------------------------------------------------------------


@on_store("beliefs", "SELECT type, count(*) AS n FROM beliefs GROUP BY type")
def count_by_type(s):
    return relational.count_by(s.beliefs, F.col("type"), "type")


@on_store("beliefs", "SELECT coalesce(scope, 'project') AS scope, count(*) AS n FROM beliefs GROUP BY 1")
def version_vector(s):
    return relational.version_vector(s)


@on_store("edges", "SELECT type, count(*) AS n FROM edges GROUP BY type")
def count_edges_by_type(s):
    return relational.count_by(s.edges, F.col("type"), "type")


@on_store(
    "beliefs",
    """SELECT count(*) FILTER (WHERE type = 'speculative' AND valid_to IS NULL) AS live, count(*) FILTER (WHERE type = 'speculative' AND valid_to IS NOT NULL) AS retired,
    count(*) FILTER (WHERE type <> 'speculative' AND origin = 'speculative') AS promoted, max(created_at) FILTER (WHERE type = 'speculative') AS last_made FROM beliefs""",
)
def phantom_lifecycle(s):
    return relational.phantom_lifecycle(s)


HEALTH = f"""SELECT count(*) AS n_beliefs, avg({MEAN}) AS confidence_mean, quantile_cont({MEAN}, 0.5) AS confidence_median, avg(alpha + beta) AS mass_mean,
    1000.0 * count(*) FILTER (WHERE lock_level <> 'none') / count(*) AS lock_per_1000, (SELECT count(*) FROM edges) * 1.0 / count(*) AS edge_per_belief FROM beliefs WHERE valid_to IS NULL"""


@on_store("beliefs edges", f"SELECT n_beliefs, round(confidence_mean, 6) AS confidence_mean, round(confidence_median, 6) AS confidence_median, round(mass_mean, 6) AS mass_mean, round(lock_per_1000, 6) AS lock_per_1000, round(edge_per_belief, 6) AS edge_per_belief FROM ({HEALTH}) h")
def health_features(s):
    names = ("confidence_mean", "confidence_median", "mass_mean", "lock_per_1000", "edge_per_belief")
    return relational.health(s).select("n_beliefs", *(F.round(n, 6).alias(n) for n in names))


def _part(name: str, low: float, high: float, ignore: float, upward: bool) -> str:
    x = f"({name} - {ignore}) / ({low} - {ignore})" if upward else f"({ignore} - {name}) / ({ignore} - {high})"
    return f"greatest(0.0, least(1.0, {x}))"


REGIME_PARTS = " + ".join(_part(*a) for a in relational._ANCHORS)


@on_store("beliefs edges", f"SELECT CASE WHEN n_beliefs < 100 THEN 'insufficient_data' WHEN m >= 0.7 THEN 'supersede' WHEN m <= 0.3 THEN 'ignore' ELSE 'mixed' END AS regime, round(m, 6) AS mean_score FROM (SELECT n_beliefs, ({REGIME_PARTS}) / 5 AS m FROM ({HEALTH}) h) q")
def health_regime(s):
    return relational.regime(s)


@on_store("beliefs", f"SELECT CAST(least(floor(({MEAN}) * 5), 4) AS INTEGER) AS bucket, count(*) AS n FROM beliefs WHERE valid_to IS NULL GROUP BY 1")
def confidence_buckets(s):
    return relational.confidence_buckets(s)


@on_store(
    "beliefs",
    """SELECT content_hash, count(*) AS n, (min((created_at, id)))[2] AS survivor, sum(alpha) AS alpha, sum(beta) AS beta, CASE WHEN bool_or(lock_level = 'user') THEN 'user' ELSE 'none' END AS lock_level,
    max(CASE origin WHEN 'user_stated' THEN 6 WHEN 'user_corrected' THEN 5 WHEN 'user_validated' THEN 4 WHEN 'user_transcript' THEN 3 WHEN 'agent_inferred' THEN 1 ELSE 2 END) AS origin_rank,
    max(last_retrieved_at) AS last_retrieved_at FROM beliefs GROUP BY content_hash HAVING count(*) > 1""".replace("(min((created_at, id)))[2]", "arg_min(id, (created_at, id))"),
)
def duplicate_groups(s):
    return relational.duplicate_groups(s)


@on_store(
    "feedback",
    """SELECT session_id, count(r) AS resolved, count(*) - count(r) AS pending, CAST(coalesce(sum(r), 0) AS BIGINT) AS positive, count(DISTINCT CASE WHEN r = 1 THEN belief_id END) AS referenced
    FROM (SELECT *, CASE WHEN valence > 0 THEN 1 WHEN valence < 0 THEN 0 END AS r FROM feedback) f GROUP BY session_id""",
)
def reference_signal(s):
    return relational.reference_signal(s)


@on_store("beliefs", "SELECT type, alpha FROM (SELECT type, alpha, row_number() OVER (PARTITION BY type ORDER BY alpha) AS r, count(*) OVER (PARTITION BY type) AS n FROM beliefs) q WHERE r = greatest(1, floor(n * 90 / 100))")
def floor_rank_percentile(s):
    return relational.floor_rank_percentile(s.beliefs, "type", "alpha", 90)


@on_store("beliefs", "SELECT type, round(quantile_cont(alpha, 0.9), 6) AS alpha FROM beliefs GROUP BY type")
def linear_percentile(s):
    return relational.linear_percentile(s.beliefs, "type", "alpha", 0.9)


@on_store(
    "turns",
    """, w AS (SELECT DISTINCT conv_id, turn, role = 'user' AS u, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM turns),
    n AS (SELECT count(*) FILTER (WHERE role = 'user') AS n1, count(*) FILTER (WHERE role <> 'user') AS n0 FROM turns)
    SELECT word, count(*) FILTER (WHERE u) AS d1, count(*) FILTER (WHERE NOT u) AS d0,
    round(ln((count(*) FILTER (WHERE u) + 0.5) / (max(n1) + 1)) - ln((count(*) FILTER (WHERE NOT u) + 0.5) / (max(n0) + 1)), 6) AS log_odds
    FROM w, n WHERE word <> '' GROUP BY word HAVING count(*) >= 5""",
)
def utterance_logodds(s):
    return relational.utterance_logodds(s.turns.withColumn("u", F.col("role") == "user"), "text", "u", 5)


# ---- order ---------------------------------------------------------------------------------------------------------------

KINDS = {"click": 1, "view": 2, "purchase": 4, "error": 8, "signup": 16}
KIND_SQL = "CASE source WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 8 WHEN 'signup' THEN 16 ELSE 0 END"
SPINE = "SELECT src, dst FROM (SELECT id AS src, lag(id) OVER (PARTITION BY session_id ORDER BY created_at, seq) AS dst FROM beliefs WHERE session_id IS NOT NULL) s WHERE dst IS NOT NULL"
TOUCH = f"SELECT session_id, belief_id, max(f) AS last_fire, count(*) AS times, bit_or(k) AS kinds FROM (SELECT session_id, belief_id, row_number() OVER (PARTITION BY session_id ORDER BY feedback_id) AS f, {KIND_SQL} AS k FROM feedback) q GROUP BY 1, 2"


@on_store("beliefs", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, seq) AS place FROM beliefs WHERE session_id IS NOT NULL")
def session_order(s):
    return ordered.session_order(s)


@on_store("beliefs", f"SELECT *, 'TEMPORAL_NEXT' AS type, CAST(0.8 AS DOUBLE) AS weight FROM ({SPINE}) q")
def temporal_spine(s):
    return ordered.spine(s)


@on_store(
    "beliefs",
    f""", r AS ({SPINE}), p AS (SELECT src, CASE WHEN CAST(substr(src, 2) AS BIGINT) % 10 = 0 THEN 'd1' ELSE dst END AS dst FROM r WHERE CAST(substr(src, 2) AS BIGINT) % 7 > 0)
    SELECT CASE WHEN p.src IS NULL THEN 'recomputed_only' WHEN r.src IS NULL THEN 'shipped_only' ELSE 'both' END AS side, count(*) AS n FROM p FULL JOIN r ON p.src = r.src AND p.dst = r.dst GROUP BY 1""",
)
def spine_divergence(s):
    k = F.substring("src", 2, 20).cast("long")
    shipped = ordered.spine(s).where(k % 7 > 0).withColumn("dst", F.when(k % 10 == 0, "d1").otherwise(F.col("dst")))
    return ordered.spine_divergence(s, shipped)


@on_store("beliefs", "SELECT type, id, alpha, rank() OVER (PARTITION BY type ORDER BY alpha) + (count(*) OVER (PARTITION BY type, alpha) - 1) / 2.0 AS average_rank FROM beliefs")
def average_ranks(s):
    return ordered.average_ranks(s.beliefs, "type", "alpha", "id")


@on_store(
    "beliefs",
    "SELECT session_id, id, tokens, spent FROM (SELECT session_id, id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, CAST(sum(ceil(length(content) / 4.0)) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM beliefs) q WHERE spent <= 5000",
)
def budget_prefix_pack(s):
    return ordered.budget_prefix(s.beliefs, "session_id", [F.col("created_at"), F.col("id")], "content", 5000).select("session_id", "id", "tokens", "spent")


@on_store("feedback", "SELECT session_id, feedback_id, belief_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY feedback_id DESC) AS n FROM feedback) q WHERE n <= 20")
def session_ring(s):
    return ordered.ring(s.feedback, "session_id", [F.desc("feedback_id")], 20).select("session_id", "feedback_id", "belief_id")


@on_store(
    "feedback",
    """SELECT session_id, feedback_id, negatives, n FROM (SELECT session_id, feedback_id, count(*) FILTER (WHERE valence < 0) OVER w AS negatives, count(*) OVER w AS n FROM feedback
    WINDOW w AS (PARTITION BY session_id ORDER BY feedback_id ROWS 4 PRECEDING)) q WHERE n >= 5 AND negatives * 1.0 / n >= 0.4""",
)
def correction_frequency(s):
    return ordered.correction_frequency(s)


@on_store(
    "beliefs",
    """SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN lock_level <> 'none' THEN 1e300 ELSE 1.0 / (r + 1) * pow(2.0, -age / 100000.0) END DESC, r) AS place FROM
    (SELECT session_id, id, lock_level, seq % 40 AS age0, row_number() OVER (PARTITION BY session_id ORDER BY alpha DESC, id) - 1 AS r, CAST(2000000 - seq * 60 AS DOUBLE) AS age FROM beliefs) q""",
)
def temporal_decay_rerank(s):
    rows = s.beliefs.select("session_id", "id", (F.col("lock_level") != "none").alias("is_locked"), (2_000_000.0 - F.col("seq") * 60).alias("age"), "alpha")
    rows = Ranges(rows, ["session_id"], [F.desc("alpha"), F.col("id")]).places().withColumn("r", F.col("place") - 1).drop("place", "alpha")
    return ordered.temporal_decay_rerank(rows, "session_id", "r", "age", 100_000.0, "is_locked").select("session_id", "id", "place")


@on_store(
    "turns",
    "SELECT conv_id, turn, role FROM (SELECT *, lag(text) OVER w = text AND lag(role) OVER w = role AS same FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) q WHERE same IS NULL OR NOT same",
)
def consecutive_duplicates(s):
    return ordered.consecutive_duplicates(s.turns)


@on_store("feedback", "SELECT * FROM (SELECT session_id, feedback_id, row_number() OVER (PARTITION BY session_id ORDER BY feedback_id) AS fire_idx FROM feedback) q WHERE fire_idx % 20 = 0")
def exploration_cadence(s):
    return ordered.cadence(s, 20)


@on_store("feedback", TOUCH)
def touch_state(s):
    return ordered.touches(s, KINDS)


@on_store("feedback", f", t AS ({TOUCH}) SELECT session_id, belief_id, last_fire FROM t WHERE last_fire >= (SELECT max(last_fire) FROM t u WHERE u.session_id = t.session_id) - 50")
def hot_beliefs(s):
    return ordered.hot(s, KINDS, 50)


@on_store(
    "feedback",
    f"""SELECT feedback_id, belief_id, EXISTS (SELECT 1 FROM feedback a WHERE a.belief_id = v.belief_id AND a.source <> 'view' AND a.created_at BETWEEN v.created_at AND v.created_at + 300000) AS cancelled
    FROM feedback v WHERE source = 'view' AND created_at <= {BASE + 500_000} - 300000""",
)
def deferred_feedback(s):
    return ordered.deferred(s, BASE + 500_000, 300_000)


@on_store("feedback", f"SELECT source, count(*) AS n, round(avg(valence), 6) AS mean_valence, count(DISTINCT belief_id) AS beliefs FROM feedback WHERE created_at >= {BASE + 86400} AND created_at < {BASE + 7 * 86400} GROUP BY source")
def window_rollup(s):
    return ordered.window_rollup(s, BASE + 86400, BASE + 7 * 86400)


@on_store(
    "beliefs feedback",
    """SELECT id, alpha + CASE WHEN lock_level = 'none' THEN coalesce(up, 0.0) ELSE 0.0 END AS alpha, beta + CASE WHEN lock_level = 'none' THEN coalesce(down, 0.0) ELSE 0.0 END AS beta FROM beliefs
    LEFT JOIN (SELECT belief_id, sum(greatest(valence, 0.0)) AS up, sum(greatest(-valence, 0.0)) AS down FROM feedback GROUP BY 1) f ON belief_id = id""",
)
def posterior_fold(s):
    return ordered.posterior_fold(s)


@on_store("feedback", f"SELECT source, round(0.5 + sum((valence + 1) / 2 * pow(0.5, ({BASE + 900_000} - created_at) / 100000.0)), 6) AS alpha, round(0.5 + sum((1 - (valence + 1) / 2) * pow(0.5, ({BASE + 900_000} - created_at) / 100000.0)), 6) AS beta FROM feedback WHERE created_at <= {BASE + 900_000} GROUP BY source")
def meta_decay(s):
    return ordered.meta_decay(s, BASE + 900_000, 100_000.0)


@on_store("feedback", "SELECT belief_id, feedback_id, source, valence FROM (SELECT *, row_number() OVER (PARTITION BY belief_id ORDER BY feedback_id DESC) AS n FROM feedback) q WHERE n = 1")
def latest_state(s):
    return ordered.latest_state(s.feedback.select("belief_id", "feedback_id", "source", "valence"), "belief_id", "feedback_id")


@on_store("beliefs", f"SELECT id, CASE WHEN e THEN 'none' ELSE lock_level END AS lock_level, e AS expired FROM (SELECT *, coalesce(lock_level = 'user' AND lock_expires_at <= {BASE + 2_000_000}, false) AS e FROM beliefs) q")
def lock_expiry_sweep(s):
    return ordered.lock_expiry(s, BASE + 2_000_000)


# ---- scores ---------------------------------------------------------------------------------------------------------------


@on_store(
    "beliefs",
    f"""SELECT id, round(m, 6) AS mean, round(CASE WHEN lock_level = 'user' THEN alpha ELSE 0.5 + (alpha - 0.5) * pow(0.5, (seq * 60.0) / (3600.0 * CASE type WHEN 'requirement' THEN 720 WHEN 'preference' THEN 2016 WHEN 'correction' THEN 4032 ELSE 336 END)) END, 6) AS decayed,
    round(ln(length(content) + 1.0) + 0.5 * ln(m), 6) AS log_additive, round(ln(length(content) + 1.0) + 2 * ln(m), 6) AS gamma,
    round(ln(length(content) + 1.0) + (1 / (1 + exp(-0.25 * (ln(m) - ln(0.5)))) - 0.5) * 14.5, 6) AS zeta, round(least(1.0, 12 * alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))), 6) AS uncertainty,
    CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM (SELECT *, {MEAN} AS m FROM beliefs) q""",
)
def belief_scores(s):
    a, b, match = F.col("alpha"), F.col("beta"), F.length("content") + 1.0
    old = scoring.decayed(a, scoring.PRIOR_ALPHA, F.col("seq") * 60.0, scoring.half_life_seconds(F.col("type")), F.col("lock_level"))
    made = {"mean": scoring.posterior_mean(a, b), "decayed": old, "log_additive": scoring.log_additive(match, a, b), "gamma": scoring.gamma_score(match, a, b, 0.5), "zeta": scoring.zeta_score(match, a, b), "uncertainty": scoring.normalised_uncertainty(a, b)}
    return s.beliefs.select("id", *(F.round(c, 6).alias(n) for n, c in made.items()), scoring.estimated_tokens(F.col("content")).alias("tokens"))


PSI = "(ln({0} + 8) - 1 / (2 * ({0} + 8)) - 1 / (12 * pow({0} + 8, 2)) + 1 / (120 * pow({0} + 8, 4)) - 1 / (252 * pow({0} + 8, 6))" + "".join(f" - 1 / ({{0}} + {k})" for k in range(8)) + ")"


@on_store(
    "beliefs",
    f"SELECT id, round(lgamma(alpha) + lgamma(beta) - lgamma(alpha + beta) - (alpha - 1) * {PSI.format('alpha')} - (beta - 1) * {PSI.format('beta')} + (alpha + beta - 2) * {PSI.format('(alpha + beta)')}, 6) AS entropy FROM beliefs",
)
def belief_entropy(s):
    return s.beliefs.select("id", F.round(scoring.beta_entropy(F.col("alpha"), F.col("beta")), 6).alias("entropy"))


# ---- search ---------------------------------------------------------------------------------------------------------------

INDEX = f""", w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS term FROM beliefs WHERE valid_to IS NULL),
    tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY 1, 2), dl AS (SELECT id, count(*) AS dl FROM w GROUP BY 1),
    n AS (SELECT count(*) AS n, (SELECT count(*) FROM w) * 1.0 / count(*) AS avgdl FROM beliefs WHERE valid_to IS NULL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM {ASKED_SQL}) z GROUP BY 1, 2),
    m AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), n GROUP BY 1, 2)"""


def index_of(s):
    """The index of the active beliefs, made once for each state of the files."""
    return retrieval.cached("content", retrieval.generation(s.beliefs), lambda: retrieval.Index(s.active))


@on_store("beliefs", INDEX + " SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM m) r WHERE place <= 10")
def bm25_topk(s):
    return retrieval.top(index_of(s).match(asked(s)), 10)


@on_store("beliefs", INDEX + " SELECT * FROM (SELECT query_id, term, df, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS place FROM q JOIN df USING (term)) r WHERE place <= 3")
def rarest_terms(s):
    return retrieval.rarest_terms(index_of(s), asked(s))


@on_store(
    "beliefs",
    INDEX
    + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM m) r WHERE k <= 50),
    e AS (SELECT query_id, id, content, 0 AS tier, CAST(locked_at AS DOUBLE) AS key FROM beliefs, {ASKED_SQL} WHERE valid_to IS NULL AND lock_level <> 'none'
          UNION ALL SELECT query_id, b.id, content, 1, round(ln(score) + 0.5 * ln({MEAN}), 6) FROM best JOIN beliefs b ON b.id = best.id WHERE lock_level = 'none'),
    p AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, sum(ceil(length(content) / 4.0)) OVER (PARTITION BY query_id ORDER BY tier, key DESC, id ROWS UNBOUNDED PRECEDING) AS spent FROM e)
    SELECT query_id, id, tier, tokens, row_number() OVER (PARTITION BY query_id ORDER BY tier, key DESC, id) AS place FROM p WHERE spent <= 60000""",
)
def retrieve_batch(s):
    return retrieval.retrieve(s, index_of(s), asked(s), 60_000)


@on_store("beliefs edges", """, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS term, 1 AS c, 0 AS a FROM beliefs WHERE valid_to IS NULL
    UNION ALL SELECT dst, unnest(list_filter(regexp_split_to_array(lower(anchor_text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')), 0, 1 FROM edges WHERE anchor_text <> '' AND dst IN (SELECT id FROM beliefs WHERE valid_to IS NULL)),
    l AS (SELECT b.id, coalesce(sum(c), 0) AS dl, coalesce(sum(a), 0) AS da FROM beliefs b LEFT JOIN w ON w.id = b.id WHERE valid_to IS NULL GROUP BY 1)
    SELECT id, term, CAST(sum(c) AS BIGINT) AS tf, CAST(sum(a) AS BIGINT) AS ta, CAST(any_value(dl) AS BIGINT) AS dl, CAST(any_value(da) AS BIGINT) AS da FROM w JOIN l USING (id) GROUP BY 1, 2""")
def index_build(s):
    """The postings of the content and incoming anchors of all active beliefs, as they are written."""
    return retrieval.Index(s.active, anchors=s.edges).written().postings.select("id", "term", "tf", "ta", "dl", "da")


ORACLE_SQL["index_update"] = ORACLE_SQL["index_build"]


@on_store("", None)
def index_update(s):
    """The postings after an update from an index of older beliefs and texts, which are those of one made anew."""
    old = s.active.where("seq % 7 > 0").withColumn("content", F.when(F.col("seq") % 11 == 0, "an older text").otherwise(F.col("content")))
    base = anchored(s, old)
    return base.updated(s.active, anchors=s.edges).postings.select("id", "term", "tf", "ta", "dl", "da")


@on_store(
    "beliefs",
    """, w AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(CASE WHEN seq % 101 = 0 THEN 'a newer text of ' || id ELSE content END), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS term FROM beliefs WHERE valid_to IS NULL)
    SELECT term, count(*) AS df FROM w GROUP BY 1""",
)
def index_refresh(s):
    """The frequencies after one text in a hundred changed, by an update of the index."""
    docs = s.active.withColumn("content", F.when(F.col("seq") % 101 == 0, F.concat(F.lit("a newer text of "), "id")).otherwise(F.col("content")))
    return index_of(s).updated(docs).frequencies.select("term", "df")


def anchored(s, docs=None):
    """An index of beliefs and their incoming anchors, made once for each state of the files."""
    if docs is not None:
        return retrieval.cached("older", retrieval.generation(s.beliefs), lambda: retrieval.Index(docs, anchors=s.edges))
    return retrieval.cached("anchored", retrieval.generation(s.beliefs), lambda: retrieval.Index(s.active, anchors=s.edges))


FIELDS = """, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS term, 1 AS c, 0 AS a FROM beliefs WHERE valid_to IS NULL
    UNION ALL SELECT dst, unnest(list_filter(regexp_split_to_array(lower(anchor_text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')), 0, 1 FROM edges WHERE anchor_text <> '' AND dst IN (SELECT id FROM beliefs WHERE valid_to IS NULL)),
    tf AS (SELECT id, term, sum(c) AS tf, sum(a) AS ta FROM w GROUP BY 1, 2), l AS (SELECT b.id, coalesce(sum(c), 0) AS dl, coalesce(sum(a), 0) AS da FROM beliefs b LEFT JOIN w ON w.id = b.id WHERE valid_to IS NULL GROUP BY 1),
    n AS (SELECT count(*) AS n, avg(dl) AS avgdl, avg(da) AS avgda, avg(dl + 3 * da) AS avgall FROM l), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}_]+')) AS term FROM """ + ASKED_SQL + """) z GROUP BY 1, 2),
    x AS (SELECT query_id, id, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf, ta, 0.25 + 0.75 * dl / avgdl AS nc, 0.25 + 0.75 * da / avgda AS na, 0.25 + 0.75 * (dl + 3 * da) / avgall AS nall FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (id), n),
    m AS (SELECT query_id, id, round(sum(idf * {0}), 6) AS score FROM x GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM m) r WHERE place <= 10"""
TOGETHER = "((tf + 3 * ta) * 2.5 / (tf + 3 * ta + 1.5 * nall))"
APART = "((tf / nc + CASE WHEN ta > 0 THEN 3 * ta / na ELSE 0 END) * 2.5 / (1.5 + tf / nc + CASE WHEN ta > 0 THEN 3 * ta / na ELSE 0 END))"


@on_store("beliefs edges", FIELDS.replace("{0}", TOGETHER))
def bm25_anchored(s):
    """Incoming anchors are part of a belief's text, three times each."""
    return retrieval.top(anchored(s).match(asked(s)), 10)


@on_store("beliefs edges", FIELDS.replace("{0}", APART))
def bm25_per_field(s):
    """Content and anchors are divided by the norms of their own lengths."""
    return retrieval.top(anchored(s).match(asked(s), per_field=True), 10)


@on_store("", None)
def bm25_stemmed(s):
    """Stems without diacritics in place of words; tests hold it against a plain version."""
    index = retrieval.cached("stemmed", retrieval.generation(s.beliefs), lambda: retrieval.Index(s.active, anchors=s.edges, stem=True))
    return retrieval.top(index.match(asked(s)), 10)


MANY_SQL = """, a AS (SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS query_id, text AS query FROM turns WHERE (conv_id * 100 + turn) % 20 = 0),
    qa AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS term FROM a),
    qr AS (SELECT * FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS place FROM qa JOIN df USING (term)) r WHERE place <= 3),
    mm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qr JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id), n GROUP BY 1, 2)"""


def turn_queries(s):
    """Every turn whose id is divisible by 20, as a query."""
    key = F.col("conv_id") * 100 + F.col("turn")
    return s.turns.where(key % 20 == 0).select(key.cast("string").alias("query_id"), F.col("text").alias("query"))


@on_store("beliefs turns", INDEX + MANY_SQL + " SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM mm) r WHERE place <= 20")
def search_turns(s):
    """A batch of as many queries as every twentieth turn, each by its three rarest terms."""
    index = index_of(s)
    return retrieval.top_of(index, retrieval.match_expression(index, turn_queries(s)), 20)


@on_store("beliefs turns", INDEX + MANY_SQL + " SELECT query_id, string_agg(term, ' ' ORDER BY place) AS query FROM qr GROUP BY 1")
def match_expressions(s):
    return retrieval.match_expression(index_of(s), turn_queries(s))


@on_store(
    "beliefs turns",
    INDEX
    + MANY_SQL
    + f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM mm) r WHERE k <= 50),
    e AS (SELECT query_id, id, content, 0 AS tier, CAST(locked_at AS DOUBLE) AS key FROM beliefs, (SELECT DISTINCT query_id FROM qr) z WHERE valid_to IS NULL AND lock_level <> 'none'
          UNION ALL SELECT query_id, b.id, content, 1, round(ln(score) + 0.5 * ln({MEAN}), 6) FROM best JOIN beliefs b ON b.id = best.id WHERE lock_level = 'none'),
    p AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, sum(ceil(length(content) / 4.0)) OVER (PARTITION BY query_id ORDER BY tier, key DESC, id ROWS UNBOUNDED PRECEDING) AS spent FROM e)
    SELECT query_id, id, tier, tokens, row_number() OVER (PARTITION BY query_id ORDER BY tier, key DESC, id) AS place FROM p WHERE spent <= 60000""",
)
def retrieve_turns(s):
    """Retrieval for as many queries as every twentieth turn."""
    index = index_of(s)
    return retrieval.retrieve(s, index, retrieval.match_expression(index, turn_queries(s)), 60_000)


@on_store("beliefs", INDEX + """, i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, n), b AS (SELECT quantile_cont(idf, 0.001) AS low, quantile_cont(idf, 0.01) AS high FROM i)
    SELECT query_id, term, round(idf, 6) AS idf, qf * CASE WHEN idf > high THEN 2 ELSE 1 END AS qf FROM q JOIN i USING (term), b WHERE idf >= low""")
def idf_clip(s):
    return retrieval.idf_clip(index_of(s), asked(s), 0.001, 0.01)


@on_store("beliefs feedback injections", INDEX + """ SELECT query_id, id FROM m WHERE id IN (SELECT id FROM beliefs WHERE valid_to IS NULL AND lock_level <> 'user')
    AND id NOT IN (SELECT belief_id FROM feedback) AND id NOT IN (SELECT belief_id FROM injections WHERE lane = 'l25')""")
def exploration_pool(s):
    """Matches that were never shown and never judged."""
    hits = index_of(s).match(asked(s)).join(s.active.where("lock_level <> 'user'").select("id"), "id", "left_semi")
    hits = hits.join(s.feedback.select(F.col("belief_id").alias("id")), "id", "left_anti").join(s.injections.where("lane = 'l25'").select(F.col("belief_id").alias("id")), "id", "left_anti")
    return hits.select("query_id", "id")


# ---- similarity -----------------------------------------------------------------------------------------------------------

TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
SHINGLE = "CASE WHEN len(t) >= {0} THEN list_distinct([array_to_string(t[i:i + {0} - 1], ' ') FOR i IN range(1, len(t) - {0} + 2)]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END"


@on_store(
    "turns",
    f""", t AS (SELECT conv_id * 100 + turn AS id, {TOK.format("text")} AS t FROM turns UNION ALL SELECT 900000000 + conv_id * 100 + turn, {TOK.format("text || ' and one more'")} FROM turns WHERE role = 'user'), s AS (SELECT id, {SHINGLE.format(4)} AS s FROM t),
    x AS (SELECT id, unnest(s) AS g FROM s), n AS (SELECT id, len(s) AS n FROM s),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, round(c * 1.0 / (na.n + nb.n - c), 6) AS jaccard FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE c * 1.0 / (na.n + nb.n - c) >= 0.8""",
)
def jaccard_pairs(s):
    """The turns, and those of users once more with three words at their end."""
    rows = s.turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", "role")
    again = rows.where("role = 'user'").select((F.col("id") + 900_000_000).alias("id"), F.concat("text", F.lit(" and one more")).alias("text"))
    return similarity.jaccard_pairs(rows.select("id", "text").unionByName(again), "id", "text", 0.8)


@on_store(
    "turns",
    ", " + one_byte("turns", "text") + """, u AS (SELECT conv_id, turn, translate(text, f, t) AS text FROM turns, ab) SELECT a.conv_id, a.turn, levenshtein(a.text, b.text) AS distance, round(1 - levenshtein(a.text, b.text) * 1.0 / greatest(length(a.text), length(b.text)), 6) AS ratio
    FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
def edit_ratio(s):
    """Each turn beside the next."""
    turns = s.turns
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    rows = turns.select("conv_id", "turn", F.col("text").alias("a")).join(after, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.levenshtein("a", "b").cast("long").alias("distance"), F.round(similarity.edit_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@on_store(
    "turns",
    ", " + one_byte("turns", "text") + """, u AS (SELECT conv_id, turn, translate(text, f, t) AS text FROM turns, ab), d AS (SELECT a.conv_id, a.turn, CAST(sum(levenshtein(a.text, b.text)) AS BIGINT) AS distance FROM u a JOIN u b ON a.conv_id = b.conv_id GROUP BY 1, 2)
    SELECT conv_id, turn AS medoid, distance FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY distance, turn) AS n FROM d) q WHERE n = 1""",
)
def group_medoids(s):
    """The turn of each conversation that is nearest to all its others."""
    return similarity.medoids(s.turns.select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@on_tables(
    f"""WITH t AS (SELECT {TOK.format("text")} AS t FROM benchmark), k AS (SELECT DISTINCT unnest({SHINGLE.format(3)}) AS g FROM t),
    d AS (SELECT doc_id, {TOK.format("text")} AS t FROM documents), x AS (SELECT doc_id AS id, unnest({SHINGLE.format(3)}) AS g FROM d)
    SELECT id, count(*) AS shared FROM x JOIN k USING (g) GROUP BY 1"""
)
def reference_overlap(spark, sf_dir):
    return similarity.reference_overlap(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


@on_store(
    "turns",
    f""", t AS (SELECT conv_id, turn, list_distinct({TOK.format("text")}) AS s FROM turns),
    p AS (SELECT a.conv_id, len(list_intersect(a.s, b.s)) AS n, len(a.s) + len(b.s) AS m FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn)
    SELECT conv_id, round(avg(CASE WHEN m - n > 0 THEN n * 1.0 / (m - n) ELSE 0 END), 6) AS overlap, count(*) AS pairs FROM p GROUP BY 1""",
)
def conversation_overlap(s):
    return similarity.mean_pairwise_jaccard(s.turns, "conv_id", "turn", "text")


# ---- graph ------------------------------------------------------------------------------------------------------------------

WALK_SQL = "CASE type WHEN 'SUPERSEDES' THEN 0.90 WHEN 'CONTRADICTS' THEN 0.85 WHEN 'DERIVED_FROM' THEN 0.70 WHEN 'IMPLEMENTS' THEN 0.65 WHEN 'SUPPORTS' THEN 0.60 WHEN 'TESTS' THEN 0.55 WHEN 'CITES' THEN 0.40 WHEN 'RELATES_TO' THEN 0.30 WHEN 'TEMPORAL_NEXT' THEN 0.25 ELSE 0 END"
REACH = f""", e AS (SELECT CASE WHEN type = 'SUPERSEDES' THEN dst ELSE src END AS src, CASE WHEN type = 'SUPERSEDES' THEN src ELSE dst END AS dst, CAST({WALK_SQL} AS DOUBLE) AS w FROM edges),
    g AS (SELECT src, dst, w FROM e JOIN beliefs ON id = dst WHERE valid_to IS NULL AND w > 0), s AS (SELECT id AS seed FROM beliefs WHERE valid_to IS NULL),
    h1 AS (SELECT seed, dst AS node, w AS score FROM s JOIN g ON src = seed WHERE w >= 0.1), h2 AS (SELECT seed, dst AS node, score * w AS score FROM h1 JOIN g ON src = node WHERE score * w >= 0.1),
    r AS (SELECT seed, node, round(max(score), 6) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) u WHERE seed <> node GROUP BY 1, 2)"""


def _active_seeds(s):
    return s.active.select(F.col("id").alias("seed"))


@on_store("beliefs edges", REACH + " SELECT * FROM r")
def multi_hop_reach(s):
    return graph.reachable(s, _active_seeds(s))


@on_store("beliefs edges", REACH + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, node) AS place FROM r) q WHERE place <= 3")
def multi_hop_top(s):
    return graph.top_reached(s, _active_seeds(s), 3)


@on_store(
    "edges feedback",
    """SELECT dst AS id, round(sum(v * CASE type WHEN 'SUPPORTS' THEN 1.0 WHEN 'CITES' THEN 0.5 WHEN 'CONTRADICTS' THEN -0.5 WHEN 'RELATES_TO' THEN 0.3 WHEN 'DERIVED_FROM' THEN 0.5 WHEN 'IMPLEMENTS' THEN 0.65 WHEN 'TEMPORAL_NEXT' THEN 0.2 WHEN 'TESTS' THEN 0.55 END * 0.5), 6) AS delta
    FROM edges JOIN (SELECT belief_id, sum(valence) AS v FROM feedback GROUP BY 1) f ON belief_id = src WHERE type NOT IN ('SUPERSEDES', 'RESOLVES', 'POTENTIALLY_STALE') GROUP BY 1""",
)
def valence_propagation(s):
    return graph.propagate(s)


@on_store(
    "beliefs edges",
    REACH + """, k AS (SELECT DISTINCT dst, type FROM edges WHERE type IN ('SUPERSEDES', 'CONTRADICTS')), f AS (SELECT dst, product(CASE type WHEN 'SUPERSEDES' THEN 0.5 ELSE 0.8 END) AS factor FROM k GROUP BY 1)
    SELECT seed, node, round(score * coalesce(factor, 1.0), 6) AS score FROM r LEFT JOIN f ON dst = node""",
)
def marker_rerank(s):
    return graph.marker_rerank(s, graph.reachable(s, _active_seeds(s)), {"SUPERSEDES": 0.5, "CONTRADICTS": 0.8})


LAPLACE = """, z AS (SELECT src, dst, weight * CASE type WHEN 'CONTRADICTS' THEN -1.0 WHEN 'SUPERSEDES' THEN -0.5 ELSE 1.0 END AS w FROM edges WHERE type IN ('SUPPORTS', 'CITES', 'RELATES_TO', 'DERIVED_FROM', 'CONTRADICTS', 'SUPERSEDES') AND src <> dst),
    w AS (SELECT i, j, sum(w) AS w FROM (SELECT src AS i, dst AS j, w FROM z UNION ALL SELECT dst, src, w FROM z) u GROUP BY 1, 2), d AS (SELECT i, sum(abs(w)) AS d FROM w GROUP BY 1),
    l AS (SELECT w.i, w.j, round(-w.w / sqrt(a.d * b.d), 6) AS v FROM w JOIN d a ON a.i = w.i JOIN d b ON b.i = w.j WHERE a.d > 0 AND b.d > 0)"""


@on_store("edges", LAPLACE + " SELECT * FROM l")
def signed_laplacian(s):
    return graph.signed_laplacian(s)


@on_store("beliefs edges", LAPLACE + """, h AS (SELECT id AS i, 1.0 AS s FROM beliefs WHERE valid_to IS NULL), f AS (SELECT l.i, sum(v * s) AS x FROM l JOIN h ON h.i = l.j GROUP BY 1)
    SELECT coalesce(h.i, f.i) AS i, round(coalesce(s, 0.0) - 0.2 * (coalesce(s, 0.0) + coalesce(x, 0.0)), 6) AS s FROM h FULL JOIN f ON h.i = f.i""")
def heat_step(s):
    return graph.heat_step(s, s.active.select(F.col("id").alias("i"), F.lit(1.0).alias("s")), 0.2)


@on_store(
    "edges",
    """, RECURSIVE_MARK AS (SELECT 1), u AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'SUPPORTS' UNION SELECT dst, src FROM edges WHERE type = 'SUPPORTS'),
    r AS (SELECT a AS id, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.id) SELECT id, min(root) AS root FROM r GROUP BY 1""".replace("RECURSIVE_MARK AS (SELECT 1), ", ""),
)
def connected_components(s):
    return graph.components(s.edges.where("type = 'SUPPORTS'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


ORACLE_SQL["connected_components"] = ORACLE_SQL["connected_components"].replace("WITH ", "WITH RECURSIVE ", 1)


@on_tables(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
    SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS r, c AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) AS place FROM
      (SELECT a, b, round(CASE WHEN a.n > 0 AND b.n > 0 THEN list_dot_product(a.e, b.e) / (a.n * b.n) ELSE 0 END, 6) AS c FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0) p) q WHERE place <= 5"""
)
def cosine_top(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return recall.cosine_top(rows.where("vec_id % 20 = 0"), rows, 5).select("q", "r", "cosine", "place")


@on_tables("SELECT label, k - 1 AS k, round(sum(x), 4) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings) q GROUP BY 1, 2")
def superposition(spark, sf_dir):
    return graph.superposition(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("k", F.col("k").cast("long"))


# ---- texts --------------------------------------------------------------------------------------------------------------------

PAGE = r"regexp_replace(html, '<[^>]*>', chr(10), 'g')"
BLANK = r"regexp_matches(text, '^ *$')"
LINES = r"list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x) <> '')"


@on_store(
    "beliefs",
    rf"""SELECT id, CASE WHEN trim(text) = '' THEN 'empty'
    WHEN len(ls) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*#{{1,6}}\s+\S'))) = len(ls) THEN 'heading'
    WHEN len(ls) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[-*+]\s*\[[ xX]\]\s'))) = len(ls) THEN 'checklist'
    WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) < 4 THEN 'fragment'
    WHEN regexp_matches(text, '(?i)\bcopyright\s*(\(c\)|©)') OR regexp_matches(text, '(?i)permission is hereby granted,?\s+free of charge') OR regexp_matches(text, '(?i)licensed under the apache license')
      OR regexp_matches(text, '(?i)redistribution and use in source and binary') OR regexp_matches(text, '(?i)gnu (lesser )?general public license')
      OR regexp_matches(text, '(?im)^\s*MIT License\s*$') OR regexp_matches(text, '(?i)\ball rights reserved\b\.?\s*$') THEN 'license' END AS noise
    FROM (SELECT id, content AS text, {LINES.replace("text", "content")} AS ls FROM beliefs) q""",
)
def noise_kinds(s):
    return s.beliefs.select("id", text.noise_kind(F.col("content")).alias("noise"))


TYPE = r"""CASE WHEN trim(lower(text)) = '' OR q THEN NULL WHEN regexp_matches(lower(text), '\b(hard rules|hard rule|constraints|constraint|requirement|mandatory|required|requires|hard cap|require|must)\b(\.?[^.a-z0-9]|\.?$|[^.])') THEN 'requirement'
    WHEN regexp_matches(lower(text), 'prefer|favorite|always use|never use|i like|i hate|i want') THEN 'preference' ELSE 'factual' END"""


@on_store(
    "turns",
    rf"""SELECT conv_id, turn, t AS type, CASE WHEN role = 'user' THEN a ELSE greatest(0.5, a * 0.2) END AS alpha, CASE WHEN t = 'requirement' THEN 0.5 ELSE 1.0 END AS beta FROM
    (SELECT *, CASE t WHEN 'requirement' THEN 9.0 WHEN 'preference' THEN 7.0 ELSE 3.0 END AS a FROM (SELECT conv_id, turn, role, {TYPE} AS t FROM
    (SELECT *, ends_with(trim(text), '?') AND NOT contains(trim(text), chr(10)) AND NOT regexp_matches(regexp_replace(trim(text), '\?$', ''), '[.!?][''")\]]*\s') AS q FROM turns) x) y) z""",
)
def sentence_types(s):
    kind = text.sentence_type(F.col("text"))
    rows = s.turns.select("conv_id", "turn", "role", kind.alias("type"))
    user = F.col("role") == "user"
    return rows.select("conv_id", "turn", "type", text.prior(F.col("type"), user, "alpha").alias("alpha"), text.prior(F.col("type"), user, "beta").alias("beta"))


@on_store(
    "turns",
    r"""SELECT conv_id, turn, len(s) AS n, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS chars FROM (SELECT conv_id, turn, list_filter(list_transform(flatten(list_transform(
    regexp_split_to_array(regexp_replace(regexp_replace(text, '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\r\n|\r|\n'),
    lambda l: string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: trim(x)), lambda x: length(x) >= 10) AS s FROM turns) q""",
)
def sentence_counts(s):
    rows = s.turns.select("conv_id", "turn", text.sentences(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@on_store("beliefs", r"SELECT id, substr(sha256(session_id || chr(0) || content), 1, 16) AS belief_id, sha256(trim(regexp_replace(lower(content), '\s+', ' ', 'g'))) AS triple_hash FROM beliefs")
def content_ids(s):
    return s.beliefs.select("id", text.belief_id(F.col("session_id"), F.col("content")).alias("belief_id"), text.triple_hash(F.col("content")).alias("triple_hash"))


# ---- measures -------------------------------------------------------------------------------------------------------------------


@on_store(
    "beliefs",
    INDEX
    + """, t AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM m) r WHERE place <= 20),
    x AS (SELECT query_id, place, CASE WHEN alpha >= 3 THEN 1 ELSE 0 END AS rel FROM t JOIN beliefs USING (id)), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, place) AS best FROM x)
    SELECT query_id, round(sum(CASE WHEN place <= 10 THEN rel ELSE 0 END) / 10.0, 6) AS precision, round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN place END), 0), 6) AS reciprocal_rank,
    round(CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN place <= 10 THEN rel / log2(place + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN rel / log2(best + 1) ELSE 0 END) ELSE 0 END, 6) AS ndcg FROM y GROUP BY 1""",
)
def ranking_metrics(s):
    rows = retrieval.top(index_of(s).match(asked(s)), 20).join(s.beliefs.select("id", (F.col("alpha") >= 3).alias("relevant")), "id")
    return metrics.ranking(rows, "query_id", 10)


@on_store(
    "beliefs",
    f"""SELECT session_id, round(CASE WHEN max(p) * max(n) > 0 THEN sum(CASE WHEN pos THEN r END) / (max(p) * max(n)) - (max(p) + 1) / (2.0 * max(n)) END, 6) AS auc FROM
    (SELECT session_id, alpha >= 4 AS pos, rank() OVER (PARTITION BY session_id ORDER BY beta) + (count(*) OVER (PARTITION BY session_id, beta) - 1) / 2.0 AS r,
    count(*) FILTER (WHERE alpha >= 4) OVER (PARTITION BY session_id) AS p, count(*) FILTER (WHERE alpha < 4) OVER (PARTITION BY session_id) AS n FROM beliefs) q GROUP BY 1""",
)
def roc_auc(s):
    return metrics.roc_auc(s.beliefs.withColumn("pos", F.col("alpha") >= 4), "session_id", "beta", "pos")


@on_store(
    "beliefs",
    """SELECT type, round(corr(a, b), 6) AS rho FROM (SELECT type, rank() OVER (PARTITION BY type ORDER BY alpha) + (count(*) OVER (PARTITION BY type, alpha) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY type ORDER BY length(content)) + (count(*) OVER (PARTITION BY type, length(content)) - 1) / 2.0 AS b FROM beliefs) q GROUP BY 1""",
)
def spearman_rho(s):
    return metrics.spearman(s.beliefs.withColumn("n", F.length("content")), "type", "alpha", "n")


@on_store("beliefs", f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(abs(avg(p) - avg(CASE WHEN origin LIKE 'user%' THEN 1.0 ELSE 0.0 END)), 6) AS gap FROM (SELECT *, {MEAN} AS p FROM beliefs) q GROUP BY 1")
def calibration_error(s):
    rows = s.beliefs.select(scoring.posterior_mean(F.col("alpha"), F.col("beta")).alias("p"), F.col("origin").startswith("user").alias("y"))
    return metrics.calibration_error(rows, "p", "y")


@on_store(
    "beliefs",
    "SELECT session_id, round(CASE WHEN c < 1 THEN (o - c) / (1 - c) ELSE 1 END, 6) AS kappa FROM (SELECT session_id, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS o, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS c FROM (SELECT session_id, CASE WHEN alpha >= 3 THEN 1.0 ELSE 0.0 END AS x, CASE WHEN seq % 3 = 0 THEN 1.0 ELSE 0.0 END AS y FROM beliefs) q GROUP BY 1) z",
)
def cohens_kappa(s):
    return metrics.kappa(s.beliefs.select("session_id", (F.col("alpha") >= 3).alias("x"), (F.col("seq") % 3 == 0).alias("y")), "session_id", "x", "y")


ANSWER = r"""list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"""


@on_store(
    "turns",
    f""", x AS (SELECT conv_id * 100 + turn AS id, {ANSWER.format("text")} AS p, {ANSWER.format("lead(text) OVER (PARTITION BY conv_id ORDER BY turn)")} AS t FROM turns QUALIFY lead(text) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL),
    w AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(p) AS w FROM x) a GROUP BY 1, 2), v AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(t) AS w FROM x) a GROUP BY 1, 2),
    c AS (SELECT id, sum(least(w.n, v.n)) AS same FROM w JOIN v USING (id, w) GROUP BY 1)
    SELECT id, array_to_string(p, ' ') = array_to_string(t, ' ') AS exact, contains(array_to_string(p, ' '), array_to_string(t, ' ')) AS contains,
    round(CASE WHEN len(p) + len(t) > 0 THEN 2.0 * coalesce(same, 0) / (len(p) + len(t)) ELSE 1.0 END, 6) AS f1 FROM x LEFT JOIN c USING (id)""",
)
def answer_scores(s):
    """Every turn held against the one after it."""
    from pyspark.sql import Window

    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return metrics.answers(s.turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("a"), after.alias("b")).where("b IS NOT NULL"), "id", "a", "b")


# ---- streams ------------------------------------------------------------------------------------------------------------

FEEDBACK = oracle_tables("feedback")


@on_tables(
    FEEDBACK
    + """ SELECT created_at // 3600 * 3600 AS start, source, count(*) AS n, round(avg(valence), 6) AS mean_valence FROM feedback
    WHERE created_at // 3600 * 3600 + 3600 <= (SELECT max(created_at) - 7200 FROM feedback) GROUP BY 1, 2"""
)
def stream_window_rollup(spark, sf_dir):
    return streams.run_available(streams.window_rollup(streams.read(spark, sf_dir), 3600, 7200), "rollup")


@on_tables(
    FEEDBACK
    + """ SELECT v.feedback_id, v.belief_id, a.feedback_id AS answer_id FROM feedback v
    JOIN feedback a ON a.belief_id = v.belief_id AND a.source <> 'view' AND a.created_at BETWEEN v.created_at AND v.created_at + 300000 WHERE v.source = 'view'"""
)
def stream_answered_exposures(spark, sf_dir):
    return streams.run_available(streams.answered_exposures(streams.read(spark, sf_dir), streams.read(spark, sf_dir), 300_000, 7200), "answers")


@on_tables(FEEDBACK + " SELECT DISTINCT * FROM (SELECT * FROM feedback UNION ALL SELECT * FROM feedback WHERE valence <> 0) q")
def stream_first_in_window(spark, sf_dir):
    """A log in which every row with a valence was delivered twice."""
    log = streams.read(spark, sf_dir)
    return streams.run_available(streams.first_in_window(log.unionByName(streams.read(spark, sf_dir).where("valence <> 0")), 7200), "first")


@on_tables(FEEDBACK + " SELECT session_id, feedback_id, row_number() OVER (PARTITION BY session_id ORDER BY feedback_id) AS fire_idx FROM feedback")
def stream_session_counters(spark, sf_dir):
    return streams.run_available(streams.session_counters(streams.read(spark, sf_dir)), "counters")


from . import catalog_draws, catalog_graph, catalog_ingest, catalog_ledger, catalog_locks, catalog_reports, catalog_text  # noqa: E402, F401  they register their queries
