"""Queries of scans, sinks, mutations and summaries of the store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger, relational
from ..plans.session import new_folder
from ..sources import files
from ..sources.model import Store
from .registry import BASE, MEAN, on_store

NOW = BASE + 900_000
#: Beliefs that errors were reported on: those that the mutations below change.
HIT = "(SELECT DISTINCT belief_id FROM feedback WHERE source = 'error')"


def _hit(s: Store) -> DataFrame:
    return s.feedback.where("source = 'error'").select(F.col("belief_id").alias("id")).distinct()


# ---- scans --------------------------------------------------------------------------------------------------------------


@on_store("beliefs", "SELECT id, content FROM beliefs WHERE valid_to IS NULL")
def index_scan(s):
    return ledger.for_indexing(s)


@on_store("beliefs", "SELECT id, created_at FROM beliefs WHERE valid_to IS NULL ORDER BY created_at DESC, id DESC LIMIT 40")
def newest_beliefs(s):
    return ledger.newest(s, 40)


@on_store("beliefs", "SELECT id, row_number() OVER (ORDER BY seq DESC) AS place FROM beliefs")
def ids_newest_first(s):
    return ledger.ids_newest_first(s)


@on_store("beliefs", "SELECT id FROM beliefs")
def belief_ids(s):
    return s.beliefs.select("id")


@on_store("edges", "SELECT src, dst, type, weight FROM edges")
def edge_scan(s):
    return s.edges.select("src", "dst", "type", "weight")


@on_store("edges", "SELECT dst, anchor_text FROM edges WHERE anchor_text <> ''")
def anchor_texts(s):
    return ledger.anchor_texts(s)


LOOKUP = "SELECT b.id, content_hash, valid_to, coalesce(n, 0) AS times FROM beliefs b LEFT JOIN (SELECT belief_id, count(*) AS n FROM corroborations GROUP BY 1) c ON c.belief_id = b.id WHERE "


@on_store("beliefs corroborations feedback", f"{LOOKUP} b.id IN {HIT} AND valid_to IS NULL")
def lookup_by_id(s):
    return ledger.lookup(s, _hit(s))


@on_store("beliefs corroborations feedback", f"{LOOKUP} content_hash IN (SELECT content_hash FROM beliefs WHERE id IN {HIT})")
def lookup_by_hash(s):
    hashes = s.beliefs.join(_hit(s), "id", "left_semi").select("content_hash")
    return ledger.lookup(s, hashes, "content_hash", retired=True)


@on_store("edges feedback", f"SELECT DISTINCT src, dst, type, weight FROM edges WHERE src IN {HIT} OR dst IN {HIT}")
def edges_touching(s):
    return ledger.edges_of(s, _hit(s))


@on_store("edges feedback", f"SELECT src, dst, type, weight FROM edges WHERE src IN {HIT}")
def edges_out(s):
    return ledger.edges_of(s, _hit(s), "out")


@on_store("edges feedback", f"SELECT src, dst, type, weight FROM edges WHERE dst IN {HIT}")
def edges_in(s):
    return ledger.edges_of(s, _hit(s), "in")


@on_store("beliefs edges", "SELECT src, dst, type FROM edges WHERE src IN (SELECT id FROM beliefs WHERE valid_to IS NULL AND coalesce(scope, 'project') = 'global')")
def scoped_edges_out(s):
    return ledger.edges_in_scope(s, "global")


@on_store("beliefs edges", "SELECT src, dst, type FROM edges WHERE dst IN (SELECT id FROM beliefs WHERE valid_to IS NULL AND coalesce(scope, 'project') = 'shared:team')")
def scoped_edges_in(s):
    return ledger.edges_in_scope(s, "shared:team", "in")


@on_store("beliefs feedback", f"SELECT id, scope FROM beliefs WHERE valid_to IS NULL AND coalesce(scope, 'project') = 'project' AND id IN {HIT}")
def scoped_beliefs(s):
    return ledger.scoped_beliefs(s, _hit(s), "project")


@on_store("edges", "SELECT type, EXISTS (SELECT 1 FROM edges e WHERE e.type = k.type) AS there FROM (VALUES ('TESTS'), ('RESOLVES'), ('CALLS')) AS k(type)")
def edge_types_there(s):
    return ledger.has_edge_type(s, ("TESTS", "RESOLVES", "CALLS"))


@on_store("log", "SELECT log_id, source_kind FROM log WHERE derived_ids IS NULL")
def unstamped_log(s):
    return ledger.unstamped(s)


DERIVED = "(SELECT log_id, source_kind, unnest(CAST(derived_ids AS JSON)->>'$[*]') AS id FROM log WHERE derived_ids IS NOT NULL)"


@on_store("beliefs log", f"SELECT id, content_hash FROM beliefs WHERE id NOT IN (SELECT id FROM {DERIVED} d WHERE source_kind <> 'legacy_unknown')")
def canonical_orphans(s):
    return ledger.canonical_orphans(s)


@on_store("beliefs log", f"SELECT count(*) AS beliefs, count(*) FILTER (WHERE id IN (SELECT id FROM {DERIVED} d)) AS reached, count(*) FILTER (WHERE id NOT IN (SELECT id FROM {DERIVED} d)) AS orphans FROM beliefs")
def log_reachability(s):
    return ledger.reachability(s)


@on_store(
    "edges log",
    """, m AS (SELECT DISTINCT CAST(derived_ids AS JSON)->>1 AS src, CAST(derived_ids AS JSON)->>0 AS dst FROM log WHERE derived_ids IS NOT NULL), e AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'DERIVED_FROM')
    SELECT CASE WHEN e.src IS NULL THEN 'log_only' WHEN m.src IS NULL THEN 'store_only' ELSE 'both' END AS side, count(*) AS n FROM e FULL JOIN m ON e.src = m.src AND e.dst = m.dst GROUP BY 1""",
)
def replay_diff(s):
    return ledger.replay_diff(s)


@on_store(
    "beliefs edges",
    """, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, created_at FROM edges JOIN beliefs ON id = src WHERE edges.type = 'CONTRADICTS')
    SELECT DISTINCT a, b FROM p WHERE (a, b) NOT IN (SELECT (a, b) FROM p WHERE created_at < 1704073200)""",
)
def new_contradictions(s):
    pairs = s.edges.where("type = 'CONTRADICTS'").join(s.beliefs.select(F.col("id").alias("src"), "created_at"), "src")
    pairs = pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "created_at")
    return ledger.new_contradictions(pairs.select("a", "b").distinct(), pairs.where("created_at < 1704073200").select("a", "b"))


# ---- sinks --------------------------------------------------------------------------------------------------------------

NEW_EDGES = "(SELECT belief_id AS src, 'd' || (feedback_id % 50) AS dst, 'SUPPORTS' AS type, CAST(max(valence) AS DOUBLE) AS weight FROM feedback WHERE valence > 0 GROUP BY 1, 2)"


@on_store("edges feedback", f"SELECT src, dst, type, weight FROM edges UNION ALL SELECT * FROM {NEW_EDGES} n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = n.src AND e.dst = n.dst AND e.type = n.type)")
def append_edges(s):
    new = s.feedback.where("valence > 0").select(F.col("belief_id").alias("src"), F.concat(F.lit("d"), F.col("feedback_id") % 50).alias("dst"), F.lit("SUPPORTS").alias("type"), F.col("valence").alias("weight"))
    return ledger.append_edges(s.edges, new)


@on_store(
    "beliefs feedback",
    """, c AS (SELECT belief_id AS id, arg_max(source, feedback_id) AS type FROM feedback GROUP BY 1)
    SELECT id, type FROM beliefs WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, type FROM c""",
)
def upsert_beliefs(s):
    changes = s.feedback.select(F.col("belief_id").alias("id"), F.col("source").alias("type"), "feedback_id")
    return ledger.upsert(s.beliefs.select("id", "type"), changes, ["id"], "feedback_id")


@on_store("feedback", "SELECT belief_id, valence, source, created_at FROM feedback UNION ALL SELECT belief_id, 0.0, 'seen', 1704967200 FROM (SELECT DISTINCT belief_id FROM feedback WHERE source = 'error') q")
def append_feedback(s):
    return s.feedback.select("belief_id", "valence", "source", "created_at").unionByName(ledger.audit_rows(_hit(s), "seen", NOW))


@on_store(
    "log",
    """, o AS (SELECT log_id::VARCHAR AS log_id, source_kind, CAST(NULL AS VARCHAR) AS source_path, raw_text, session_id, raw_meta, derived_ids, created_at FROM log),
    n AS (SELECT DISTINCT substr(sha256('transcript' || chr(0) || 'p' || log_id % 5 || chr(0) || raw_text || chr(0) || session_id || chr(0) || (created_at + 60)), 1, 26) AS log_id, 'transcript' AS source_kind, 'p' || log_id % 5 AS source_path, raw_text, session_id,
      '{"row":' || log_id || '}' AS raw_meta, '["d' || log_id || '"]' AS derived_ids, created_at + 60 AS created_at FROM log WHERE log_id % 2 = 0)
    SELECT * FROM o UNION ALL SELECT * FROM n""",
)
def append_log(s):
    """The log with rows of raw texts added, each of which comes twice."""
    n = F.col("log_id")
    log = s.log.select(n.cast("string").alias("log_id"), "source_kind", F.lit(None).cast("string").alias("source_path"), "raw_text", "session_id", "raw_meta", "derived_ids", "created_at")
    raw = s.log.where(n % 2 == 0).select(
        F.lit("transcript").alias("source_kind"), F.concat(F.lit("p"), n % 5).alias("source_path"), "raw_text", F.struct(n.alias("row")).alias("raw_meta"), F.array(F.concat(F.lit("d"), n)).alias("derived_ids"), "session_id", (F.col("created_at") + 60).alias("created_at")
    )
    rows = ledger.log_rows(raw)
    return ledger.append_log(log, rows.unionByName(rows))


@on_store("feedback", "SELECT created_at AS ts, source AS event, belief_id, CASE WHEN valence <> 0 THEN valence END AS valence FROM feedback UNION ALL SELECT created_at + 1, 'lock', belief_id, NULL FROM feedback WHERE source = 'purchase'")
def feed_log(s):
    """Events written to a feed log in two calls, and read again."""
    folder = new_folder(s.feedback.sparkSession, "feed")
    files.append_feed(s.feedback.select(F.col("created_at").alias("ts"), F.col("source").alias("event"), "belief_id", F.when(F.col("valence") != 0, F.col("valence")).alias("valence")), folder)
    files.append_feed(s.feedback.where("source = 'purchase'").select((F.col("created_at") + 1).alias("ts"), F.lit("lock").alias("event"), "belief_id"), folder)
    return files.read_feed(s.feedback.sparkSession, folder, "ts long, event string, belief_id string, valence double")


@on_store(
    "injections",
    "SELECT event_id, session_id, turn_id, belief_id, injected_at FROM injections UNION ALL SELECT 1000000 + event_id, session_id, turn_id + 1, belief_id, injected_at + 60 FROM injections WHERE lane = 'l25'",
)
def append_injections(s):
    """The exposures of another turn added to the ledger."""
    columns = ("event_id", "session_id", "turn_id", "belief_id", "injected_at")
    more = s.injections.where("lane = 'l25'").select((F.col("event_id") + 1_000_000).alias("event_id"), "session_id", (F.col("turn_id") + 1).alias("turn_id"), "belief_id", (F.col("injected_at") + 60).alias("injected_at"))
    return s.injections.select(*columns).unionByName(more)


CORROBORATED = "SELECT belief_id, coalesce(CAST(session_id AS VARCHAR), '') AS session, coalesce(source_path_hash, '') AS path, source_type, min(ingested_at) AS ingested_at FROM corroborations"


@on_store("corroborations", f"{CORROBORATED} GROUP BY 1, 2, 3, 4 HAVING min(ingested_at) >= {BASE + 20_000}")
def record_corroborations(s):
    late = F.col("ingested_at") >= BASE + 20_000
    return ledger.corroborate(s.corroborations.where(~late), s.corroborations.where(late))


@on_store(
    "beliefs turns",
    """, i AS (SELECT sha256(content) AS content_hash, 'transcript' AS source_type, seq + 1000000 AS said_at, 'new-' || id AS new_id FROM beliefs
      UNION ALL SELECT sha256(text), CASE WHEN role = 'user' THEN 'user' ELSE 'transcript' END, conv_id * 100 + turn, 'turn-' || (conv_id * 100 + turn) FROM turns
      UNION ALL SELECT sha256(content), 'user', seq, 'again-' || id FROM beliefs WHERE valid_to IS NOT NULL AND seq % 2 = 0),
    o AS (SELECT content_hash, arg_min(id, (valid_to IS NOT NULL, id)) AS id, bool_and(valid_to IS NOT NULL) AS retired FROM beliefs GROUP BY 1),
    g AS (SELECT content_hash, count(*) AS n, arg_min(new_id, (said_at, new_id)) AS new_id, bool_or(source_type = 'user') AS explicit FROM i GROUP BY 1)
    SELECT content_hash, coalesce(id, new_id) AS belief_id, CASE WHEN id IS NULL THEN 'inserted' WHEN NOT retired THEN 'corroborated' WHEN explicit THEN 'revived' ELSE 'refused' END AS action,
    CASE WHEN id IS NULL THEN n - 1 WHEN retired AND NOT explicit THEN 0 ELSE n END AS corroborations FROM g LEFT JOIN o USING (content_hash)""",
)
def insert_or_corroborate(s):
    def rows(df, text, source, at, new_id):
        return df.select(F.sha2(text, 256).alias("content_hash"), source.alias("source_type"), at.cast("long").alias("at"), new_id.alias("new_id"))

    key = F.col("conv_id") * 100 + F.col("turn")
    incoming = rows(s.beliefs, "content", F.lit("transcript"), F.col("seq") + 1_000_000, F.concat(F.lit("new-"), "id"))
    incoming = incoming.unionByName(rows(s.turns, "text", F.when(F.col("role") == "user", "user").otherwise("transcript"), key, F.concat(F.lit("turn-"), key)))
    incoming = incoming.unionByName(rows(s.beliefs.where("valid_to IS NOT NULL AND seq % 2 = 0"), "content", F.lit("user"), F.col("seq"), F.concat(F.lit("again-"), "id")))
    return ledger.insert_or_corroborate(s, incoming, ("user",))


# ---- mutations ------------------------------------------------------------------------------------------------------------


@on_store("beliefs feedback", f"SELECT id, CASE WHEN id IN {HIT} AND valid_to IS NULL THEN {NOW} ELSE valid_to END AS valid_to FROM beliefs")
def soft_delete(s):
    return ledger.soft_delete(s.beliefs, _hit(s), NOW).select("id", "valid_to")


@on_store("beliefs feedback", f"SELECT id, CASE WHEN id NOT IN {HIT} THEN valid_to END AS valid_to FROM beliefs")
def restore_beliefs(s):
    return ledger.restore(s.beliefs, _hit(s)).select("id", "valid_to")


@on_store(
    "beliefs edges entities feedback",
    f"""SELECT 'beliefs' AS name, count(*) AS n FROM beliefs WHERE id NOT IN {HIT} UNION ALL SELECT 'edges', count(*) FROM edges WHERE src NOT IN {HIT} AND dst NOT IN {HIT}
    UNION ALL SELECT 'entities', count(*) FROM entities WHERE belief_id NOT IN {HIT}""",
)
def hard_delete(s):
    out = None
    for name, rows in zip(("beliefs", "edges", "entities"), ledger.hard_delete(s, _hit(s)), strict=True):
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@on_store("edges", "SELECT src, dst, type FROM edges WHERE type <> 'POTENTIALLY_STALE'")
def delete_edges_by_type(s):
    return ledger.delete_edges(s.edges, "POTENTIALLY_STALE").select("src", "dst", "type")


@on_store("edges", "SELECT src, dst, type, weight FROM edges WHERE NOT (type = 'TEMPORAL_NEXT' AND weight = CAST(0.3 + 0 * 0.1 AS DOUBLE))")
def clear_spine(s):
    return ledger.delete_edges(s.edges, "TEMPORAL_NEXT", 0.3).select("src", "dst", "type", "weight")


@on_store("beliefs feedback", "SELECT feedback_id, belief_id FROM feedback WHERE belief_id IN (SELECT id FROM beliefs)")
def delete_orphan_feedback(s):
    return ledger.without_orphan_feedback(s).select("feedback_id", "belief_id")


@on_store("beliefs feedback", f"SELECT id, CASE WHEN id IN {HIT} THEN 'transient' ELSE retention_class END AS retention_class FROM beliefs")
def set_retention(s):
    return ledger.set_retention(s.beliefs, _hit(s), "transient").select("id", "retention_class")


@on_store("beliefs feedback", f"SELECT id, CASE WHEN id IN {HIT} THEN {NOW} ELSE last_retrieved_at END AS last_retrieved_at FROM beliefs")
def stamp_retrieved(s):
    return ledger.stamp_retrieved(s.beliefs, _hit(s), NOW).select("id", "last_retrieved_at")


@on_store(
    "beliefs feedback",
    f"""SELECT id, outcome, CASE WHEN outcome = 'promoted' THEN 'user_validated' ELSE origin END AS origin FROM (SELECT id, origin, CASE WHEN lock_level = 'user' OR origin = 'user_stated' THEN 'refused'
    WHEN origin = 'user_validated' THEN 'already' ELSE 'promoted' END AS outcome FROM beliefs WHERE valid_to IS NULL AND id IN {HIT}) q""",
)
def promote_beliefs(s):
    return ledger.promotions(s, _hit(s))


@on_store(
    "beliefs feedback",
    f"""SELECT id, CASE WHEN ok THEN 'devalidated' ELSE 'refused' END AS outcome, CASE WHEN ok THEN 'agent_inferred' ELSE origin END AS origin
    FROM (SELECT *, lock_level <> 'user' AND origin = 'user_validated' AS ok FROM beliefs WHERE valid_to IS NULL AND id IN {HIT}) q""",
)
def devalidate_beliefs(s):
    return ledger.devalidations(s, _hit(s))


@on_store(
    "beliefs feedback",
    f"""SELECT id, CASE WHEN lock_level = 'user' THEN 'unlocked' ELSE 'already' END AS outcome, CASE WHEN lock_level = 'user' THEN 'none' ELSE lock_level END AS lock_level,
    CASE WHEN lock_level <> 'user' THEN locked_at END AS locked_at FROM beliefs WHERE valid_to IS NULL AND id IN {HIT}""",
)
def unlock_beliefs(s):
    return ledger.unlocks(s, _hit(s))


def _resolved(winners: str) -> str:
    return f""", w AS ({winners}) SELECT winner AS src, loser AS dst, 'SUPERSEDES' AS type, CAST(1.0 AS DOUBLE) AS weight FROM w
    WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.type = 'SUPERSEDES' AND e.src = winner AND e.dst = loser)"""


def _register_resolutions() -> None:
    from .catalog import OPEN, RANK

    first = f"({RANK.format('x')}, -x.created_at, x.id) <= ({RANK.format('y')}, -y.created_at, y.id)"
    winners = f"SELECT CASE WHEN first THEN a ELSE b END AS winner, CASE WHEN first THEN b ELSE a END AS loser FROM (SELECT o.a, o.b, {first} AS first FROM ({{}}) o JOIN beliefs x ON x.id = o.a JOIN beliefs y ON y.id = o.b) q"

    @on_store("beliefs edges", _resolved(winners.format(OPEN)))
    def resolve_contradictions(s):
        return ledger.resolutions(s, relational.contradiction_winners(s))

    @on_store("beliefs edges", f", w AS ({winners.format(OPEN)}) SELECT loser AS belief_id, CAST(0.0 AS DOUBLE) AS valence, 'contradiction_tiebreaker' AS source, CAST({NOW} AS BIGINT) AS created_at FROM w")
    def resolution_audit(s):
        return ledger.audit_rows(relational.contradiction_winners(s).select(F.col("loser").alias("id")), "contradiction_tiebreaker", NOW)


LINKS = "(SELECT belief_id, 'doc:' || (event_id % 25) AS doc_uri, lane AS anchor_type, injected_at AS created_at FROM injections)"


def _links(s: Store) -> DataFrame:
    return s.injections.select("belief_id", F.concat(F.lit("doc:"), F.col("event_id") % 25).alias("doc_uri"), F.col("lane").alias("anchor_type"), F.col("injected_at").alias("created_at"))


@on_store("injections", f"SELECT belief_id, doc_uri, arg_min(anchor_type, (created_at, anchor_type)) AS anchor_type, min(created_at) AS created_at FROM {LINKS} l GROUP BY 1, 2 HAVING doc_uri <> 'doc:0'")
def link_documents(s):
    links = _links(s)
    return ledger.link_documents(links.where("doc_uri = 'doc:0'"), links)


@on_store("beliefs injections", f"SELECT belief_id, string_agg(doc_uri, ' ' ORDER BY created_at, doc_uri) AS docs FROM {LINKS} l WHERE belief_id IN (SELECT id FROM beliefs WHERE valid_to IS NULL) GROUP BY 1")
def doc_anchors(s):
    return ledger.doc_anchors(s, _links(s))


@on_store("beliefs entities", "SELECT kind AS category, belief_id FROM entities WHERE belief_id IN (SELECT id FROM beliefs WHERE valid_to IS NULL)")
def category_members(s):
    return ledger.category_members(s, s.entities.select(F.col("kind").alias("category"), "belief_id"))


@on_store(
    "feedback",
    """, c AS (SELECT source AS name, feedback_id % 2 = 0 AS always_on, 'f' || session_id AS trigger_json, feedback_id FROM feedback)
    SELECT name, arg_max(always_on, feedback_id) AS always_on, arg_max(trigger_json, feedback_id) AS trigger_json FROM c GROUP BY 1""",
)
def category_upsert(s):
    changes = s.feedback.select(F.col("source").alias("name"), (F.col("feedback_id") % 2 == 0).alias("always_on"), F.concat(F.lit("f"), "session_id").alias("trigger_json"), "feedback_id")
    known = changes.where("feedback_id < 50").drop("feedback_id").dropDuplicates(["name"])
    return ledger.upsert(known, changes, ["name"], "feedback_id")


VERDICT = "CASE seq % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'keep' WHEN 2 THEN 'lock' ELSE 'skip' END"


@on_store(
    "beliefs",
    f"""SELECT id, outcome, CASE WHEN outcome = 'removed' THEN {NOW} END AS valid_to, CASE WHEN outcome = 'locked' THEN 'user' ELSE lock_level END AS lock_level,
    CASE WHEN outcome IN ('kept', 'locked') THEN {NOW} ELSE last_confirmed_at END AS last_confirmed_at FROM (SELECT *, CASE WHEN v = 'skip' THEN 'skipped' WHEN v = 'remove' AND lock_level = 'user' THEN 'refused'
    WHEN v = 'remove' THEN 'removed' WHEN v = 'lock' THEN 'locked' ELSE 'kept' END AS outcome FROM (SELECT *, {VERDICT} AS v FROM beliefs WHERE valid_to IS NULL) q) z""",
)
def review_apply(s):
    k = F.col("seq") % 5
    verdict = F.when(k == 0, "remove").when(k == 1, "keep").when(k == 2, "lock").otherwise("skip")
    return ledger.review_apply(s, s.beliefs.select("id", verdict.alias("verdict")), NOW)


@on_store(
    "beliefs edges",
    """, t AS (SELECT id FROM beliefs WHERE project_context = ''), o AS (SELECT id FROM beliefs WHERE project_context = 'p1' AND id NOT IN (SELECT id FROM t)), i AS (SELECT * FROM t UNION ALL SELECT * FROM o)
    SELECT 'beliefs' AS name, count(*) AS n FROM o UNION ALL SELECT 'edges', count(*) FROM edges WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i) AND (src IN (SELECT id FROM o) OR dst IN (SELECT id FROM o))""",
)
def migrate_store(s):
    rows, edges = ledger.migrate(s, s.beliefs.where("project_context = ''"), "p1")
    counted = [r.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, r in (("beliefs", rows), ("edges", edges))]
    return counted[0].unionByName(counted[1])


# ---- summaries ------------------------------------------------------------------------------------------------------------


@on_store("beliefs", "SELECT count(*) AS all_rows, count(*) FILTER (WHERE valid_to IS NULL) AS active, count(*) FILTER (WHERE lock_level <> 'none') AS locked FROM beliefs")
def count_beliefs(s):
    return ledger.count_by_state(s)


@on_store("corroborations", "SELECT belief_id, count(*) AS n, count(DISTINCT session_id) AS sessions FROM corroborations GROUP BY 1")
def corroboration_counts(s):
    return ledger.corroboration_counts(s)


SEEN = "JOIN (SELECT belief_id, count(*) AS n, count(DISTINCT session_id) AS sessions FROM corroborations GROUP BY 1) c ON belief_id = id WHERE n >= 3 AND sessions >= 2 AND id NOT IN (SELECT dst FROM edges WHERE type = 'CONTRADICTS')"


@on_store("beliefs corroborations edges", f"SELECT id, n, sessions FROM beliefs {SEEN} AND retention_class = 'snapshot' AND origin <> 'speculative'")
def promotable_snapshots(s):
    return ledger.promotable_snapshots(s)


@on_store("beliefs corroborations edges", f"SELECT id, n, sessions FROM beliefs {SEEN} AND valid_to IS NULL AND type = 'speculative' AND origin = 'speculative'")
def promotable_phantoms(s):
    return ledger.promotable_snapshots(s, "phantom")


@on_store("feedback", "SELECT session_id, count(DISTINCT belief_id) AS beliefs, max(feedback_id) AS last FROM feedback GROUP BY 1")
def touch_sessions(s):
    return ledger.touch_sessions(s)


@on_store("injections", f"SELECT CASE WHEN referenced IS NOT NULL THEN 'answered' WHEN injected_at <= {BASE + 500_000} - 1800 THEN 'due' ELSE 'waiting' END AS status, count(*) AS n FROM injections GROUP BY 1")
def queue_by_status(s):
    return ledger.queue_by_status(s, BASE + 500_000, 1800)


@on_store("injections", "SELECT event_id, session_id, turn_id, belief_id FROM injections WHERE referenced IS NULL AND turn_id < 60")
def pending_exposures(s):
    return ledger.pending_exposures(s, 60)


@on_store(
    "injections",
    """, a AS (SELECT event_id - event_id % 3 AS event_id, arg_min(event_id % 2, (injected_at, event_id % 2)) AS said FROM injections GROUP BY 1)
    SELECT i.event_id, CAST(coalesce(referenced, said) AS BIGINT) AS referenced FROM injections i LEFT JOIN a ON a.event_id = i.event_id""",
)
def stamp_referenced(s):
    answers = s.injections.select((F.col("event_id") - F.col("event_id") % 3).alias("event_id"), (F.col("event_id") % 2).alias("said"), F.col("injected_at").alias("at"))
    return ledger.stamp_referenced(s, answers)


@on_store(
    "beliefs edges",
    """SELECT greatest(0, n - g) AS active, g AS superseded, locked, round(g * 1.0 / n, 4) AS churn, orphans FROM (SELECT count(*) AS n, count(*) FILTER (WHERE lock_level <> 'none') AS locked,
    (SELECT count(DISTINCT dst) FROM edges WHERE type = 'SUPERSEDES') AS g, count(*) FILTER (WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)) AS orphans FROM beliefs) q""",
)
def belief_snapshot(s):
    return ledger.snapshot(s)


@on_store("beliefs edges", "SELECT type, count(*) AS edges, round(count(*) * 1.0 / (SELECT count(*) FROM beliefs), 4) AS per_belief FROM edges GROUP BY 1")
def graph_snapshot(s):
    return ledger.graph_snapshot(s)


@on_store(
    "beliefs",
    """SELECT session_id, count(*) AS made, count(*) FILTER (WHERE type = 'correction') AS corrections, max(created_at) - min(created_at) AS seconds,
    round(CASE WHEN max(created_at) > min(created_at) THEN count(*) / ((max(created_at) - min(created_at)) / 3600.0) ELSE 0 END, 4) AS per_hour FROM beliefs GROUP BY 1""",
)
def session_delta(s):
    return ledger.session_delta(s)


@on_store(
    "beliefs feedback corroborations",
    """SELECT id, alpha, CAST(1.0 AS DOUBLE) AS clamped FROM beliefs WHERE valid_to IS NULL AND lock_level = 'none' AND alpha > 2.0 AND origin NOT IN ('user_stated')
    AND id NOT IN (SELECT belief_id FROM feedback) AND id NOT IN (SELECT belief_id FROM corroborations WHERE source_type = 'commit_ingest')""",
)
def ghost_alphas(s):
    return ledger.ghost_alphas(s.replaced(corroborations=s.corroborations.where("source_type = 'commit_ingest'")), 2.0, 1.0, ("user_stated",))


@on_store(
    "beliefs edges",
    f"""SELECT 'orphan_edges' AS finding, count(*) AS n, CASE WHEN count(*) > 0 THEN 'fail' ELSE 'info' END AS severity FROM edges WHERE src NOT IN (SELECT id FROM beliefs) OR dst NOT IN (SELECT id FROM beliefs)
    UNION ALL SELECT 'locked_contradictions', count(*), CASE WHEN count(*) > 0 THEN 'fail' ELSE 'info' END FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM edges e JOIN beliefs x ON x.id = src JOIN beliefs y ON y.id = dst
      WHERE e.type = 'CONTRADICTS' AND x.valid_to IS NULL AND y.valid_to IS NULL AND x.lock_level <> 'none' AND y.lock_level <> 'none') p
    UNION ALL SELECT 'corpus_volume', count(*), CASE WHEN count(*) < 50 THEN 'warn' ELSE 'info' END FROM beliefs
    UNION ALL SELECT 'lock_budget', CAST(sum(ceil(length(content) / 4.0)) AS BIGINT), CASE WHEN sum(ceil(length(content) / 4.0)) > 2400 THEN 'warn' ELSE 'info' END FROM beliefs WHERE valid_to IS NULL AND lock_level <> 'none'
    UNION ALL SELECT 'ingest_gap', CAST(floor(({BASE + 2_000_000} - max(created_at)) / 86400) AS BIGINT), CASE WHEN floor(({BASE + 2_000_000} - max(created_at)) / 86400) > 0 THEN 'warn' ELSE 'info' END FROM beliefs WHERE valid_to IS NULL AND origin IN ('agent_inferred', 'user_transcript')""",
)
def auditor_report(s):
    return ledger.auditor(s, BASE + 2_000_000)


@on_store(
    "entities beliefs",
    """, w AS (SELECT DISTINCT 'q' || k AS query_id, entity_lower FROM entities JOIN (SELECT unnest(range(5)) AS k) r ON belief_id = 'd' || (k * 7)),
    r AS (SELECT DISTINCT belief_id, entity_lower FROM entities WHERE belief_id IN (SELECT id FROM beliefs WHERE valid_to IS NULL))
    SELECT * FROM (SELECT query_id, belief_id, overlap, CAST(overlap AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, belief_id) AS place FROM (SELECT query_id, belief_id, count(*) AS overlap FROM w JOIN r USING (entity_lower) GROUP BY 1, 2) q) z WHERE place <= 20""",
)
def entity_overlap(s):
    return ledger.entity_overlap(s, _wanted(s), 20)


def _wanted(s: Store) -> DataFrame:
    """The entities of five beliefs as five queries."""
    return s.entities.where(F.col("belief_id").isin(*(f"d{7 * k}" for k in range(5)))).select(F.concat(F.lit("q"), (F.substring("belief_id", 2, 9).cast("int") / 7).cast("int")).alias("query_id"), "entity_lower").distinct()


@on_store(
    "entities beliefs",
    """, w AS (SELECT DISTINCT 'q' || k AS query_id, entity_lower FROM entities JOIN (SELECT unnest(range(5)) AS k) r ON belief_id = 'd' || (k * 7)),
    r AS (SELECT DISTINCT belief_id, entity_lower FROM entities WHERE belief_id IN (SELECT id FROM beliefs WHERE valid_to IS NULL)), f AS (SELECT entity_lower, count(*) AS fan FROM r GROUP BY 1),
    n AS (SELECT count(*) AS n FROM beliefs WHERE valid_to IS NULL),
    s AS (SELECT query_id, belief_id, count(*) AS overlap, round(sum(ln(n + 1.0) - ln(fan + 1.0)), 6) AS score FROM w JOIN r USING (entity_lower) JOIN f USING (entity_lower), n GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, belief_id) AS place FROM s) z WHERE place <= 20""",
)
def fan_effect(s):
    return ledger.entity_overlap(s, _wanted(s), 20, fan=True)


@on_store(
    "entities turns",
    """, w AS (SELECT DISTINCT conv_id AS query_id, unnest(regexp_split_to_array(lower(text), ' ')) AS entity_lower FROM turns WHERE role = 'user')
    SELECT query_id, entity_lower FROM w WHERE entity_lower NOT IN (SELECT entity_lower FROM entities)""",
)
def novel_entities(s):
    asked = s.turns.where("role = 'user'").select(F.col("conv_id").alias("query_id"), F.explode(F.split(F.lower("text"), " ")).alias("entity_lower"))
    return ledger.novel_entities(s, asked)


@on_store(
    "entities",
    r"""SELECT belief_id, round(d * 1.0 / (d + t + 1), 6) AS score FROM (SELECT belief_id, count(*) FILTER (WHERE kind IN ('file_path', 'error_code') OR kind = 'identifier' AND NOT regexp_matches(entity_lower, '^\d+$')) AS d,
    count(*) FILTER (WHERE kind IN ('version', 'branch') OR kind = 'identifier' AND regexp_matches(entity_lower, '^\d+$')) AS t FROM entities GROUP BY 1) q WHERE d + t > 0""",
)
def entity_persistence(s):
    return ledger.entity_persistence(s)


@on_store(
    "beliefs",
    f"""SELECT session_id, count(*) AS n, max(m) AS best FROM (SELECT session_id, round({MEAN}, 6) AS m FROM beliefs WHERE valid_to IS NULL ORDER BY created_at DESC, id DESC LIMIT 300) q GROUP BY 1""",
)
def newest_by_session(s):
    from ..functions.scoring import posterior_mean

    rows = s.active.orderBy(F.desc("created_at"), F.desc("id")).limit(300).select("session_id", F.round(posterior_mean(F.col("alpha"), F.col("beta")), 6).alias("m"))
    return rows.groupBy("session_id").agg(F.count("*").alias("n"), F.max("m").alias("best"))


_register_resolutions()
