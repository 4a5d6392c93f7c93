"""Reads of the store's tables, and its mutations as tables made from tables.

A mutation takes a table of what changes and returns the table after it (and the audit rows it leaves); nothing is updated in
place. Changes come as rows, so that one call makes any number of them; of several changes to one key the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_tokens
from ..sources.model import Store
from .overlap import most_shared
from .scan import Ranges

# ---- scans --------------------------------------------------------------------------------------------------------------


def for_indexing(store: Store) -> DataFrame:
    return store.active.select("id", "content")


def newest(store: Store, limit: int) -> DataFrame:
    """The active beliefs that came last."""
    return store.active.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "created_at")


def ids_newest_first(store: Store) -> DataFrame:
    """All ids, retired ones too, with their place from the newest."""
    return Ranges(store.beliefs.select("id", "seq"), [], [F.desc("seq")]).places().select("id", "place")


def anchor_texts(store: Store) -> DataFrame:
    """Anchor texts by the belief they point at; empty ones are left out."""
    return store.edges.where("anchor_text <> ''").select("dst", "anchor_text")


def lookup(store: Store, keys: DataFrame, by: str = "id", retired: bool = False) -> DataFrame:
    """The beliefs of ``keys`` by ``id`` or ``content_hash``, with how often each was sighted again."""
    rows = (store.beliefs if retired else store.active).join(keys.select(by).distinct(), by, "left_semi")
    seen = store.corroborations.groupBy(F.col("belief_id").alias("id")).agg(F.count("*").alias("times"))
    return rows.join(seen, "id", "left").select("id", "content_hash", "valid_to", F.coalesce("times", F.lit(0)).alias("times"))


def edges_of(store: Store, ids: DataFrame, side: str = "both") -> DataFrame:
    """Edges that leave (``out``), reach (``in``) or touch (``both``) the beliefs of ``ids``, each once."""
    keys = ids.select("id").distinct()
    out = store.edges.join(keys, F.col("src") == F.col("id"), "left_semi")
    into = store.edges.join(keys, F.col("dst") == F.col("id"), "left_semi")
    rows = {"out": out, "in": into, "both": out.unionByName(into)}[side]
    return rows.dropDuplicates(["src", "dst", "type"]).select("src", "dst", "type", "weight")


def edges_in_scope(store: Store, scope: str | None, side: str = "out") -> DataFrame:
    """Edges whose source (or target) is an active belief of a scope; of any without one."""
    own = store.active if scope is None else store.active.where(F.coalesce("scope", F.lit("project")) == scope)
    return store.edges.join(own.select("id"), F.col("src" if side == "out" else "dst") == F.col("id"), "left_semi").select("src", "dst", "type")


def scoped_beliefs(store: Store, ids: DataFrame, scope: str | None) -> DataFrame:
    own = store.active if scope is None else store.active.where(F.coalesce("scope", F.lit("project")) == scope)
    return own.join(ids.select("id").distinct(), "id", "left_semi").select("id", "scope")


def has_edge_type(store: Store, kinds: tuple[str, ...]) -> DataFrame:
    """For each type asked for whether an edge has it."""
    asked = store.edges.sparkSession.createDataFrame([(k,) for k in kinds], "type string")
    there = store.edges.select("type").distinct().withColumn("there", F.lit(True))
    return asked.join(there, "type", "left").select("type", F.coalesce("there", F.lit(False)).alias("there"))


def unstamped(store: Store) -> DataFrame:
    """Log rows from which nothing was derived yet."""
    return store.log.where("derived_ids IS NULL").select("log_id", "source_kind")


def derived(store: Store, besides: str = "legacy_unknown") -> DataFrame:
    """(``log_id``, ``id``) of the beliefs that log rows name, but for those of one source."""
    ids = F.explode(F.from_json("derived_ids", "array<string>"))
    return store.log.where(F.col("source_kind") != besides).where("derived_ids IS NOT NULL").select("log_id", ids.alias("id"))


def canonical_orphans(store: Store) -> DataFrame:
    """Beliefs that no log row names."""
    return store.beliefs.join(derived(store).select("id"), "id", "left_anti").select("id", "content_hash")


def reachability(store: Store) -> DataFrame:
    """How many beliefs the log accounts for."""
    named = derived(store, "").select("id").distinct().withColumn("named", F.lit(1))
    return store.beliefs.join(named, "id", "left").agg(F.count("*").alias("beliefs"), F.count("named").alias("reached"), (F.count("*") - F.count("named")).alias("orphans"))


def replay_diff(store: Store) -> DataFrame:
    """The edges that the log gives (each belief of a row DERIVED_FROM the first) beside those of the store, by how they compare."""
    ids = F.from_json("derived_ids", "array<string>")
    made = store.log.where("derived_ids IS NOT NULL").select(F.explode(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))).alias("src"), ids[0].alias("dst")).distinct().withColumn("r", F.lit(1))
    own = store.edges.where("type = 'DERIVED_FROM'").select("src", "dst").distinct().withColumn("s", F.lit(1))
    side = F.when(F.col("s").isNull(), "log_only").when(F.col("r").isNull(), "store_only").otherwise("both")
    return own.join(made, ["src", "dst"], "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def new_contradictions(now: DataFrame, before: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) that an earlier snapshot didn't have."""
    return now.join(before, ["a", "b"], "left_anti")


# ---- sinks --------------------------------------------------------------------------------------------------------------


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with the rows of ``new`` whose (src, dst, type) isn't there; of several the first by weight, largest first."""
    w = Window.partitionBy("src", "dst", "type").orderBy(F.desc("weight"))
    fresh = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return edges.select(*new.columns).unionByName(fresh)


def upsert(rows: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """``rows`` with ``changes`` in place of the rows of their keys, and new keys added; of several changes that last by ``order``."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)
    return rows.join(last.select(*key), key, "left_anti").unionByName(last.select(*rows.columns))


def corroborate(known: DataFrame, sightings: DataFrame) -> DataFrame:
    """Sightings that are new: one for each belief, session, path and kind of source; missing sessions and paths count as one value."""
    key = [F.col("belief_id"), F.coalesce(F.col("session_id").cast("string"), F.lit("")), F.coalesce("source_path_hash", F.lit("")), F.col("source_type")]

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(key)))

    names = [f"_k{i}" for i in range(4)]
    first = keyed(sightings).groupBy(*names).agg(F.min("ingested_at").alias("ingested_at"))
    fresh = first.join(keyed(known).select(*names), names, "left_anti")
    return fresh.select(F.col("_k0").alias("belief_id"), F.col("_k1").alias("session"), F.col("_k2").alias("path"), F.col("_k3").alias("source_type"), "ingested_at")


def insert_or_corroborate(store: Store, incoming: DataFrame, explicit: tuple[str, ...]) -> DataFrame:
    """What becomes of incoming texts (``content_hash``, ``source_type``, ``at``, ``new_id``): the first of a hash that the store doesn't
    have is inserted, all others corroborate; a retired belief comes back if a source the user states says it again, and else
    stays as it is. Returns ``content_hash``, ``belief_id``, ``action`` and how many rows it stands for."""
    own = store.beliefs.groupBy("content_hash").agg(F.min(F.struct(F.col("valid_to").isNotNull().alias("retired"), "id")).alias("b"))
    is_explicit = F.col("source_type").isin(*explicit)
    groups = incoming.groupBy("content_hash").agg(F.count("*").alias("n"), F.min(F.struct("at", "new_id"))["new_id"].alias("new_id"), F.bool_or(is_explicit).alias("explicit"))
    rows = groups.join(own, "content_hash", "left")
    action = F.when(F.col("b").isNull(), "inserted").when(~F.col("b.retired"), "corroborated").when(F.col("explicit"), "revived").otherwise("refused")
    again = F.when(action == "inserted", F.col("n") - 1).when(action == "refused", 0).otherwise(F.col("n"))
    return rows.select("content_hash", F.coalesce("b.id", "new_id").alias("belief_id"), action.alias("action"), again.alias("corroborations"))


def audit_rows(ids: DataFrame, source: str | Column, at: int) -> DataFrame:
    """Feedback rows without valence that record what was done to beliefs."""
    return ids.select(F.col("id").alias("belief_id"), F.lit(0.0).alias("valence"), (F.lit(source) if isinstance(source, str) else source).alias("source"), F.lit(at).cast("long").alias("created_at"))


# What a log row may come from.
SOURCE_KINDS = ("filesystem", "git", "python_ast", "mcp_remember", "cli_remember", "transcript", "feedback_loop_synthesis", "claude_memory", "legacy_unknown")


def log_rows(rows: DataFrame) -> DataFrame:
    """Raw texts (``source_kind``, ``source_path``, ``raw_text``, ``raw_meta`` as a map or struct, ``derived_ids`` as an array, ``session_id``, ``created_at``) as rows of the log. An id is a digest of
    what the row says, so that a row that is written again is the same row. Kinds that the log doesn't know are an error."""
    unknown = rows.where(F.col("source_kind").isNull() | ~F.col("source_kind").isin(*SOURCE_KINDS)).select("source_kind").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown source kind: {unknown[0].source_kind!r}")
    said = F.concat_ws("\0", "source_kind", F.coalesce("source_path", F.lit("")), "raw_text", F.coalesce("session_id", F.lit("")), F.col("created_at").cast("string"))
    return rows.select(
        F.substring(F.sha2(said, 256), 1, 26).alias("log_id"), "source_kind", "source_path", "raw_text", "session_id", F.to_json("raw_meta").alias("raw_meta"), F.to_json("derived_ids").alias("derived_ids"), "created_at"
    )


def append_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """``log`` with the rows of ``rows`` (as ``log_rows`` makes them) whose ids it doesn't have, each once."""
    fresh = rows.dropDuplicates(["log_id"]).join(log.select("log_id"), "log_id", "left_anti")
    return log.unionByName(fresh.select(*log.columns))


# ---- mutations ------------------------------------------------------------------------------------------------------------


def _where_in(beliefs: DataFrame, ids: DataFrame) -> DataFrame:
    return beliefs.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def soft_delete(beliefs: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Active beliefs of ``ids`` retired at a time; retired ones keep theirs."""
    return _where_in(beliefs, ids).withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), F.lit(at).cast("long")).otherwise(F.col("valid_to"))).drop("_hit")


def restore(beliefs: DataFrame, ids: DataFrame) -> DataFrame:
    return _where_in(beliefs, ids).withColumn("valid_to", F.when(~F.col("_hit"), F.col("valid_to"))).drop("_hit")


def hard_delete(store: Store, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Beliefs, edges and entities without those of ``ids``; edges go at either end."""
    keys = ids.select("id").distinct()
    edges = store.edges.join(keys, F.col("src") == F.col("id"), "left_anti").join(keys, F.col("dst") == F.col("id"), "left_anti")
    return store.beliefs.join(keys, "id", "left_anti"), edges, store.entities.join(keys, F.col("belief_id") == F.col("id"), "left_anti")


def delete_edges(edges: DataFrame, kind: str, weight: float | None = None) -> DataFrame:
    """Edges without those of a type (and a weight)."""
    gone = F.col("type") == kind
    return edges.where(~(gone if weight is None else gone & (F.col("weight") == weight)))


def without_orphan_feedback(store: Store) -> DataFrame:
    return store.feedback.join(store.beliefs.select(F.col("id").alias("belief_id")), "belief_id", "left_semi")


def set_retention(beliefs: DataFrame, ids: DataFrame, retention: str) -> DataFrame:
    return _where_in(beliefs, ids).withColumn("retention_class", F.when(F.col("_hit"), retention).otherwise(F.col("retention_class"))).drop("_hit")


def stamp_retrieved(beliefs: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    return _where_in(beliefs, ids).withColumn("last_retrieved_at", F.when(F.col("_hit"), F.lit(at).cast("long")).otherwise(F.col("last_retrieved_at"))).drop("_hit")


def promotions(store: Store, ids: DataFrame) -> DataFrame:
    """What validation by the user does to active beliefs: ``promoted``, ``already`` validated, or ``refused`` (locked or stated)."""
    rows = store.active.join(ids.select("id").distinct(), "id", "left_semi")
    outcome = F.when((F.col("lock_level") == "user") | (F.col("origin") == "user_stated"), "refused").when(F.col("origin") == "user_validated", "already").otherwise("promoted")
    return rows.select("id", outcome.alias("outcome"), F.when(outcome == "promoted", "user_validated").otherwise(F.col("origin")).alias("origin"))


def devalidations(store: Store, ids: DataFrame) -> DataFrame:
    """The reverse: unlocked validated beliefs become inferred, all others are refused."""
    rows = store.active.join(ids.select("id").distinct(), "id", "left_semi")
    ok = (F.col("lock_level") != "user") & (F.col("origin") == "user_validated")
    return rows.select("id", F.when(ok, "devalidated").otherwise("refused").alias("outcome"), F.when(ok, "agent_inferred").otherwise(F.col("origin")).alias("origin"))


def unlocks(store: Store, ids: DataFrame) -> DataFrame:
    rows = store.active.join(ids.select("id").distinct(), "id", "left_semi")
    locked = F.col("lock_level") == "user"
    return rows.select("id", F.when(locked, "unlocked").otherwise("already").alias("outcome"), F.when(locked, "none").otherwise(F.col("lock_level")).alias("lock_level"), F.when(~locked, F.col("locked_at")).alias("locked_at"))


def resolutions(store: Store, winners: DataFrame) -> DataFrame:
    """SUPERSEDES edges from winners to losers that aren't there yet."""
    there = store.edges.where("type = 'SUPERSEDES'").select(F.col("src").alias("winner"), F.col("dst").alias("loser"))
    made = winners.join(there, ["winner", "loser"], "left_anti")
    return made.select(F.col("winner").alias("src"), F.col("loser").alias("dst"), F.lit("SUPERSEDES").alias("type"), F.lit(1.0).alias("weight"))


def link_documents(known: DataFrame, links: DataFrame) -> DataFrame:
    """Links of beliefs to documents; of several for one belief and document the one that came first stays."""
    first = links.groupBy("belief_id", "doc_uri").agg(F.min(F.struct("created_at", "anchor_type")).alias("a"))
    fresh = first.join(known.select("belief_id", "doc_uri"), ["belief_id", "doc_uri"], "left_anti")
    return fresh.select("belief_id", "doc_uri", "a.anchor_type", "a.created_at")


def doc_anchors(store: Store, links: DataFrame) -> DataFrame:
    """For each active belief its documents in order of their link."""
    rows = links.join(store.active.select(F.col("id").alias("belief_id")), "belief_id", "left_semi")
    return rows.groupBy("belief_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "doc_uri"))), lambda x: x["doc_uri"]), " ").alias("docs"))


def category_members(store: Store, bridge: DataFrame) -> DataFrame:
    """Active beliefs of each category (``category``, ``belief_id``)."""
    return bridge.join(store.active.select(F.col("id").alias("belief_id")), "belief_id", "left_semi").select("category", "belief_id")


def review_apply(store: Store, decisions: DataFrame, at: int) -> DataFrame:
    """What review decisions (``id``, ``verdict``: keep, remove, lock, skip) do to active beliefs."""
    rows = store.active.join(decisions, "id")
    verdict = F.col("verdict")
    outcome = F.when(verdict == "skip", "skipped").when((verdict == "remove") & (F.col("lock_level") == "user"), "refused").when(verdict == "remove", "removed").when(verdict == "lock", "locked").otherwise("kept")
    stamp = F.lit(at).cast("long")
    return rows.select(
        "id",
        outcome.alias("outcome"),
        F.when(outcome == "removed", stamp).alias("valid_to"),
        F.when(outcome == "locked", "user").otherwise(F.col("lock_level")).alias("lock_level"),
        F.when(outcome.isin("kept", "locked"), stamp).otherwise(F.col("last_confirmed_at")).alias("last_confirmed_at"),
    )


def migrate(store: Store, target: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Beliefs of a project that a target doesn't have, and the edges between beliefs that are there afterwards."""
    own = store.beliefs.where(F.col("project_context") == project).join(target.select("id"), "id", "left_anti")
    ids = own.select("id").unionByName(target.select("id"))
    edges = store.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return own, edges.join(own.select("id"), (F.col("src") == F.col("id")) | (F.col("dst") == F.col("id")), "left_semi")


# ---- summaries ------------------------------------------------------------------------------------------------------------


def count_by_state(store: Store) -> DataFrame:
    return store.beliefs.agg(F.count("*").alias("all_rows"), F.count_if(F.col("valid_to").isNull()).alias("active"), F.count_if(F.col("lock_level") != "none").alias("locked"))


def corroboration_counts(store: Store) -> DataFrame:
    return store.corroborations.groupBy("belief_id").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


def promotable_snapshots(store: Store, kind: str = "snapshot", times: int = 3, sessions: int = 2) -> DataFrame:
    """Snapshots (or phantoms) sighted often enough, from several sessions, that nothing contradicts."""
    seen = corroboration_counts(store).where((F.col("n") >= times) & (F.col("sessions") >= sessions))
    rows = store.beliefs.where("retention_class = 'snapshot' AND origin <> 'speculative'") if kind == "snapshot" else store.active.where("type = 'speculative' AND origin = 'speculative'")
    against = store.edges.where("type = 'CONTRADICTS'").select(F.col("dst").alias("id"))
    return rows.join(seen, F.col("id") == F.col("belief_id")).join(against, "id", "left_anti").select("id", "n", "sessions")


def touch_sessions(store: Store) -> DataFrame:
    """Sessions with how many beliefs they touched and their last event."""
    return store.feedback.groupBy("session_id").agg(F.countDistinct("belief_id").alias("beliefs"), F.max("feedback_id").alias("last"))


def queue_by_status(store: Store, now: int, grace: int) -> DataFrame:
    """Exposures by what became of them: answered, due (grace over) or waiting."""
    status = F.when(F.col("referenced").isNotNull(), "answered").when(F.col("injected_at") <= now - grace, "due").otherwise("waiting")
    return store.injections.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def pending_exposures(store: Store, before_turn: int) -> DataFrame:
    """Exposures of earlier turns without an answer."""
    return store.injections.where("referenced IS NULL").where(F.col("turn_id") < before_turn).select("event_id", "session_id", "turn_id", "belief_id")


def stamp_referenced(store: Store, answers: DataFrame) -> DataFrame:
    """Exposures with their answers (``event_id``, ``said``, ``at``): the first answer counts, and only where there is none yet."""
    first = answers.groupBy("event_id").agg(F.min(F.struct("at", "said"))["said"].alias("said"))
    return store.injections.join(first, "event_id", "left").select("event_id", F.coalesce("referenced", "said").alias("referenced"))


def snapshot(store: Store) -> DataFrame:
    """Beliefs, those superseded and locked, churn, and beliefs without any edge."""
    ends = store.edges.select(F.col("src").alias("id")).unionByName(store.edges.select(F.col("dst").alias("id")))
    alone = store.beliefs.join(ends, "id", "left_anti").agg(F.count("*").alias("orphans"))
    gone = store.edges.where("type = 'SUPERSEDES'").agg(F.countDistinct("dst").alias("superseded"))
    rows = store.beliefs.agg(F.count("*").alias("n"), F.count_if(F.col("lock_level") != "none").alias("locked"))
    out = rows.crossJoin(F.broadcast(gone)).crossJoin(F.broadcast(alone))
    return out.select(F.greatest(F.lit(0), F.col("n") - F.col("superseded")).alias("active"), "superseded", "locked", F.round(F.col("superseded") / F.col("n"), 4).alias("churn"), "orphans")


def graph_snapshot(store: Store) -> DataFrame:
    """Edges by type with their share of edges a belief."""
    n = store.beliefs.agg(F.count("*").alias("n"))
    return store.edges.groupBy("type").agg(F.count("*").alias("edges")).crossJoin(F.broadcast(n)).select("type", "edges", F.round(F.col("edges") / F.col("n"), 4).alias("per_belief"))


def session_delta(store: Store) -> DataFrame:
    """By session: beliefs made, corrections, hours from first to last and beliefs an hour."""
    g = store.beliefs.groupBy("session_id").agg(F.count("*").alias("made"), F.count_if(F.col("type") == "correction").alias("corrections"), (F.max("created_at") - F.min("created_at")).alias("seconds"))
    return g.select("session_id", "made", "corrections", "seconds", F.round(F.when(F.col("seconds") > 0, F.col("made") / (F.col("seconds") / 3600.0)).otherwise(0.0), 4).alias("per_hour"))


def ghost_alphas(store: Store, threshold: float, target: float, exempt: tuple[str, ...]) -> DataFrame:
    """Unlocked beliefs with more evidence than ``threshold`` that neither feedback nor a sighting explains, and what they are set to."""
    rows = store.active.where("lock_level = 'none'").where((F.col("alpha") > threshold) & ~F.col("origin").isin(*exempt))
    rows = rows.join(store.feedback.select(F.col("belief_id").alias("id")), "id", "left_anti").join(store.corroborations.select(F.col("belief_id").alias("id")), "id", "left_anti")
    return rows.select("id", "alpha", F.lit(target).alias("clamped"))


def auditor(store: Store, latest_turn: int, least: int = 50, budget: int = 2400) -> DataFrame:
    """Checks of a store, each with a count and how grave it is."""
    ids = store.beliefs.select("id")
    orphans = store.edges.join(ids, F.col("src") == F.col("id"), "left_anti").unionByName(store.edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_anti"))
    locked = store.active.where("lock_level <> 'none'")
    pairs = store.edges.where("type = 'CONTRADICTS'").join(locked.select(F.col("id").alias("src")), "src", "left_semi").join(locked.select(F.col("id").alias("dst")), "dst", "left_semi")
    pairs = pairs.select(F.least("src", "dst"), F.greatest("src", "dst")).distinct()
    volume = store.beliefs.agg(F.count("*").alias("n"))
    tokens = locked.agg(F.coalesce(F.sum(F.ceil(F.length("content") / 4)), F.lit(0)).alias("n"))
    said = store.active.where("origin IN ('agent_inferred', 'user_transcript')").agg(F.floor((F.lit(latest_turn) - F.max("created_at")) / 86400).alias("n"))

    def finding(name: str, rows: DataFrame, grave: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("finding"), F.col("n").cast("long").alias("n"), grave.alias("severity"))

    n = F.col("n")
    out = finding("orphan_edges", orphans.agg(F.count("*").alias("n")), F.when(n > 0, "fail").otherwise("info"))
    out = out.unionByName(finding("locked_contradictions", pairs.agg(F.count("*").alias("n")), F.when(n > 0, "fail").otherwise("info")))
    out = out.unionByName(finding("corpus_volume", volume, F.when(n < least, "warn").otherwise("info")))
    out = out.unionByName(finding("lock_budget", tokens, F.when(n > budget, "warn").otherwise("info")))
    return out.unionByName(finding("ingest_gap", said, F.when(n > 0, "warn").otherwise("info")))


def introspection(store: Store, limit: int) -> DataFrame:
    """The newest active beliefs, grouped by session: how many, how many are noise, and the newest of each."""
    from ..functions.text import noise_kind

    newest_rows = store.active.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    marked = newest_rows.select("session_id", "id", "created_at", noise_kind(F.col("content")).isNotNull().alias("noise"))
    return marked.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("noise")).alias("noise"), F.max(F.struct("created_at", "id"))["id"].alias("newest"))


def entity_overlap(store: Store, wanted: DataFrame, limit: int, fan: bool = False) -> DataFrame:
    """For each query (``query_id``, ``entity_lower``) the active beliefs that share entities, most first; with ``fan`` an entity
    counts ln(N + 1) - ln(fan + 1), so that those of many beliefs count less. Ties by id."""
    rows = store.entities.join(store.active.select(F.col("id").alias("belief_id")), "belief_id", "left_semi").select("belief_id", "entity_lower").distinct()
    weight = F.log(F.lit(store.active.count() + 1.0)) - F.log(F.col("fan") + 1.0) if fan else None
    return most_shared(wanted.select("query_id", "entity_lower").distinct(), rows, limit, weight)


def novel_entities(store: Store, wanted: DataFrame) -> DataFrame:
    """Entities of queries that no belief has."""
    return wanted.select("query_id", "entity_lower").distinct().join(store.entities.select("entity_lower"), "entity_lower", "left_anti")


def entity_persistence(store: Store) -> DataFrame:
    """Durable entities / (durable + transient + 1) of each belief that has any of either."""
    bare = F.col("entity_lower").rlike(r"^\d+$")
    durable = F.col("kind").isin("file_path", "error_code") | ((F.col("kind") == "identifier") & ~bare)
    transient = F.col("kind").isin("version", "branch") | ((F.col("kind") == "identifier") & bare)
    g = store.entities.groupBy("belief_id").agg(F.count_if(durable).alias("d"), F.count_if(transient).alias("t")).where("d + t > 0")
    return g.select("belief_id", F.round(F.col("d") / (F.col("d") + F.col("t") + 1), 6).alias("score"))


def phantom_lock_matches(store: Store, locks: DataFrame, least: float) -> DataFrame:
    """Phantoms whose text is that of a lock (``lock_id``, ``text``), or whose tokens are as similar as ``least``."""
    from .similarity import similar_to

    phantoms = store.active.where("type = 'speculative' AND origin = 'speculative'").select("id", "content", "content_hash")
    same = phantoms.join(locks.select("lock_id", F.sha2("text", 256).alias("content_hash")), "content_hash").select("lock_id", "id")
    near = similar_to(locks.select("lock_id", title_tokens(F.col("text")).alias("t")), phantoms.select("id", title_tokens(F.col("content")).alias("t")), "lock_id", "id", least).select("lock_id", "id")
    return same.unionByName(near).distinct()
