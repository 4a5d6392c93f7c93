"""The belief store as DataFrames, and its projection from the test tables.

The store is a set of tables: ``beliefs`` (Beta-distributed evidence, lock, provenance), typed ``edges``, the append-only
``feedback`` log, ``turns`` of conversations and ``queries``. Times are seconds since the epoch; a row without ``valid_to`` is
active; a row whose ``lock_level`` isn't ``none`` is locked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: SQL that Spark and DuckDB read alike; {sha} is the engine's SHA-256 function of a text.
PROJECTION = {
    "beliefs": """
        SELECT 'd' || d.doc_id AS id, d.doc_id AS seq, d.text AS content, {sha} AS content_hash,
               CAST(CASE WHEN d.doc_id % 40 = 9 THEN 0.3 ELSE 1.0 + 2.0 * coalesce(l.quality, 0) + (d.doc_id % 7) * 0.5 END AS DOUBLE) AS alpha,
               CAST(CASE WHEN d.doc_id % 40 = 9 THEN 1.0 ELSE 1.0 + 2.0 * coalesce(l.toxic, 0) + (d.doc_id % 5) * 0.5 END AS DOUBLE) AS beta,
               CASE WHEN d.doc_id % 10 < 5 THEN 'factual' WHEN d.doc_id % 10 = 5 THEN 'correction'
                    WHEN d.doc_id % 10 < 8 THEN 'preference' WHEN d.doc_id % 10 = 8 THEN 'requirement' ELSE 'speculative' END AS type,
               CASE WHEN d.doc_id % 29 = 0 THEN 'user' ELSE 'none' END AS lock_level,
               CASE WHEN d.doc_id % 29 = 0 THEN 1704067200 + d.doc_id * 60 + 3600 END AS locked_at,
               CASE WHEN d.doc_id % 58 = 0 THEN 1704067200 + d.doc_id * 60 + (d.doc_id % 40) * 86400 END AS lock_expires_at,
               1704067200 + d.doc_id * 60 AS created_at,
               CASE WHEN d.doc_id % 20 = 9 THEN 'speculative' WHEN d.doc_id % 6 = 0 THEN 'user_stated' WHEN d.doc_id % 6 = 1 THEN 'user_corrected'
                    WHEN d.doc_id % 6 = 2 THEN 'user_validated' WHEN d.doc_id % 6 = 3 THEN 'user_transcript'
                    WHEN d.doc_id % 6 = 4 THEN 'unknown' ELSE 'agent_inferred' END AS origin,
               d.source AS session_id,
               CASE WHEN d.doc_id % 11 = 0 THEN 'global' WHEN d.doc_id % 11 = 1 THEN 'shared:team' WHEN d.doc_id % 11 = 2 THEN NULL ELSE 'project' END AS scope,
               CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'p' || (d.doc_id % 3) END AS project_context,
               CASE WHEN d.doc_id % 53 = 0 THEN 1704067200 + d.doc_id * 60 + 86400 END AS valid_to,
               CASE WHEN d.doc_id % 3 > 0 THEN 1704067200 + d.doc_id * 60 + (d.doc_id % 1000) * 600 END AS last_retrieved_at,
               CASE WHEN d.doc_id % 4 > 0 THEN 1704067200 + d.doc_id * 60 + (d.doc_id % 500) * 900 END AS last_confirmed_at,
               CASE d.doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'snapshot' WHEN 2 THEN 'transient' ELSE 'unknown' END AS retention_class
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "edges": """
        SELECT 'd' || d.doc_id AS src, 'd' || ((d.doc_id * (29 + 2 * k.k) + 7 * k.k) % (SELECT count(*) + 13 FROM documents)) AS dst,
               CASE (d.doc_id + k.k) % 12 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'CITES' WHEN 2 THEN 'CONTRADICTS' WHEN 3 THEN 'SUPERSEDES'
                    WHEN 4 THEN 'RELATES_TO' WHEN 5 THEN 'DERIVED_FROM' WHEN 6 THEN 'IMPLEMENTS' WHEN 7 THEN 'TESTS'
                    WHEN 8 THEN 'TEMPORAL_NEXT' WHEN 9 THEN 'RESOLVES' WHEN 10 THEN 'POTENTIALLY_STALE' ELSE 'CONTRADICTS' END AS type,
               CAST(0.3 + ((d.doc_id + k.k) % 8) * 0.1 AS DOUBLE) AS weight,
               CASE WHEN (d.doc_id + k.k) % 3 = 0 THEN substr(d.text, 1, 60) ELSE '' END AS anchor_text
        FROM documents d CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) k
        WHERE d.doc_id % 2 < k.k""",
    "feedback": """
        SELECT event_id AS feedback_id, 'd' || CASE WHEN x % 5 = 4 THEN x - 1 ELSE x END AS belief_id, event_type AS source, user_id AS session_id,
               CAST(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'error' THEN -1.0 WHEN 'signup' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS valence,
               1704067200 + event_id * 90 AS created_at
        FROM (SELECT *, event_id % (SELECT CAST(count(*) * 1.1 AS BIGINT) FROM documents) AS x FROM events) e""",
    "corroborations": """
        SELECT 'd' || (event_id % (SELECT count(*) FROM documents)) AS belief_id, 1704067200 + event_id * 45 AS ingested_at,
               CASE event_type WHEN 'purchase' THEN 'commit_ingest' WHEN 'click' THEN 'transcript_ingest' ELSE 'filesystem_ingest' END AS source_type,
               CASE WHEN user_id % 7 > 0 THEN user_id % 40 END AS session_id, CASE WHEN event_id % 3 > 0 THEN 'p' || (event_id % 9) END AS source_path_hash
        FROM events""",
    "injections": """
        SELECT event_id, user_id AS session_id, event_id // 10 AS turn_id, 'd' || (event_id % (SELECT count(*) FROM documents)) AS belief_id, 1704067200 + event_id * 90 AS injected_at,
               CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 END AS referenced, CASE WHEN event_id % 2 = 0 THEN 'l1' ELSE 'l25' END AS lane
        FROM events""",
    "log": """
        SELECT conv_id * 100 + turn AS log_id, CASE (conv_id + turn) % 4 WHEN 0 THEN 'transcript' WHEN 1 THEN 'filesystem' WHEN 2 THEN 'git' ELSE 'legacy_unknown' END AS source_kind,
               text AS raw_text, 's' || conv_id AS session_id, CASE WHEN turn > 0 THEN '{"prior":' || (conv_id * 100 + turn - 1) || '}' END AS raw_meta,
               CASE WHEN (conv_id + turn) % 3 > 0 THEN '["d' || (conv_id * 8 + turn) || '","d' || (conv_id * 8 + turn + 1) || '"]' END AS derived_ids,
               1704067200 + conv_id * 3600 + turn * 60 AS created_at
        FROM conversations""",
    "entities": """
        SELECT 'd' || doc_id AS belief_id, lower(split_part(text, ' ', k)) AS entity_lower, k AS span_start,
               CASE length(split_part(text, ' ', k)) % 6 WHEN 0 THEN 'file_path' WHEN 1 THEN 'error_code' WHEN 2 THEN 'identifier' WHEN 3 THEN 'version' WHEN 4 THEN 'branch' ELSE 'noun_phrase' END AS kind
        FROM documents CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) w
        WHERE split_part(text, ' ', k) <> ''""",
    "turns": "SELECT conv_id, turn, role, text FROM conversations",
}


class Store:
    """The tables of one store, by the names of ``PROJECTION``; each is made when it is asked for first."""

    def __init__(self, make: Callable[[str], DataFrame], folder: str = "", **given: DataFrame):
        self._make, self.folder, self._made = make, folder, dict(given)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in PROJECTION:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    @property
    def active(self) -> DataFrame:
        return self.beliefs.where("valid_to IS NULL")

    def replaced(self, **given: DataFrame) -> Store:
        """The store with other tables in place of some."""
        return Store(self._make, self.folder, **(self._made | given))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str) -> Store:
    """The store projected from the tables in a folder."""

    def make(name: str) -> DataFrame:
        sql = PROJECTION[name]
        frames = {t: table(spark, sf_dir, t) for t in ("documents", "labels", "events", "conversations") if t in sql}
        text = sql.replace("{", "{{").replace("}", "}}").replace("{{sha}}", "sha2(d.text, 256)").replace("event_id // 10", "event_id DIV 10")
        for t in frames:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
        return spark.sql(text, **frames)

    return Store(make, sf_dir)


def oracle_tables(*names: str) -> str:
    """A WITH clause that makes the named tables in DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({PROJECTION[n].replace('{sha}', 'sha256(d.text)')})" for n in names)
