"""Queries of conflicts with locks, query strategies, overlap, opportunities, rings, histories and peers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import locks, policy, retrieval
from ..plans.session import new_folder
from ..sources import history, peers
from ..streaming import feedback as streams
from ..streaming import opportunities
from ..streaming import ring as rings
from .catalog import INDEX, MANY_SQL, index_of, turn_queries
from .catalog_text import NUMBERS, _enum_sql
from .registry import ASKED_SQL, BASE, MEAN, asked, on_store

# ---- conflicts ------------------------------------------------------------------------------------------------------------

WORDS = ("synchronous", "async mode", "sync and strict", "read-only", "full-scan", "enabled", "default-off", "lax, private", "version 3", "indexed", "optional", "partial, stochastic")
SAYS = "content || ' limit = ' || (seq % 23) * 10 || ', retries: ' || (seq % 7) || ' year 2024 v 3.' || (seq % 4) || CASE WHEN seq % 9 = 0 THEN ' limit = 5 ' ELSE ' ' END || CASE seq % 12 " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(WORDS)) + " END"
DROPPED = ", ".join(f"'{k}'" for k in locks.VERSION_KEYS)


@on_store(
    "beliefs",
    f""", both_ AS (SELECT id, {SAYS} AS text, lock_level <> 'none' AS locked, seq FROM beliefs WHERE valid_to IS NULL),
    x AS (SELECT DISTINCT id, key, value FROM {NUMBERS} n), y AS (SELECT * FROM x WHERE (id, key) IN (SELECT id, key FROM x GROUP BY 1, 2 HAVING count(*) = 1) AND key NOT IN ({DROPPED}) AND NOT (value = floor(value) AND value BETWEEN 1900 AND 2100)),
    e AS (SELECT id, split_part(s, ' ', 1) AS category, list(substr(s, strpos(s, ' ') + 1)) AS groups FROM (SELECT id, unnest(list_distinct(list_filter([{_enum_sql()}], lambda x: x IS NOT NULL))) AS s FROM both_) q GROUP BY 1, 2),
    c AS (SELECT a.id, b.id AS lock_id FROM y a JOIN y b ON a.key = b.key AND abs(a.value - b.value) > 0.01 * greatest(abs(a.value), abs(b.value)) UNION SELECT a.id, b.id FROM e a JOIN e b ON a.category = b.category AND NOT list_has_any(a.groups, b.groups))
    SELECT c.id, arg_min(lock_id, k.seq) AS lock_id FROM c JOIN both_ k ON k.id = lock_id AND k.locked JOIN both_ o ON o.id = c.id AND NOT o.locked GROUP BY 1""",
)
def lock_conflicts(s):
    """The first lock that each belief contradicts in a number or a word of state, some of both put behind its text."""
    rows = s.active.select("id", F.expr(SAYS).alias("text"), "lock_level", F.col("seq").alias("rank"))
    return locks.conflicting_locks(rows.where("lock_level = 'none'"), rows.where("lock_level <> 'none'").withColumnRenamed("id", "lock_id"))


# ---- query strategies -----------------------------------------------------------------------------------------------------


STRATEGY = """, i AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, n), b AS (SELECT quantile_cont(idf, 0.001) AS low, quantile_cont(idf, 0.01) AS high FROM i),
    own AS (SELECT query_id, query, list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS t, list_filter(regexp_split_to_array(query, '[^\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')) AS w FROM a),
    x AS (SELECT query_id, list_concat(t, flatten([[lower(c), lower(c)] FOR c IN w])) AS t FROM own), p AS (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS k FROM x),
    r AS (SELECT query_id, k, CASE WHEN idf > high THEN term || ' ' || term ELSE term END AS said FROM p LEFT JOIN i USING (term), b WHERE idf IS NULL OR idf >= low)
    SELECT query_id, coalesce((SELECT string_agg(said, ' ' ORDER BY k) FROM r WHERE r.query_id = own.query_id), '') AS query FROM own"""


@on_store("beliefs turns", INDEX + MANY_SQL + STRATEGY)
def query_strategy(s):
    """Turns as queries rewritten by the strategy that expands and clips."""
    return retrieval.rewritten(index_of(s), turn_queries(s), "stack-r1-r3", 0.001, 0.01)


@on_store("beliefs turns", INDEX + MANY_SQL + " SELECT query_id, CASE WHEN trim(query, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN '' ELSE query END AS query FROM a")
def plain_strategy(s):
    """Turns as queries by the strategy that leaves them as they are."""
    return retrieval.rewritten(index_of(s), turn_queries(s), "legacy-bm25")


# ---- overlap and temperature ------------------------------------------------------------------------------------------------

OVERLAP = "list_distinct(list_filter(regexp_split_to_array(lower(translate(content, ',.;:!?\"''()[]{{}}', '              ')), '\\s+'), lambda x: x <> ''))"


@on_store(
    "beliefs edges",
    f""", t AS (SELECT id, {OVERLAP.replace('{{}}', '{}')} AS t FROM beliefs), n AS (SELECT DISTINCT src, dst FROM edges)
    SELECT src AS id, count(*) AS neighbours, round(avg(CASE WHEN len(x.t) = 0 OR len(y.t) = 0 THEN 0 ELSE len(list_intersect(x.t, y.t)) * 1.0 / len(list_distinct(list_concat(x.t, y.t))) END), 6) AS score
    FROM n JOIN t x ON x.id = src JOIN t y ON y.id = dst GROUP BY 1""",
)
def neighbour_overlap(s):
    """How much of its words each belief shares with those that its edges reach, on average."""
    pairs = s.edges.select("src", "dst").distinct().join(s.beliefs.select(F.col("id").alias("src"), F.col("content").alias("own")), "src").join(s.beliefs.select(F.col("id").alias("dst"), F.col("content").alias("other")), "dst")
    return texts.overlap_scores(pairs, "src", "own", "other").select(F.col("src").alias("id"), "neighbours", F.round("score", 6).alias("score"))


@on_store("beliefs", f"SELECT id, round(CASE WHEN seq % 10 = 3 THEN 1.0 ELSE exp(ln(0.5) + least(1.0, greatest(0.0, {MEAN} * 1.4 - 0.2)) * (ln(2.0) - ln(0.5))) END, 6) AS temperature FROM beliefs")
def posterior_temperatures(s):
    """The temperature that each belief's mean, stretched beyond 0 and 1, stands for as a tuning knob; every tenth knob isn't installed."""
    from ..functions import scoring

    value = F.when(F.col("seq") % 10 != 3, scoring.posterior_mean(F.col("alpha"), F.col("beta")) * 1.4 - 0.2)
    return s.beliefs.select("id", F.round(policy.temperature(value), 6).alias("temperature"))


# ---- opportunities ----------------------------------------------------------------------------------------------------------

REASON = "CASE source WHEN 'error' THEN 'gap' WHEN 'signup' THEN 'new_entity' WHEN 'purchase' THEN 'contradiction' END"


@on_store(
    "feedback",
    f""", r AS (SELECT session_id, feedback_id, created_at AS t, {REASON} AS reason, CAST(feedback_id % 4 AS VARCHAR) AS topic FROM feedback),
    e AS (SELECT *, CASE WHEN t - lag(t) OVER w > 9000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS began FROM r WINDOW w AS (PARTITION BY session_id ORDER BY feedback_id)),
    n AS (SELECT *, sum(began) OVER (PARTITION BY session_id ORDER BY feedback_id) AS epoch FROM e),
    f AS (SELECT * FROM n WHERE reason IS NOT NULL AND NOT (reason = 'contradiction' AND began = 1) QUALIFY row_number() OVER (PARTITION BY session_id, epoch, reason, topic ORDER BY feedback_id) = 1)
    SELECT session_id, feedback_id, reason, topic FROM f QUALIFY row_number() OVER (PARTITION BY session_id, epoch ORDER BY feedback_id) <= 3""",
)
def stream_opportunities(s):
    """Errors as gaps, signups as new entities and purchases as contradictions, three at most for each spell of a session."""
    log = streams.read(s.feedback.sparkSession, s.folder)
    rows = opportunities.candidates(log, F.expr(REASON), (F.col("feedback_id") % 4).cast("string"))
    return opportunities.run_available(opportunities.opportunities(rows, 9000, 7200), "opportunities")


# ---- rings --------------------------------------------------------------------------------------------------------------------

RECORD = "ts long, key long, n long, session string, hook string"


def _audit_files(s):
    """The feedback as an audit log of JSON lines in a folder, some lines blank or broken."""
    folder = new_folder(s.feedback.sparkSession, "audit")
    n = F.col("feedback_id")
    record = F.to_json(F.struct(F.col("created_at").alias("ts"), F.col("session_id").alias("key"), n.alias("n"), F.floor(F.col("created_at") / 30000).cast("string").alias("session"), F.col("source").alias("hook")))
    line = F.when(n % 17 == 0, F.substring(record, F.lit(1), F.length(record) - 1)).when(n % 19 == 0, "").when(n % 23 == 0, "[1]").otherwise(record)
    s.feedback.select(line.alias("value")).write.text(folder)
    return folder


BASE_AUDIT = ", r AS (SELECT session_id AS key, feedback_id AS n, CAST(created_at // 30000 AS VARCHAR) AS session FROM feedback WHERE feedback_id % 17 > 0 AND feedback_id % 19 > 0 AND feedback_id % 23 > 0 AND created_at >= {since} {more})"


@on_store(
    "feedback",
    BASE_AUDIT.format(since=BASE + 100_000, more="")
    + """, e AS (SELECT *, CASE WHEN session IS DISTINCT FROM lag(session) OVER (PARTITION BY key ORDER BY n) THEN 1 ELSE 0 END AS fresh FROM r), g AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY n) AS spell FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY key, spell ORDER BY n) AS place FROM g) SELECT key, n, session, place - 1 AS fire_idx, least(place, 4) AS held, greatest(place - 4, 0) AS evicted FROM k""",
)
def stream_rings(s):
    """The ring of each key as an audit log is followed from some time on."""
    log = rings.followed(s.feedback.sparkSession, _audit_files(s), RECORD, BASE + 100_000)
    return streams.run_available(rings.rings(log, F.col("key"), F.col("session"), F.col("n"), 4), "rings")


@on_store("feedback", BASE_AUDIT.format(since=BASE, more="AND source = 'click'") + " SELECT * FROM r")
def stream_audit_tail(s):
    """The records of one kind, as an audit log is followed."""
    log = rings.followed(s.feedback.sparkSession, _audit_files(s), RECORD, BASE, {"hook": "click"})
    return streams.run_available(log.select("key", "n", "session"), "tail")


# ---- history ------------------------------------------------------------------------------------------------------------------

COMMITS = """, c AS (SELECT md5('commit ' || feedback_id) AS sha, created_at AS t, CASE WHEN feedback_id % 13 = 0 THEN '' ELSE source || ' ' || belief_id || ' #' || feedback_id % 50 END AS subject,
    CASE WHEN feedback_id % 11 = 0 THEN [] ELSE ['src/f' || feedback_id % 97 || '.py', 'docs/d' || feedback_id % 31 || '.md'] END AS files FROM feedback)"""


def _history(s):
    """The feedback as an exported log of commits, in as many files as it has partitions."""
    folder = new_folder(s.feedback.sparkSession, "history")
    n = F.col("feedback_id")
    at = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    subject = F.when(n % 13 == 0, "").otherwise(F.concat("source", F.lit(" "), "belief_id", F.lit(" #"), (n % 50).cast("string")))
    files = F.when(n % 11 == 0, "").otherwise(F.concat(F.lit("\n\nsrc/f"), (n % 97).cast("string"), F.lit(".py\ndocs/d"), (n % 31).cast("string"), F.lit(".md\n")))
    rows = s.feedback.select(F.concat(F.md5(F.concat(F.lit("commit "), n.cast("string"))), F.lit("\t"), at, F.lit("\t"), subject, files).alias("value"))
    rows.repartition(3).write.option("lineSep", history.SEPARATOR).text(folder)
    return history.commits(s.feedback.sparkSession, folder)


@on_store("feedback", COMMITS + " SELECT subject AS text, 'git:commit:' || substr(sha, 1, 7) AS source, t AS at FROM c WHERE subject <> ''")
def commit_subjects(s):
    """Every commit of an exported history as a candidate."""
    return history.commit_candidates(_history(s)).select("text", "source", F.unix_timestamp("at").alias("at"))


@on_store("feedback", COMMITS + " SELECT path, max(t) AS at FROM (SELECT unnest(files) AS path, t FROM c) q GROUP BY 1")
def file_recency(s):
    return history.file_recency(_history(s)).select("path", F.unix_timestamp("at").alias("at"))


@on_store(
    "feedback beliefs",
    COMMITS
    + """, r AS (SELECT path, max(t) AS t FROM (SELECT unnest(files) AS path, t FROM c) q GROUP BY 1), d AS (SELECT 'docs/d' || seq || '.md' AS path, list_filter([trim(p) FOR p IN string_split(replace(content, chr(10), chr(10) || chr(10)), chr(10) || chr(10))], lambda p: length(p) >= 24) AS ps FROM beliefs),
    p AS (SELECT path, unnest(ps) AS text, unnest(range(len(ps))) AS n FROM d), x AS (SELECT text, 'doc:' || path || ':p' || n AS source, t FROM p LEFT JOIN r USING (path) UNION ALL SELECT subject, 'git:commit:' || substr(sha, 1, 7), t FROM c WHERE subject <> '')
    SELECT sha256(text) AS content_hash, min(source) AS source, list(t ORDER BY source)[1] AS at, count(*) AS seen FROM x WHERE length(text) % 5 > 0 AND sha256(text) NOT IN (SELECT content_hash FROM beliefs) GROUP BY 1""",
)
def repository_scan(s):
    """What a scan of commits and documents adds to the store; some texts aren't to be kept."""
    log = _history(s)
    texts = s.beliefs.select(F.concat(F.lit("docs/d"), "seq", F.lit(".md")).alias("path"), F.replace("content", F.lit("\n"), F.lit("\n\n")).alias("text"))
    found = history.paragraph_candidates(texts, history.file_recency(log)).unionByName(history.commit_candidates(log))
    rows = history.scanned(found, s.beliefs, F.length("text") % 5 > 0)
    return rows.select("content_hash", "source", F.unix_timestamp("at").alias("at"), "seen")


# ---- peers --------------------------------------------------------------------------------------------------------------------


@on_store(
    "beliefs",
    """, b AS (SELECT *, 'p' || seq % 3 AS owner FROM beliefs WHERE valid_to IS NULL), w AS (SELECT owner, id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS term FROM b),
    tf AS (SELECT owner, id, term, count(*) AS tf FROM w GROUP BY 1, 2, 3), dl AS (SELECT owner, id, count(*) AS dl FROM w GROUP BY 1, 2), df AS (SELECT owner, term, count(*) AS df FROM tf GROUP BY 1, 2),
    n AS (SELECT b.owner, count(*) AS n, coalesce(sum(dl), 0) * 1.0 / count(*) AS avgdl FROM b LEFT JOIN dl USING (owner, id) GROUP BY 1), q AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}_]+')) AS term FROM """
    + ASKED_SQL
    + """),
    m AS (SELECT query_id, owner, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (owner, term) JOIN dl USING (owner, id) JOIN n USING (owner) GROUP BY 1, 2, 3)
    SELECT query_id, owner, id, scope, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner, id) AS place FROM m JOIN b USING (owner, id) WHERE score > 0 AND (scope = 'global' OR scope LIKE 'shared:%')
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, owner, id) <= 10""",
)
def peer_search(s):
    """The store dealt to three peers that a configuration names, and searched through it."""
    spark = s.beliefs.sparkSession
    folder = new_folder(spark, "peers")
    names = ("p0", "p1", "p2")
    for n, name in enumerate(names):
        s.beliefs.where(F.col("seq") % 3 == n).write.parquet(f"{folder}/{name}/beliefs")
    config = json.dumps({"version": peers.VERSION, "deps": [{"name": x, "path": x} for x in names]})
    spark.createDataFrame([(config,)], "value string").coalesce(1).write.text(f"{folder}/config")
    stores = {p.name: peers.open_peer(spark, p) for p in peers.load_peers(spark, f"{folder}/config")}
    return retrieval.search_peers(stores, asked(s), 10)
