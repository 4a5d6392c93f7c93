"""Queries of sources, derivation, ledgers and exports, with their SQL where it can be written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, scoring
from ..functions import text as texts
from ..operators import ingest, ledger, ordered, relational, reports, retrieval
from ..sources import files
from ..sources.model import Store, table
from ..streaming import worker
from .catalog_text import HEDGED, KIND, QUESTION, _sayings
from .registry import MEAN, on_store, on_tables

# ---- sources ------------------------------------------------------------------------------------------------------------


FENCED = "CASE WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || text ELSE text END"


@on_tables(
    f"SELECT doc_id, list_position(ps, p) - 1 AS n, p AS paragraph FROM (SELECT doc_id, ps, unnest(list_distinct(ps)) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({FENCED}, '{files.FENCE}', ' ', 'g'), chr(10) || chr(10)), lambda p: trim(p)), lambda p: length(p) >= 24) AS ps FROM documents) a) b"
)
def document_paragraphs(spark, sf_dir):
    """The paragraphs of documents, each at its first place; every fifth document has its text again as fenced code."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(FENCED.replace("chr(10)", "char(10)")).alias("text"))
    rows = rows.select("doc_id", F.posexplode(files.paragraphs(F.col("text"))).alias("n", "paragraph"))
    return rows.groupBy("doc_id", "paragraph").agg(F.min("n").cast("long").alias("n"))


@on_store("turns", "SELECT CASE WHEN turn % 2 = 0 THEN role WHEN role = 'system' THEN NULL ELSE role END AS role, text, 's' || conv_id AS session_id, CASE WHEN turn % 3 > 0 THEN 't' || turn END AS ts FROM turns WHERE turn % 2 = 0 OR role <> 'system'")
def jsonl_turns(s):
    """Turns written as JSON lines of two shapes and read again; the second shape has no system turns."""
    ts = F.when(F.col("turn") % 3 > 0, F.concat(F.lit("t"), "turn"))
    session = F.concat(F.lit("s"), "conv_id")
    plain = F.to_json(F.struct("role", "text", session.alias("session_id"), ts.alias("ts")))
    parts = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message"), session.alias("sessionId"), ts.alias("timestamp")))
    lines = s.turns.select(F.when(F.col("turn") % 2 == 0, plain).otherwise(parts).alias("line"))
    lines = lines.unionByName(s.turns.sparkSession.createDataFrame([("not json",), ('{"role": "user"}',), ('{"type": "other", "message": {"content": "x"}}',)], "line string"))
    return files.normalised_turns(lines).drop("line")


@on_tables("SELECT 'page ' || page_id AS label, url AS target, CASE WHEN page_id % 2 = 0 THEN 'note ' || page_id ELSE '' END AS note FROM pages")
def memory_bullets(spark, sf_dir):
    """Bullets of one text for each page, parsed again."""
    p = table(spark, sf_dir, "pages")
    note = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" — note "), "page_id")).otherwise("")
    made = p.select(F.concat(F.lit("# Index\n- [page "), "page_id", F.lit("]("), "url", F.lit(")"), note, F.lit("\nno bullet")).alias("text"))
    return made.select(F.explode(files.bullets(F.col("text"))).alias("b")).select("b.*")


@on_store("beliefs", "SELECT id AS name, 'd: ' || type AS description, CASE WHEN seq % 3 = 0 THEN 'project' ELSE '' END AS type, trim(content) AS body FROM beliefs WHERE trim(content) <> ''")
def memory_files(s):
    """Beliefs as memory files with a front matter, parsed again."""
    kind = F.when(F.col("seq") % 3 == 0, "  type: project\n").otherwise("  type: unknown\n")
    made = s.beliefs.select(F.concat(F.lit("---\nname: '"), "id", F.lit("'\ndescription: \"d: "), "type", F.lit('"\nmetadata:\n'), kind, F.lit("---\n"), "content").alias("t"))
    return made.select(files.memory_file(F.col("t")).alias("m")).where("m IS NOT NULL").select("m.*")


@on_store("beliefs", "SELECT id, CASE seq % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'remove' WHEN 2 THEN 'lock' WHEN 3 THEN 'skip' ELSE 'ambiguous' END AS verdict FROM beliefs WHERE valid_to IS NULL")
def review_parse(s):
    """Reviews' lines, one for each active belief and 500 at most in a text, parsed again."""
    k = F.col("seq") % 5
    box = lambda on: F.when(on, "x").otherwise(" ")
    line = F.concat(F.lit("- ["), box(k.isin(0, 4)), F.lit("] keep ["), box(k == 1), F.lit("] remove ["), box(k.isin(2, 4)), F.lit("] lock | "), F.col("id"), F.lit("  a snippet"))
    text = s.active.groupBy("session_id", F.floor(F.col("seq") / 500)).agg(F.array_join(F.collect_list(line), "\n").alias("t"))
    return text.select(F.explode(files.decisions(F.col("t"))).alias("d")).select("d.*")


@on_tables(
    """WITH t AS (SELECT doc_id, trim(translate(text, chr(92) || '"', '  '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE NOT regexp_matches(text, '[\\x00\\r]'))
    SELECT doc_id, '<module>' AS name, 'Module ' || doc_id || '.' AS text FROM t UNION ALL SELECT doc_id, 'f' || doc_id, t FROM t WHERE t <> ''"""
)
def python_docstrings(spark, sf_dir):
    """The docstrings of sources that hold the texts of documents, of a module and of a function each."""
    text = F.translate("text", '\\"', "  ")
    rows = table(spark, sf_dir, "documents").where("NOT text rlike '[\\\\x00\\\\r]'").select("doc_id", F.concat(F.lit('"""Module '), "doc_id", F.lit('."""\n\n\ndef f'), "doc_id", F.lit('():\n    """'), text, F.lit('"""\n')).alias("code"))
    found = rows.select("doc_id", F.explode(files.docstrings(F.col("code"))).alias("d"))
    return found.select("doc_id", "d.name", F.trim("d.text", F.lit(" \t\n\x0b\x0c\r")).alias("text")).where("text <> ''")


# ---- derivation -----------------------------------------------------------------------------------------------------------

LOGGED = """, g AS (SELECT log_id, CASE WHEN log_id % 7 = 0 THEN 'remember' ELSE source_kind END AS source_kind, raw_text, session_id, created_at, CASE WHEN log_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM log),
    k AS (SELECT *, {kind} AS class, {question} AS question, {hedged} AS hedged FROM (SELECT *, raw_text AS text, trim(lower(raw_text)) AS s FROM g) q),
    d AS (SELECT log_id, session_id, created_at, substr(sha256(source_kind || chr(0) || raw_text), 1, 16) AS id, CASE WHEN source_kind IN ('remember', 'git') THEN 'factual' ELSE class END AS type,
      CASE WHEN source_kind = 'remember' THEN 9.0 WHEN source_kind = 'git' THEN 1.0 ELSE CASE WHEN source_kind = 'transcript' AND role = 'user' THEN 1.0 ELSE 0.2 END * CASE class WHEN 'preference' THEN 7.0 WHEN 'factual' THEN 3.0 ELSE 9.0 END END AS alpha,
      CASE WHEN source_kind = 'remember' THEN 'user_stated' WHEN source_kind = 'transcript' AND role = 'user' THEN 'user_transcript' ELSE 'agent_inferred' END AS origin,
      source_kind IN ('remember', 'git') OR (s <> '' AND NOT question AND (class <> 'factual' OR NOT hedged)) AS kept FROM k)""".format(kind=KIND, question=QUESTION, hedged=HEDGED)


def _log(s: Store) -> DataFrame:
    kind = F.when(F.col("log_id") % 7 == 0, "remember").otherwise(F.col("source_kind"))
    return s.log.select("log_id", kind.alias("source_kind"), "raw_text", "session_id", "created_at", F.when(F.col("log_id") % 2 == 0, "user").otherwise("assistant").alias("role"))


@on_store("log", LOGGED + " SELECT log_id, id, type, round(greatest(0.5, alpha), 6) AS alpha, origin, kept FROM d")
def derive_beliefs(s):
    return ingest.derive(_log(s)).select("log_id", "id", "type", F.round("alpha", 6).alias("alpha"), "origin", "kept")


@on_store(
    "log",
    LOGGED + " SELECT DISTINCT src, dst, 'DERIVED_FROM' AS type, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT id AS src, lag(id) OVER (PARTITION BY session_id ORDER BY created_at, log_id) AS dst FROM d WHERE kept) q WHERE dst IS NOT NULL AND src <> dst",
)
def derived_chain(s):
    log = _log(s)
    return ingest.chain_edges(log, ingest.derive(log))


TEXT_HASH = r"CASE WHEN g.source_kind = 'git' THEN sha256(trim(regexp_replace(lower(g.raw_text), '\s+', ' ', 'g'))) ELSE sha256(g.raw_text) END"


@on_store(
    "log",
    LOGGED
    + f""", x AS (SELECT d.*, g.source_kind, {TEXT_HASH} AS h FROM d JOIN g USING (log_id)), f AS (SELECT h, arg_min(id, created_at * 1000000 + log_id) AS belief_id, arg_min(log_id, created_at * 1000000 + log_id) AS own FROM x WHERE kept GROUP BY 1),
    s AS (SELECT x.log_id, session_id, created_at, source_kind, x.id, x.type, origin, CASE WHEN kept THEN belief_id END AS belief_id, CASE WHEN NOT kept THEN 'skipped' WHEN x.log_id = own THEN 'inserted' ELSE 'corroborated' END AS action FROM x LEFT JOIN f USING (h)),
    c AS (SELECT belief_id AS src, lag(belief_id) OVER (PARTITION BY session_id ORDER BY created_at, log_id) AS dst FROM s WHERE belief_id IS NOT NULL)
    SELECT 'stamp' AS what, log_id::VARCHAR AS a, belief_id AS b, action AS c FROM s UNION ALL SELECT 'belief', id, type, origin FROM s WHERE action = 'inserted'
    UNION ALL SELECT DISTINCT 'corroboration', belief_id, session_id, source_kind FROM s WHERE action = 'corroborated' UNION ALL SELECT DISTINCT 'edge', src, dst, 'DERIVED_FROM' FROM c WHERE dst <> src""",
)
def derivation_worker(s):
    """All that the derivation stream leaves of the log: stamps, beliefs, corroborations and edges."""
    made = worker.run(worker.log_stream(s.log.sparkSession, s.folder))
    tables = {"stamp": ("stamps", "log_id", "belief_id", "action"), "belief": ("beliefs", "id", "type", "origin"), "corroboration": ("corroborations", "belief_id", "session_id", "source_type"), "edge": ("edges", "src", "dst", "type")}
    rows = [made.table(t).select(F.lit(what).alias("what"), F.col(a).cast("string").alias("a"), F.col(b).alias("b"), F.col(c).alias("c")) for what, (t, a, b, c) in tables.items()]
    return reduce(DataFrame.unionByName, rows)


@on_store("turns", None)
def turn_sentences(s):
    """The sentences of turns that aren't noise, which derivation starts from."""
    return ingest.turn_sentences(s.turns)


@on_tables(None)
def extracted_entities(spark, sf_dir):
    """Entities of the sayings and turns; tests hold the kernel against known ones."""
    return _sayings(spark, sf_dir).select("id", F.explode(extract.entities(F.col("text"))).alias("e")).select("id", "e.*")


_extracted: dict[tuple[str, str], Store] = {}


def _with_entities(s: Store) -> Store:
    """The store with the entities of its beliefs' texts, extracted once for each state of the files."""
    key = s.beliefs.sparkSession.sparkContext.applicationId, retrieval.generation(s.beliefs)
    if key not in _extracted:
        _extracted[key] = s.replaced(entities=ingest.entity_table(s.beliefs.select("id", "content")))
    return _extracted[key]


_asked: dict[tuple[str, str], DataFrame] = {}


def _asked_entities(s: Store) -> DataFrame:
    """The entities of every turn, as queries, extracted once for each state of the files."""
    key = s.turns.sparkSession.sparkContext.applicationId, retrieval.generation(s.turns)
    if key not in _asked:
        turns = s.turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("content"))
        _asked[key] = ingest.entity_table(turns).select(F.col("belief_id").alias("query_id"), "entity_lower", "kind")
    return _asked[key]


@on_store("beliefs turns", None)
def extracted_overlap(s):
    """The beliefs that share most entities with each turn; tests hold it against plain sets."""
    return ledger.entity_overlap(_with_entities(s), _asked_entities(s), 20)


@on_store("beliefs turns", None)
def extracted_fan_effect(s):
    """The same, entities of many beliefs counting less."""
    return ledger.entity_overlap(_with_entities(s), _asked_entities(s), 20, fan=True)


@on_store("beliefs turns", None)
def extracted_lane(s):
    """The same without locks, as far as a budget of its own goes."""
    return reports.entity_lane(_with_entities(s), _asked_entities(s), 20, 4000)


@on_store("beliefs turns", None)
def extracted_novelties(s):
    """Entities of turns that no belief has."""
    return ledger.novel_entities(_with_entities(s), _asked_entities(s))


@on_store("beliefs", None)
def extracted_persistence(s):
    """How durable the named entities of each belief are."""
    return ledger.entity_persistence(_with_entities(s))


@on_store("turns", None)
def rebuilt_queries(s):
    """A query from the last four turns of each conversation; tests hold it against the kernel."""
    return ingest.rebuilt_queries(s.turns)


@on_store("turns beliefs", None)
def rebuilt_context(s):
    """What is retrieved for the query that each conversation's last turns make."""
    index = retrieval.cached("content", retrieval.generation(s.beliefs), lambda: retrieval.Index(s.active))
    queries = ingest.rebuilt_queries(s.turns).select(F.col("conv_id").cast("string").alias("query_id"), "query")
    return retrieval.retrieve(s, index, retrieval.match_expression(index, queries), 60_000)


@on_tables(None)
def triple_graph(spark, sf_dir):
    """Edges between the phrases of documents, each with a sentence of two of its words before it; tests hold the kernel against known ones."""
    words = F.split(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), " ")
    verbs = F.array(*(F.lit(v) for v in ("supports", "is based on", "is supported by", "contradicts")))
    sentence = F.concat(F.lit("The "), F.lower(F.get(words, F.lit(0))), F.lit(" module "), F.get(verbs, F.pmod("doc_id", F.lit(4)).cast("int")), F.lit(" the "), F.lower(F.coalesce(F.get(words, F.lit(1)), F.lit("disk"))), F.lit(" layer. "))
    return ingest.triple_beliefs(table(spark, sf_dir, "documents").select(F.concat(sentence, "text").alias("text")))[1]


# ---- ledgers ----------------------------------------------------------------------------------------------------------------

RING = "(SELECT * FROM (SELECT session_id, belief_id, max(feedback_id) AS last, row_number() OVER (PARTITION BY session_id ORDER BY max(feedback_id) DESC) AS n FROM feedback GROUP BY 1, 2) q WHERE n <= 200)"


@on_store("feedback", f"SELECT session_id, belief_id, last FROM {RING} r")
def ring_state(s):
    return ingest.ring_state(s.feedback, 200)


@on_store(
    "feedback injections beliefs",
    f""", i AS (SELECT DISTINCT session_id, belief_id AS id FROM injections), r AS (SELECT DISTINCT session_id, belief_id FROM {RING} q)
    SELECT i.session_id, i.id, r.belief_id IS NOT NULL AND lock_level <> 'user' AS seen FROM i JOIN beliefs b ON b.id = i.id LEFT JOIN r ON r.session_id = i.session_id AND r.belief_id = i.id""",
)
def ring_filter(s):
    shown = s.injections.select("session_id", F.col("belief_id").alias("id")).distinct().join(s.beliefs.select("id", (F.col("lock_level") == "user").alias("locked")), "id")
    return ingest.seen_split(shown, ingest.ring_state(s.feedback, 200))


@on_store("injections", ", e AS (SELECT session_id, max(event_id) AS began FROM injections WHERE event_id % 40 = 0 GROUP BY 1) SELECT DISTINCT i.session_id, belief_id FROM injections i LEFT JOIN e USING (session_id) WHERE event_id >= coalesce(began, -1)")
def injection_epochs(s):
    return ingest.rendered(s.injections.withColumn("epoch", F.col("event_id") % 40 == 0))


@on_store(
    "injections beliefs",
    r""", w AS (SELECT event_id, session_id, coalesce(content, '') AS content FROM injections LEFT JOIN (SELECT id, content FROM beliefs WHERE valid_to IS NULL) b ON b.id = belief_id WHERE referenced IS NULL),
    r AS (SELECT session_id, string_agg(content, ' ' ORDER BY event_id) AS said FROM (SELECT i.session_id, event_id, substr(content, 1, 300) AS content FROM injections i JOIN beliefs ON id = belief_id WHERE valid_to IS NULL AND event_id % 9 = 0) q GROUP BY 1)
    SELECT event_id, CAST(length(b) >= 8 AND contains(trim(regexp_replace(lower(said), '\s+', ' ', 'g')), b) AS INTEGER) AS referenced FROM (SELECT event_id, said, trim(regexp_replace(lower(content), '\s+', ' ', 'g')) AS b FROM w JOIN r USING (session_id)) z""",
)
def relevance_sweep(s):
    """Open exposures against what the session said afterwards (the openings of some of its beliefs)."""
    rows = s.injections.where("event_id % 9 = 0").join(s.active.select(F.col("id").alias("belief_id"), F.substring("content", 1, 300).alias("c")), "belief_id")
    ordered_texts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "c"))), lambda x: x["c"])
    return ingest.answered(s, rows.groupBy("session_id").agg(F.array_join(ordered_texts, " ").alias("said")))


@on_store(
    "injections beliefs",
    """, p AS (SELECT session_id, sum(CASE WHEN session_id % 3 = 0 THEN -1.5 WHEN session_id % 3 = 1 THEN 1.5 END) AS valence FROM (SELECT DISTINCT session_id FROM injections) q WHERE session_id % 3 < 2 GROUP BY 1),
    h AS (SELECT DISTINCT injections.session_id, id, lock_level = 'user' AS locked FROM injections JOIN beliefs ON id = belief_id WHERE valid_to IS NULL)
    SELECT session_id, id, round(valence / CASE WHEN count(*) FILTER (WHERE NOT locked) OVER w > 0 THEN count(*) FILTER (WHERE NOT locked) OVER w ELSE count(*) OVER w END, 6) AS valence, NOT locked AS applied FROM h JOIN p USING (session_id) WINDOW w AS (PARTITION BY session_id)""",
)
def sentiment_shares(s):
    """A third of the sessions say that's wrong, a third perfect, the rest nothing."""
    k = F.col("session_id") % 3
    said = s.injections.select("session_id").distinct().withColumn("prompt", F.when(k == 0, "that's wrong").when(k == 1, "perfect").otherwise("hm"))
    return ingest.sentiment_shares(s, said)


@on_store(
    "beliefs feedback",
    """SELECT feedback_id, belief_id, CASE WHEN lock_level = 'none' THEN alpha + a - up ELSE alpha END AS prior_alpha, CASE WHEN lock_level = 'none' THEN beta + b - down ELSE beta END AS prior_beta,
    CASE WHEN lock_level = 'none' THEN alpha + a ELSE alpha END AS new_alpha, CASE WHEN lock_level = 'none' THEN beta + b ELSE beta END AS new_beta, lock_level <> 'none' AS skipped FROM
    (SELECT *, greatest(valence, 0.0) AS up, greatest(-valence, 0.0) AS down, sum(greatest(valence, 0.0)) OVER w AS a, sum(greatest(-valence, 0.0)) OVER w AS b FROM feedback JOIN (SELECT id, alpha, beta, lock_level FROM beliefs WHERE valid_to IS NULL) x ON id = belief_id
     WHERE valence <> 0 WINDOW w AS (PARTITION BY belief_id ORDER BY feedback_id)) q""",
)
def apply_feedback(s):
    return ingest.applied_feedback(s)


WEIGHTS = {"click": 1.0, "purchase": 2.0, "error": 0.5, "view": 0.0}


@on_store("feedback", f"""SELECT session_id AS key, round(coalesce(sum(w * m) / nullif(sum(w), 0), 0.4), 6) AS value FROM (SELECT session_id, CASE source WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 2.0 WHEN 'error' THEN 0.5 ELSE 0 END AS w, {MEAN} AS m FROM
    (SELECT session_id, source, 0.5 + sum((valence + 1) / 2) AS alpha, 0.5 + sum(1 - (valence + 1) / 2) AS beta FROM feedback GROUP BY 1, 2) q) z GROUP BY 1""")
def surfaced_value(s):
    """The value of a knob for each session from the evidence of its signals."""
    e = (F.col("valence") + 1) / 2
    g = s.feedback.groupBy(F.col("session_id").alias("key"), F.col("source").alias("signal")).agg((0.5 + F.sum(e)).alias("alpha"), (0.5 + F.sum(1 - e)).alias("beta"))
    return ingest.surfaced_value(g, WEIGHTS, 0.4)


@on_store(
    "turns",
    """, w AS (SELECT DISTINCT conv_id * 100 + turn AS id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS g FROM turns), d AS (SELECT g, count(*) AS df FROM w WHERE g <> '' GROUP BY 1 HAVING count(*) >= 2),
    u AS (SELECT w.id, w.g FROM w JOIN d USING (g) WHERE df <= 8), r AS (SELECT w.id, w.g FROM w JOIN d USING (g) WHERE w.id NOT IN (SELECT id FROM u)), l AS (SELECT g, min(id) AS a FROM r GROUP BY 1)
    SELECT DISTINCT a, b FROM (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.g = y.g AND x.id < y.id UNION ALL SELECT a, id FROM r JOIN l USING (g) WHERE id <> a) q""",
)
def blocked_pairs(s):
    """Turns that share a word of at most eight turns."""
    words = s.turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.explode(texts.title_tokens(F.col("text"))).alias("g"))
    return ingest.blocked_pairs(words, 8)


def _register_utterances() -> None:
    from .registry import ORACLE_SQL

    odds = ORACLE_SQL["utterance_logodds"].split("SELECT word, count(*) FILTER (WHERE u) AS d1", 1)
    sql = odds[0] + ", o AS (SELECT word, count(*) FILTER (WHERE u) AS d1" + odds[1] + "), t AS (SELECT DISTINCT conv_id * 100 + turn AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS word FROM turns)"

    @on_tables(sql + " SELECT conv_id * 100 + turn AS id, round(-0.5 * greatest(0.0, coalesce(m, 0.0)), 6) AS penalty FROM turns LEFT JOIN (SELECT id AS i, avg(log_odds) AS m FROM t JOIN o USING (word) GROUP BY 1) a ON i = conv_id * 100 + turn")
    def utterance_penalty(spark, sf_dir):
        turns = table(spark, sf_dir, "conversations")
        odds = relational.utterance_logodds(turns.withColumn("u", F.col("role") == "user"), "text", "u", 5)
        return ingest.utterance_penalty(turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text"), odds, 0.5)


@on_store("beliefs", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id) AS place FROM beliefs WHERE retention_class <> 'transient' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id) <= 1000")
def session_hits(s):
    """The newest beliefs of each session, without those already shown."""
    rows = s.beliefs.where("retention_class <> 'transient'")
    return ordered.ring(rows.select("session_id", "id", "created_at"), "session_id", [F.desc("created_at"), F.col("id")], 1000, place=True).select("session_id", "id", "place")


@on_store("turns", "SELECT conv_id, arg_max(role, turn) AS role FROM turns WHERE role <> 'system' GROUP BY 1")
def latest_role(s):
    """The last value of each conversation that isn't missing (system turns count as missing)."""
    value = F.when(F.col("role") != "system", F.col("role"))
    return s.turns.groupBy("conv_id").agg(F.max_by("role", F.when(value.isNotNull(), F.col("turn"))).alias("role"), F.count(value).alias("n")).where("n > 0").drop("n")


# ---- exports ----------------------------------------------------------------------------------------------------------------


def _nodes(s: Store) -> DataFrame:
    return s.active.where("origin = 'user_stated'").select("id", "content", scoring.posterior_mean(F.col("alpha"), F.col("beta")).alias("mean"), "lock_level")


NODES = f", n AS (SELECT id, content, {MEAN} AS mean, lock_level FROM beliefs WHERE valid_to IS NULL AND origin = 'user_stated'), e AS (SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))"
LABEL = r"(SELECT id, mean, lock_level, CASE WHEN length(l) <= 80 THEN l ELSE substr(l, 1, 79) || '…' END AS label FROM (SELECT *, trim(regexp_replace(content, '\s+', ' ', 'g')) AS l FROM n) a)"


@on_store(
    "beliefs edges",
    NODES
    + rf""" SELECT 1 AS part, id AS key, '  "' || id || '" [label="' || replace(replace(label, '\', '\\'), '"', '\"') || '"' || CASE WHEN lock_level = 'user' THEN ', color="cyan3"' WHEN mean >= 0.75 THEN ', color="darkgreen"' WHEN mean < 0.25 THEN ', color="firebrick"' ELSE '' END
      || CASE WHEN lock_level = 'user' THEN ', penwidth=2' ELSE '' END || '];' AS line FROM {LABEL} x
    UNION ALL SELECT 2, src || chr(0) || dst || chr(0) || type, '  "' || src || '" -> "' || dst || '" [color="' || CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.EDGE_COLORS.items())} END || '"];' FROM e
    UNION ALL SELECT * FROM (VALUES (0, '0', 'digraph store {{'), (0, '1', '  graph [rankdir=LR];'), (0, '2', '  node [shape=box, style=rounded];'), (3, '', '}}')) v""",
)
def export_dot(s):
    return files.dot_lines(_nodes(s), s.edges)


@on_store(
    "beliefs edges",
    NODES
    + f""" SELECT 'node' AS part, id, label, CAST(lock_level = 'user' AS VARCHAR) AS locked, CAST(round(mean, 6) AS DOUBLE) AS posterior_mean, NULL AS src, NULL AS dst, NULL AS type FROM {LABEL} x
    UNION ALL SELECT 'edge', src || '>' || type || '>' || dst, NULL, NULL, NULL, src, dst, type FROM e""",
)
def export_json(s):
    """The objects of a JSON export, read again."""
    kind = "label string, locked string, posterior_mean double, src string, dst string, type string"
    return files.graph_json(_nodes(s), s.edges).select("part", "id", F.from_json("json", kind, {"mode": "FAILFAST"}).alias("x")).select("part", "id", "x.*")


@on_store(
    "beliefs edges",
    NODES
    + """, l AS (SELECT src, string_agg(DISTINCT '- ' || type || ' [[' || dst || ']]', chr(10) ORDER BY '- ' || type || ' [[' || dst || ']]') AS links FROM edges GROUP BY 1)
    SELECT id || '.md' AS file, '---' || chr(10) || 'id: ' || id || chr(10) || 'lock: ' || lock_level || chr(10) || '---' || chr(10) || content || coalesce(chr(10) || chr(10) || links, '') AS note FROM n LEFT JOIN l ON src = id""",
)
def export_vault(s):
    return files.vault_notes(_nodes(s), s.edges)


_register_utterances()
