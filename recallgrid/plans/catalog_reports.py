"""Queries that put operators together: audits, lanes, routes, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import reports, retrieval
from ..sources.model import Store
from .catalog import INDEX, TOK, index_of
from .registry import MEAN, ORACLE_SQL, asked, on_store, on_tables, one_byte

# ---- duplicates -----------------------------------------------------------------------------------------------------------

COPIES = ", " + one_byte("turns", "text") + f""", c AS (SELECT conv_id * 100 + turn AS id, text FROM turns UNION ALL SELECT 900000000 + conv_id * 100 + turn, text || ' and more' FROM turns WHERE role = 'user'
      UNION ALL SELECT 950000000 + conv_id * 100 + turn, 'so ' || text FROM turns WHERE turn = 0),
    w AS (SELECT id, translate(text, f, ab.t) AS e, list_distinct({TOK.format("text")}) AS t FROM c, ab),
    p AS (SELECT x.id AS a, y.id AS b, x.t AS xt, y.t AS yt, x.e AS xe, y.e AS ye FROM w x JOIN w y ON x.id < y.id AND len(x.t) * 0.8 <= len(y.t) AND len(y.t) * 0.8 <= len(x.t)),
    j AS (SELECT a, b, round(len(list_intersect(xt, yt)) * 1.0 / len(list_distinct(list_concat(xt, yt))), 6) AS jaccard, xe, ye FROM p WHERE len(list_intersect(xt, yt)) * 1.0 / len(list_distinct(list_concat(xt, yt))) >= 0.7999),
    k AS (SELECT a, b, jaccard, round(1 - levenshtein(xe, ye) * 1.0 / greatest(length(xe), length(ye)), 6) AS ratio FROM j WHERE jaccard >= 0.8 AND round(1 - levenshtein(xe, ye) * 1.0 / greatest(length(xe), length(ye)), 6) >= 0.85)"""


def _copies(s: Store) -> DataFrame:
    """Turns, those of users once more with words at their end, and the first of each with one before it."""
    rows = s.turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", "role", "turn")
    more = rows.where("role = 'user'").select((F.col("id") + 900_000_000).alias("id"), F.concat("text", F.lit(" and more")).alias("text"))
    first = rows.where("turn = 0").select((F.col("id") + 950_000_000).alias("id"), F.concat(F.lit("so "), "text").alias("text"))
    return rows.select("id", "text").unionByName(more).unionByName(first)


@on_store("turns", COPIES + " SELECT a, b, jaccard, ratio FROM k")
def dedup_audit(s):
    """Pairs that are alike by words and by edit distance."""
    return reports.near_pairs(_copies(s), 0.8, 0.85)


@on_store(
    "turns",
    COPIES
    + """, n AS (SELECT a AS x, b AS y FROM k UNION SELECT b, a FROM k), r AS (SELECT DISTINCT x AS id, x AS root FROM n UNION SELECT n.y, r.root FROM r JOIN n ON n.x = r.id), g AS (SELECT id, min(root) AS root FROM r GROUP BY 1),
    m AS (SELECT root, id, w.e AS said FROM g JOIN w USING (id)), e AS (SELECT x.root, x.id, CAST(sum(levenshtein(x.said, y.said)) AS BIGINT) AS distance FROM m x JOIN m y USING (root) GROUP BY 1, 2)
    SELECT root AS cluster, arg_min(id, (distance, id)) AS medoid, count(*) AS members, count(*) - 1 AS would_remove FROM e GROUP BY 1 HAVING count(*) >= 3""",
)
def consolidation_report(s):
    """Groups of three or more that are alike, the member that stands for each, and how many merging would remove."""
    return reports.consolidation(_copies(s), reports.near_pairs(_copies(s), 0.8, 0.85), 3)


ORACLE_SQL["consolidation_report"] = ORACLE_SQL["consolidation_report"].replace("WITH ", "WITH RECURSIVE ", 1)


# ---- lanes and routes -------------------------------------------------------------------------------------------------------


@on_store(
    "beliefs edges",
    INDEX + " SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM m WHERE id NOT IN (SELECT dst FROM edges WHERE type = 'SUPERSEDES')) r WHERE place <= 10",
)
def search_without_superseded(s):
    gone = s.edges.where("type = 'SUPERSEDES'").select(F.col("dst").alias("id"))
    return retrieval.top(index_of(s).match(asked(s)).join(gone, "id", "left_anti"), 10)


@on_store("beliefs", INDEX + ", i AS (SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, n) SELECT round(quantile_cont(idf, 0.25), 6) AS low, round(quantile_cont(idf, 0.75), 6) AS high FROM i")
def idf_quantiles(s):
    index = index_of(s)
    n, df = F.col("n"), F.col("df")
    rows = index.frequencies.crossJoin(F.broadcast(index.totals.select("n"))).select(F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    return rows.agg(F.round(F.percentile("idf", F.lit(0.25)), 6).alias("low"), F.round(F.percentile("idf", F.lit(0.75)), 6).alias("high"))


@on_store(
    "entities beliefs",
    """, w AS (SELECT DISTINCT 'q' || k AS query_id, entity_lower FROM entities JOIN (SELECT unnest(range(5)) AS k) r ON belief_id = 'd' || (k * 7)),
    b AS (SELECT id, lock_level, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM beliefs WHERE valid_to IS NULL), r AS (SELECT DISTINCT belief_id, entity_lower FROM entities WHERE belief_id IN (SELECT id FROM b)),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, belief_id) AS place FROM (SELECT query_id, belief_id, count(*) AS overlap FROM w JOIN r USING (entity_lower) GROUP BY 1, 2) q QUALIFY place <= 20)
    SELECT query_id, belief_id, tokens, CAST(spent AS BIGINT) AS spent FROM (SELECT h.*, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY place) AS spent FROM h JOIN b ON id = belief_id WHERE lock_level = 'none') z WHERE spent <= 4000""",
)
def entity_lane(s):
    """Beliefs that share entities with a query, without locks, as far as a budget of their own goes."""
    wanted = s.entities.where(F.col("belief_id").isin(*(f"d{7 * k}" for k in range(5)))).select(F.concat(F.lit("q"), (F.substring("belief_id", 2, 9).cast("int") / 7).cast("int")).alias("query_id"), "entity_lower").distinct()
    return reports.entity_lane(s, wanted, 20, 4000)


@on_store(
    "edges beliefs",
    """, m AS (SELECT DISTINCT type || ':' || dst AS prompt, type, dst FROM edges WHERE CAST(substr(src, 2) AS BIGINT) % 20 = 0 AND type <> 'POTENTIALLY_STALE')
    SELECT prompt, src AS id, row_number() OVER (PARTITION BY prompt ORDER BY src) AS place FROM m JOIN edges USING (type, dst) WHERE src IN (SELECT id FROM beliefs WHERE valid_to IS NULL)""",
)
def structural_routing(s):
    """Prompts of the form KIND:target (here the edges of every twentieth belief, and a few other texts) are answered by the edges themselves."""
    marks = s.edges.where(F.substring("src", 2, 20).cast("long") % 20 == 0).select(F.concat("type", F.lit(":"), "dst").alias("text")).distinct()
    other = s.edges.sparkSession.createDataFrame([("NOPE:d1",), ("no marker",), ("SUPPORTS:",), ("",)], "text string")
    return reports.structural(s, marks.unionByName(other).select(F.col("text").alias("prompt"), "text"))


@on_store("turns", "SELECT DISTINCT term, '\"' || replace(term, '\"', '\"\"') || '\"' AS quoted FROM (SELECT unnest(string_split(text, ' ')) AS term FROM turns) q WHERE term <> ''")
def quoted_tokens(s):
    """Words as literals of a match expression."""
    return s.turns.select(F.explode(F.split("text", " ")).alias("term")).where("term <> ''").distinct().select("term", F.concat(F.lit('"'), F.replace("term", F.lit('"'), F.lit('""')), F.lit('"')).alias("quoted"))


GAPS = (
    INDEX
    + f""", h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM m) r WHERE place <= 24), t AS (SELECT query_id, count(DISTINCT term) AS terms FROM q WHERE term <> '' GROUP BY 1),
    c AS (SELECT h.query_id, count(DISTINCT q.term) AS covered FROM h JOIN tf ON tf.id = h.id JOIN q ON q.term = tf.term AND q.query_id = h.query_id GROUP BY 1),
    u AS (SELECT query_id, round(avg(least(1.0, 12 * alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))), 6) AS uncertainty FROM h JOIN beliefs USING (id) GROUP BY 1),
    x AS (SELECT a.query_id, count(DISTINCT (least(src, dst), greatest(src, dst))) AS n FROM edges JOIN h a ON a.id = src JOIN h b ON b.id = dst AND a.query_id = b.query_id WHERE type = 'CONTRADICTS' GROUP BY 1)
    SELECT query_id, round(coalesce(covered, 0) * 1.0 / terms, 6) AS coverage, terms - coalesce(covered, 0) AS uncovered, uncertainty, coalesce(n, 0) AS contradictions FROM t LEFT JOIN c USING (query_id) LEFT JOIN u USING (query_id) LEFT JOIN x USING (query_id)"""
)


@on_store("beliefs edges", GAPS)
def gap_analysis(s):
    """How much of each query its hits cover, how uncertain those are, and how many contradict each other."""
    index = index_of(s)
    return reports.gaps(s, index, asked(s), 24)



@on_store(
    "beliefs edges",
    GAPS[: GAPS.rindex("SELECT query_id, round(coalesce(covered")].rstrip()
    + ", y AS ("
    + GAPS[GAPS.rindex("SELECT query_id, round(coalesce(covered") :]
    + """), z AS (SELECT query_id, count(*) AS unsure FROM h JOIN beliefs USING (id) WHERE least(1.0, 12 * alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) > 0.7 GROUP BY 1),
    a AS (SELECT query_id, list_filter([{'axis': 'domain_research', 'context': 'always-on'}, {'axis': 'internal_gap_analysis', 'context': 'always-on'},
      CASE WHEN contradictions > 0 THEN {'axis': 'contradiction_resolution', 'context': 'unresolved_contradicts_pairs=' || contradictions} END, CASE WHEN coalesce(unsure, 0) > 0 THEN {'axis': 'uncertainty_deep_dive', 'context': 'high_uncertainty_count=' || unsure} END,
      CASE WHEN coverage < 0.5 OR uncovered > 0 THEN {'axis': 'coverage_extension', 'context': 'query_term_coverage=' || format('{:.2f}', coverage)} END], lambda x: x IS NOT NULL) AS l FROM y LEFT JOIN z USING (query_id))
    SELECT query_id, place, l[place].axis AS axis, l[place].context AS context FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS place FROM a) q""",
)
def research_axes(s):
    """What to look for where the hits of each query leave gaps."""
    return reports.research_axes(s, index_of(s), asked(s), 24)


@on_store(
    "beliefs",
    INDEX
    + """, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM m) r WHERE place <= 10)
    SELECT h.query_id, h.id, q.term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS weight FROM h JOIN tf ON tf.id = h.id JOIN q ON q.term = tf.term AND q.query_id = h.query_id JOIN df ON df.term = q.term, n""",
)
def coverage_inputs(s):
    """The terms of a query that each of its hits has, and their weights."""
    return reports.covered_terms(index_of(s), asked(s), retrieval.top(index_of(s).match(asked(s)), 10))


# ---- reports ----------------------------------------------------------------------------------------------------------------


@on_store(
    "beliefs log",
    """, c AS (SELECT DISTINCT sha256(raw_text) AS h, log_id % 5 = 0 AS rejected FROM log UNION SELECT content_hash, false FROM beliefs WHERE seq % 4 = 0)
    SELECT CASE WHEN h IN (SELECT content_hash FROM beliefs) THEN 'present' WHEN rejected THEN 'rejected' ELSE 'new' END AS state, count(*) AS n FROM (SELECT h, bool_or(rejected) AS rejected FROM c GROUP BY 1) q GROUP BY 1""",
)
def onboard_counts(s):
    """Texts found in a scan: those that are beliefs already, those rejected before, and new ones."""
    found = s.log.select(F.sha2("raw_text", 256).alias("content_hash"), (F.col("log_id") % 5 == 0).alias("rejected")).unionByName(s.beliefs.where("seq % 4 = 0").select("content_hash", F.lit(False).alias("rejected")))
    rejected = found.where("rejected").select("content_hash").distinct()
    return reports.onboarding(s, found.select("content_hash").distinct(), rejected)


@on_store(
    "beliefs",
    """SELECT session_id AS drawn_for, 20 * (seq // 500) AS fire_idx, '[' || string_agg('"' || id || '"', ',' ORDER BY id) || ']' AS candidate_ids FROM beliefs WHERE valid_to IS NULL AND lock_level = 'none' GROUP BY 1, 2""",
)
def exploration_record(s):
    """The ledger rows of draws, a draw for each 500 beliefs, with their candidates as JSON."""
    rows = s.active.where("lock_level = 'none'")
    return rows.groupBy(F.col("session_id").alias("drawn_for"), (20 * F.floor(F.col("seq") / 500)).alias("fire_idx")).agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("candidate_ids"))


@on_store(
    "beliefs",
    f"""SELECT id, x, y, color FROM (SELECT id, CAST(trunc(seq % 3 * 480 * cos(a)) AS BIGINT) AS x, CAST(trunc(seq % 3 * 480 * sin(a)) AS BIGINT) AS y, CASE WHEN lock_level = 'user' THEN '5' WHEN m >= 0.75 THEN '4' WHEN m < 0.25 THEN '6' ELSE '' END AS color
    FROM (SELECT id, seq, lock_level, {MEAN} AS m, CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) / 4294967295.0 * 2 * pi() AS a FROM beliefs WHERE valid_to IS NULL) p) q""",
)
def export_canvas(s):
    """Where the nodes of a canvas stand: on rings by depth, at an angle that their id gives."""
    return reports.canvas(s.active.withColumn("depth", F.col("seq") % 3))


@on_store(
    "beliefs",
    f""", m AS (SELECT session_id AS grp, type AS strategy, avg(CASE WHEN {MEAN} >= 0.7 THEN 1.0 ELSE 0.0 END) AS confirmed, avg(CASE WHEN {MEAN} < 0.3 THEN 1.0 ELSE 0.0 END) AS junk FROM beliefs GROUP BY 1, 2),
    g AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE confirmed < 0.05) AS under, count(*) FILTER (WHERE junk > 0.3) AS junky, count(*) FILTER (WHERE confirmed >= 0.15) AS clear FROM m GROUP BY 1)
    SELECT grp AS "group", CASE WHEN under = n THEN 'drop' WHEN junky > 0 THEN 'defer' WHEN clear = 0 THEN 'defer' WHEN clear = 1 THEN 'single' ELSE 'ensemble' END AS verdict FROM g""",
)
def adoption_verdicts(s):
    """Whether any of the strategies (here types) of a group is worth keeping, by rates of confirmation and junk."""
    mean = scoring.posterior_mean(F.col("alpha"), F.col("beta"))
    m = s.beliefs.groupBy(F.col("session_id").alias("group"), "type").agg(F.avg((mean >= 0.7).cast("double")).alias("confirmed"), F.avg((mean < 0.3).cast("double")).alias("junk"))
    return reports.adoption(m, 0.05, 0.15, 0.3)


@on_store("beliefs edges", None)
def contradiction_edges(s):
    """CONTRADICTS edges of pairs in order, eight at most at each end; tests hold it against a plain pass."""
    a = s.edges.where("type IN ('SUPPORTS', 'CITES', 'RELATES_TO', 'CONTRADICTS', 'IMPLEMENTS')")
    return reports.capped_pairs(a.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct(), 8)


@on_store("beliefs", "SELECT id, type AS topic, session_id AS session, type || ' atom ' || (row_number() OVER (PARTITION BY type ORDER BY id) - 1) AS content FROM beliefs")
def synthetic_corpus(s):
    """Beliefs as numbered atoms of topics, for trials of strategies."""
    return reports.atoms(s)
