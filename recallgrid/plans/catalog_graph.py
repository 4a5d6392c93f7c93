"""Queries of walks, packs, vectors, scores, cadences and exports, with their SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect, scoring
from ..operators import graph, metrics, packs, policy, retrieval, similarity, vectors, walk
from ..plans.session import new_folder
from ..sources.model import Store
from .registry import BASE, MEAN, ORACLE_SQL, asked, on_store, on_tables

# ---- walks --------------------------------------------------------------------------------------------------------------


def _seeds(s: Store) -> DataFrame:
    """Every active belief whose number is divisible by 20, against the whole graph."""
    return s.active.where("seq % 20 = 0").select(F.col("id").alias("seed"))


@on_store("", None)
def greedy_expansion(s):
    """Tests hold it against a plain walk."""
    hops = walk.expand(s, _seeds(s))
    return hops.select("seed", "node", F.round("score", 6).alias("score"), "depth", F.array_join("trail", " ").alias("trail"), F.array_join("kinds", " ").alias("kinds"))


VALENCE_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in graph.VALENCE.items() if v) + " END"


def _spread() -> str:
    sql = f""", b AS (SELECT id, CASE WHEN alpha + beta > 0 THEN alpha / (alpha + beta) ELSE 0.0 END AS broker FROM beliefs WHERE valid_to IS NULL),
    w AS (SELECT src AS node, dst AS t, {VALENCE_SQL} * broker AS m FROM edges JOIN b ON b.id = src WHERE {VALENCE_SQL} IS NOT NULL AND dst IN (SELECT id FROM b)),
    s AS (SELECT belief_id AS src, sum(valence) AS v FROM feedback WHERE source IN ('purchase', 'error') GROUP BY 1), r0 AS (SELECT src, src AS node, v AS carried, abs(v) * 3 AS cap, CAST(0 AS DOUBLE) AS mass FROM s)"""
    for k in (1, 2, 3):
        before = " UNION ALL ".join(f"SELECT src, node AS id FROM r{j}" for j in range(1, k)) or "SELECT NULL AS src, NULL AS id"
        sql += f""", z{k} AS ({before}), x{k} AS (SELECT src, cap, mass, t AS id, arg_max(carried * m, (abs(carried * m), carried * m)) AS delta FROM r{k - 1} JOIN w USING (node)
          WHERE abs(carried) >= 0.05 AND t <> src AND abs(carried * m) >= 0.05 AND NOT EXISTS (SELECT 1 FROM z{k} z WHERE z.src = r{k - 1}.src AND z.id = t) GROUP BY 1, 2, 3, 4),
        y{k} AS (SELECT *, coalesce(sum(abs(delta)) OVER (PARTITION BY src ORDER BY abs(delta) DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x{k}),
        q{k} AS (SELECT src, id AS node, sign(delta) * least(abs(delta), cap - mass - before) AS carried, cap, mass FROM y{k} WHERE cap - mass - before > 1e-12 AND least(abs(delta), cap - mass - before) >= 0.05),
        r{k} AS (SELECT src, node, carried, cap, mass + sum(abs(carried)) OVER (PARTITION BY src) AS mass FROM q{k})"""
    return sql + " SELECT src, node AS id, round(carried, 6) AS delta FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) u"


@on_store("beliefs edges feedback", _spread())
def valence_spread(s):
    """What purchases and errors do to beliefs up to three steps away."""
    events = s.feedback.where("source IN ('purchase', 'error')").select(F.col("belief_id").alias("src"), "valence")
    return walk.propagate_valence(s, events)


NEWEST = "(SELECT session_id AS grp, id AS seed, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id) AS pos FROM beliefs WHERE valid_to IS NULL)"


@on_store(
    "beliefs edges",
    f""", s AS (SELECT * FROM {NEWEST} q WHERE pos <= 5), e AS (SELECT dst AS seed, src AS id, 0 AS side FROM edges WHERE type = 'TEMPORAL_NEXT' UNION ALL SELECT src, dst, 1 FROM edges WHERE type = 'TEMPORAL_NEXT'),
    n AS (SELECT grp, id, min((pos, side)) AS k FROM s JOIN e USING (seed) WHERE (grp, id) NOT IN (SELECT (grp, seed) FROM s) AND id IN (SELECT id FROM beliefs WHERE valid_to IS NULL) GROUP BY 1, 2)
    SELECT grp AS "group", id, row_number() OVER (PARTITION BY grp ORDER BY k, id) AS place FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k, id) <= 32""",
)
def spine_traversal(s):
    """The spine around the five newest beliefs of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "id")
    seeds = s.active.select(F.col("session_id").alias("group"), F.col("id").alias("seed"), F.row_number().over(w).alias("pos")).where("pos <= 5")
    return walk.spine_neighbours(s, seeds)


FIRST_HOPS = """, h AS (SELECT seed, node, arg_max(type, (w, type)) AS kind FROM (SELECT CASE WHEN type = 'SUPERSEDES' THEN dst ELSE src END AS seed, CASE WHEN type = 'SUPERSEDES' THEN src ELSE dst END AS node, type, {w} AS w FROM edges) e
    WHERE w >= 0.1 AND seed <> node AND seed IN (SELECT id FROM beliefs WHERE valid_to IS NULL) AND node IN (SELECT id FROM beliefs WHERE valid_to IS NULL) GROUP BY 1, 2),
    m AS (SELECT id, {mean} AS mean, alpha + beta < 4 AS low, lock_level = 'user' AS locked FROM beliefs), s AS (SELECT id AS seed FROM beliefs WHERE valid_to IS NULL),
    p AS (SELECT seed, node, kind, round(a.mean * b.mean, 6) AS compound, CASE WHEN b.mean <= a.mean THEN node ELSE seed END AS weakest, CASE WHEN kind = 'CONTRADICTS' THEN seed END AS fork_from FROM h JOIN m a ON a.id = seed JOIN m b ON b.id = node),
    c AS (SELECT h.seed, node, mean, locked FROM h JOIN m ON id = node WHERE kind = 'CONTRADICTS'),
    i AS (SELECT seed, 'NO_CHANGE' AS kind, seed AS ids FROM s WHERE seed NOT IN (SELECT seed FROM h)
      UNION ALL SELECT seed, 'NO_CHANGE', string_agg(node, ' ' ORDER BY node) FROM h JOIN m b ON b.id = node JOIN m a ON a.id = seed GROUP BY seed, a.low HAVING bool_and(b.low) AND a.low
      UNION ALL SELECT seed, 'CONSTRAINT_FAILURE', node FROM c WHERE locked
      UNION ALL SELECT a.seed, 'TIE', a.node || ' ' || b.node FROM c a JOIN c b ON a.seed = b.seed AND a.node < b.node WHERE abs(a.mean - b.mean) < 0.15
      UNION ALL SELECT seed, 'GAP', node FROM h JOIN m ON id = node WHERE low AND node NOT IN (SELECT src FROM edges)
      UNION ALL SELECT a.seed, 'TIE', a.node || ' ' || b.node FROM p a JOIN p b ON a.seed = b.seed AND a.fork_from = b.fork_from AND a.node < b.node WHERE greatest(a.compound, b.compound) >= 0.1 AND abs(a.compound - b.compound) <= 0.2 * greatest(a.compound, b.compound)),
    f AS (SELECT seed, bool_or(NOT low) AS sure FROM h JOIN m ON id = node GROUP BY 1), k AS (SELECT seed, bool_or(kind = 'TIE') AS t, bool_or(kind = 'NO_CHANGE') AS n, bool_or(kind = 'CONSTRAINT_FAILURE') AS c, bool_or(kind = 'GAP') AS g FROM i GROUP BY 1),
    v AS (SELECT s.seed, CASE WHEN t THEN 'CONTRADICTORY' WHEN n THEN 'INSUFFICIENT' WHEN c THEN 'PARTIAL' WHEN g AND NOT coalesce(sure, false) THEN 'UNCERTAIN' WHEN k.seed IS NOT NULL AND coalesce(sure, false) THEN 'PARTIAL' ELSE 'SUFFICIENT' END AS verdict
      FROM s LEFT JOIN k USING (seed) LEFT JOIN f USING (seed))""".replace("{w}", "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in graph.WALK.items()) + " ELSE 0 END").replace("{mean}", MEAN)


def _hops(s: Store) -> DataFrame:
    """The first step of the walk from every active belief."""
    back = F.col("type") == "SUPERSEDES"
    e = s.edges.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("seed"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("node"), "type")
    live = s.active.select("id")
    e = e.withColumn("w", graph.weight_of(F.col("type"), graph.WALK)).where("w >= 0.1 AND seed <> node").join(live.withColumnRenamed("id", "seed"), "seed", "left_semi").join(live.withColumnRenamed("id", "node"), "node", "left_semi")
    best = e.groupBy("seed", "node").agg(F.max(F.struct("w", "type")).alias("b"))
    return best.select("seed", "node", F.array("seed", "node").alias("trail"), F.array("b.type").alias("kinds"))


def _every(s: Store) -> DataFrame:
    return s.active.select(F.col("id").alias("seed"))


@on_store("beliefs edges", FIRST_HOPS + " SELECT seed, node, 1 AS depth, compound, weakest, fork_from FROM p")
def consequence_paths(s):
    return walk.paths(s, _hops(s))


@on_store("beliefs edges", FIRST_HOPS + " SELECT * FROM i")
def impasses(s):
    return walk.impasses(s, _every(s), _hops(s))


@on_store("beliefs edges", FIRST_HOPS + " SELECT * FROM v")
def verdicts(s):
    hops = _hops(s)
    return walk.verdicts(s, _every(s), hops, walk.impasses(s, _every(s), hops))


@on_store("beliefs edges", FIRST_HOPS + " SELECT seed, kind, ids, CASE WHEN kind IN ('GAP', 'NO_CHANGE') THEN 'Gap-filler' WHEN kind = 'TIE' THEN 'Fork-resolver' ELSE 'Verifier' END AS role FROM i WHERE seed IN (SELECT seed FROM v WHERE verdict <> 'SUFFICIENT')")
def dispatch_policy(s):
    hops = _hops(s)
    stuck = walk.impasses(s, _every(s), hops)
    return walk.dispatch(walk.verdicts(s, _every(s), hops, stuck), stuck)


@on_store(
    "beliefs edges",
    FIRST_HOPS
    + """, a AS (SELECT DISTINCT seed, unnest(string_split(ids, ' ')) AS id FROM i)
    SELECT seed, node AS id, '+1' AS direction FROM h JOIN m ON m.id = node WHERE NOT low AND (seed, node) NOT IN (SELECT (seed, id) FROM a) AND seed IN (SELECT seed FROM v WHERE verdict <> 'INSUFFICIENT')
    UNION ALL SELECT seed, id, '?' FROM a""",
)
def suggested_updates(s):
    hops = _hops(s)
    stuck = walk.impasses(s, _every(s), hops)
    return walk.suggestions(s, walk.verdicts(s, _every(s), hops, stuck), hops, stuck)


# ---- conclusions over two steps -----------------------------------------------------------------------------------------

_WALK_SQL = "CASE type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in graph.WALK.items()) + " ELSE 0 END"
#: The walk of two steps: nodes are claimed in order of the first step, then of the second; budgets never bind here.
DEEP_HOPS = (
    f""", live AS (SELECT id FROM beliefs WHERE valid_to IS NULL), es AS (SELECT CASE WHEN type = 'SUPERSEDES' THEN dst ELSE src END AS node, CASE WHEN type = 'SUPERSEDES' THEN src ELSE dst END AS t, type, weight, {_WALK_SQL} AS w FROM edges),
    st AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, weight DESC, t) AS n FROM (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY node, t ORDER BY w DESC, weight DESC, type DESC) = 1) q),
    g1 AS (SELECT node AS seed, t, w, type, n FROM st WHERE node IN (SELECT id FROM live) AND t <> node AND w >= 0.1),
    g2 AS (SELECT g1.seed, g1.t AS mid, st.t, st.type FROM g1 JOIN st ON st.node = g1.t WHERE g1.t IN (SELECT id FROM live) AND st.t <> g1.seed AND st.w > 0 AND g1.w * st.w >= 0.1 AND NOT EXISTS (SELECT 1 FROM g1 o WHERE o.seed = g1.seed AND o.t = st.t)
      QUALIFY row_number() OVER (PARTITION BY g1.seed, st.t ORDER BY g1.n, st.n) = 1),
    h AS (SELECT seed, t AS node, type AS kind, 1 AS depth, NULL AS mid FROM g1 WHERE t IN (SELECT id FROM live) UNION ALL SELECT seed, t, type, 2, mid FROM g2 WHERE t IN (SELECT id FROM live)),"""
    + FIRST_HOPS[FIRST_HOPS.index("m AS (SELECT id, ") : FIRST_HOPS.index("p AS (SELECT seed, node, kind,")]
    + """p AS (SELECT seed, node, kind, depth, round(a.mean * coalesce(x.mean, 1.0) * b.mean, 6) AS compound, CASE WHEN b.mean <= a.mean AND b.mean <= coalesce(x.mean, b.mean) THEN node WHEN x.mean <= a.mean THEN mid ELSE seed END AS weakest,
      CASE WHEN kind = 'CONTRADICTS' THEN coalesce(mid, seed) END AS fork_from FROM h JOIN m a ON a.id = seed JOIN m b ON b.id = node LEFT JOIN m x ON x.id = mid),"""
    + FIRST_HOPS[FIRST_HOPS.index("c AS (SELECT h.seed, node, mean, locked") - 4 :].lstrip()
)
_deep: dict[tuple[str, str], DataFrame] = {}


def _deep_hops(s: Store) -> DataFrame:
    """The hops of two steps from every active belief, walked once for each state of the files."""
    spark = s.edges.sparkSession
    key = spark.sparkContext.applicationId, retrieval.generation(s.beliefs)
    if key not in _deep:
        folder = new_folder(spark, "hops")
        walk.expand(s, _every(s)).write.parquet(folder)
        _deep[key] = spark.read.parquet(folder)
    return _deep[key]


@on_store("beliefs edges", DEEP_HOPS + " SELECT seed, node, depth, compound, weakest, fork_from FROM p")
def deep_paths(s):
    return walk.paths(s, _deep_hops(s))


@on_store("beliefs edges", DEEP_HOPS + " SELECT * FROM i")
def deep_impasses(s):
    return walk.impasses(s, _every(s), _deep_hops(s))


@on_store("beliefs edges", DEEP_HOPS + " SELECT * FROM v")
def deep_verdicts(s):
    hops = _deep_hops(s)
    return walk.verdicts(s, _every(s), hops, walk.impasses(s, _every(s), hops))


@on_store("beliefs edges", DEEP_HOPS + " SELECT seed, kind, ids, CASE WHEN kind IN ('GAP', 'NO_CHANGE') THEN 'Gap-filler' WHEN kind = 'TIE' THEN 'Fork-resolver' ELSE 'Verifier' END AS role FROM i WHERE seed IN (SELECT seed FROM v WHERE verdict <> 'SUFFICIENT')")
def deep_dispatch(s):
    hops = _deep_hops(s)
    stuck = walk.impasses(s, _every(s), hops)
    return walk.dispatch(walk.verdicts(s, _every(s), hops, stuck), stuck)


@on_store("beliefs edges", DEEP_HOPS + ORACLE_SQL["suggested_updates"][ORACLE_SQL["suggested_updates"].index(", a AS (SELECT DISTINCT seed, unnest") :])
def deep_updates(s):
    hops = _deep_hops(s)
    stuck = walk.impasses(s, _every(s), hops)
    return walk.suggestions(s, walk.verdicts(s, _every(s), hops, stuck), hops, stuck)


# ---- packs --------------------------------------------------------------------------------------------------------------


def _candidates(s: Store, k: int = 30) -> DataFrame:
    """The best beliefs of each session by evidence, as candidates of a query."""
    w = Window.partitionBy("session_id").orderBy(F.desc("alpha"), "id")
    rows = s.active.select(F.col("session_id").alias("query_id"), "id", F.col("alpha").alias("score"), scoring.estimated_tokens(F.col("content")).alias("tokens"), (F.col("lock_level") == "user").alias("locked"), F.row_number().over(w).alias("place"))
    return rows.where(F.col("place") <= k)


CANDIDATES = ", c AS (SELECT * FROM (SELECT session_id AS query_id, id, alpha AS score, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, lock_level = 'user' AS locked, row_number() OVER (PARTITION BY session_id ORDER BY alpha DESC, id) AS place FROM beliefs WHERE valid_to IS NULL) q WHERE place <= 30)"


@on_store(
    "beliefs edges",
    CANDIDATES
    + """, u AS (SELECT a.query_id AS q, src AS x, dst AS y FROM edges JOIN c a ON a.id = src JOIN c b ON b.id = dst AND a.query_id = b.query_id WHERE weight >= 0.4), n AS (SELECT q, x, y FROM u UNION SELECT q, y, x FROM u),
    r AS (SELECT query_id AS q, id AS x, id AS root FROM c UNION SELECT n.q, n.y, r.root FROM r JOIN n ON n.q = r.q AND n.x = r.x), g AS (SELECT q, x, min(root) AS root FROM r GROUP BY 1, 2),
    m AS (SELECT c.*, root, row_number() OVER (PARTITION BY query_id, root ORDER BY score DESC, id) - 1 AS member FROM c JOIN g ON q = query_id AND x = id),
    l AS (SELECT query_id, root, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS cluster FROM m WHERE member = 0) SELECT query_id, id, cluster, member FROM m JOIN l USING (query_id, root)""",
)
def candidate_clusters(s):
    return packs.clusters(s, _candidates(s)).select("query_id", "id", "cluster", "member")


ORACLE_SQL["candidate_clusters"] = ORACLE_SQL["candidate_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


@on_store("", None)
def cluster_pack(s):
    return packs.pack_clusters(packs.clusters(s, _candidates(s)), 3000)


@on_store("", None)
def coverage_pack(s):
    """Candidates of each session by the words of its newest belief."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), "id")
    wanted = s.active.select(F.col("session_id").alias("query_id"), F.slice(F.array_sort(F.array_distinct(retrieval.tokens(F.col("content")))), 1, 40).alias("q"), F.row_number().over(w).alias("n")).where("n = 1")
    rows = _candidates(s).join(s.active.select("id", retrieval.tokens(F.col("content")).alias("t")), "id").join(wanted.select("query_id", "q"), "query_id")
    weights = F.map_from_entries(F.transform("q", lambda x: F.struct(x, F.length(x).cast("double"))))
    return packs.pack_coverage(rows.withColumn("covers", F.array_intersect("q", "t")).withColumn("weights", weights), 3000)


@on_store("beliefs", CANDIDATES + " SELECT query_id, id, place, row_number() OVER (PARTITION BY query_id ORDER BY locked, place) AS shown FROM c")
def locks_last_order(s):
    return packs.ordered_for_injection(_candidates(s), "locks_last")


@on_store("beliefs", CANDIDATES + " SELECT query_id, id, place, row_number() OVER (PARTITION BY query_id ORDER BY NOT locked, CASE WHEN locked THEN 0 ELSE -tokens END, place) AS shown FROM c")
def score_order(s):
    """Locks first, the others by a score (here their length)."""
    return packs.ordered_for_injection(_candidates(s).withColumn("score", F.col("tokens").cast("double")), "score_desc")


@on_store("beliefs", CANDIDATES + " SELECT query_id, id, place, place AS shown FROM c")
def lane_order(s):
    """Without any score the order stays that of the lanes."""
    return packs.ordered_for_injection(_candidates(s).withColumn("score", F.lit(None).cast("double")), "score_desc")


@on_store("", None)
def exploration_draw(s):
    """Two of each session's candidates, drawn by a seed of session, number and text."""
    rows = _candidates(s).withColumn("seed", packs.seed_of(F.col("query_id"), F.lit(20), F.lit("what now")))
    return packs.draws(rows, 2)


@on_store(
    "beliefs",
    CANDIDATES
    + """, f AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(tokens) OVER (PARTITION BY query_id) AS total FROM c WHERE NOT locked)
    SELECT query_id, id, place FROM f WHERE freed < 900 AND total >= 900""",
)
def displaced_beliefs(s):
    rows = _candidates(s)
    return packs.displaced(rows, rows.select("query_id").distinct().withColumn("need", F.lit(900)))


# ---- vectors ------------------------------------------------------------------------------------------------------------


@on_store("", None)
def heat_kernel(s):
    """The heat of the best matches of each query after some time; tests hold it against eigenvectors."""
    seeds = vectors.heat_seeds(_matches(s))
    return vectors.heat(s, seeds, 2.0).select("query_id", "i", F.round("s", 6).alias("s"))


def _matches(s: Store) -> DataFrame:
    from .catalog import index_of

    return retrieval.top(index_of(s).match(asked(s)), 40)


def _register_matched() -> None:
    from .catalog import INDEX

    best = INDEX + ", t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM m) r WHERE n <= 25), h AS (SELECT query_id, id, score, score / sum(score) OVER (PARTITION BY query_id) AS s FROM t)"

    @on_store("beliefs", best + " SELECT query_id, id AS i, round(s, 6) AS s FROM h")
    def heat_seeds(s):
        return vectors.heat_seeds(_matches(s)).select("query_id", "i", F.round("s", 6).alias("s"))

    @on_store("beliefs", best + f" SELECT query_id, h.id AS i, round(greatest(s * {MEAN}, 1e-9), 6) AS s, round(ln(score) + ln(greatest(s * {MEAN}, 1e-9)) + 0.5 * ln({MEAN}), 5) AS combined FROM h JOIN beliefs ON beliefs.id = h.id")
    def heat_scores(s):
        """Heat times the mean of its belief, floored, and the score that it makes with match and evidence."""
        hits = _matches(s).select("query_id", F.col("id").alias("i"), "score")
        rows = vectors.attenuated(s, vectors.heat_seeds(_matches(s))).join(hits, ["query_id", "i"]).join(s.active.select(F.col("id").alias("i"), scoring.posterior_mean(F.col("alpha"), F.col("beta")).alias("p")), "i")
        return rows.select("query_id", "i", F.round(F.greatest("s", F.lit(vectors.HEAT_FLOOR)), 6).alias("s"), F.round(vectors.log_combined(F.col("score"), F.col("s"), F.col("p")), 5).alias("combined"))

    @on_store("beliefs", INDEX + " SELECT query_id, count(DISTINCT id) AS hits, count(DISTINCT id) = 0 AS gap FROM (SELECT query_id, id FROM m UNION ALL SELECT 'q0', NULL) u GROUP BY 1")
    def gap_signal(s):
        """Queries and whether nothing matches them."""
        queries = asked(s).unionByName(s.beliefs.sparkSession.createDataFrame([("q0", "zzzqqq")], "query_id string, query string"))
        from .catalog import index_of

        hits = index_of(s).match(queries).groupBy("query_id").agg(F.count("*").alias("hits"))
        return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits")).withColumn("gap", F.col("hits") == 0)


@on_store("edges", "SELECT DISTINCT type AS kind, dst AS target, src AS id FROM edges WHERE type IN ('SUPPORTS', 'IMPLEMENTS') AND CAST(substr(dst, 2) AS BIGINT) % 20 = 0")
def holographic_probe(s):
    """Who has a SUPPORTS or IMPLEMENTS edge to each target divisible by 20, found from the vectors."""
    wanted = s.edges.where("type IN ('SUPPORTS', 'IMPLEMENTS')").select(F.col("type").alias("kind"), F.col("dst").alias("target")).where(F.substring("target", 2, 20).cast("long") % 20 == 0)
    return vectors.probe(s, wanted, 50, dimensions=2048).select("kind", "target", "id")


# ---- scores and policies ------------------------------------------------------------------------------------------------


@on_store(
    "beliefs",
    f"""SELECT id, round(exp(ln(259200.0) + v * (ln(1209600.0) - ln(259200.0))), 2) AS half_life, CAST(round_even(exp(ln(1.0) + v * (ln(10.0) - ln(1.0))), 0) AS BIGINT) AS anchor_weight,
    CAST(round_even(exp(ln(1.0) + v * (ln(6.0) - ln(1.0))), 0) AS BIGINT) AS depth, CAST(round_even(exp(ln(20.0) + v * (ln(320.0) - ln(20.0))), 0) AS BIGINT) AS threshold FROM (SELECT id, {MEAN} AS v FROM beliefs) q""",
)
def meta_decodes(s):
    """What the mean of each belief stands for as the value of a tuning knob."""
    v = scoring.posterior_mean(F.col("alpha"), F.col("beta"))
    return s.beliefs.select("id", F.round(policy.half_life(v), 2).alias("half_life"), policy.anchor_weight(v).alias("anchor_weight"), policy.depth(v).alias("depth"), policy.gate_threshold(v).alias("threshold"))


@on_store(
    "beliefs edges",
    f"""SELECT id, round({MEAN} * 0.7, 6) AS relevance, round(CASE WHEN lock_level <> 'none' THEN greatest({MEAN}, 0.6) ELSE {MEAN} END, 6) AS floored, round({MEAN} * CASE WHEN id IN (SELECT dst FROM edges WHERE type = 'SUPERSEDES') THEN 0.5 ELSE 1 END, 6) AS demoted,
    round({MEAN} * exp(-greatest(0, ({BASE + 2_000_000} - created_at) / 86400.0) / 180.0), 6) AS recent, round(CASE WHEN id IN (SELECT dst FROM edges WHERE type = 'SUPERSEDES') THEN ln(0.4) ELSE 0 END, 6) AS penalty FROM beliefs""",
)
def adjusted_scores(s):
    mean = scoring.posterior_mean(F.col("alpha"), F.col("beta"))
    gone = s.edges.where("type = 'SUPERSEDES'").select(F.col("dst").alias("id"), F.lit(True).alias("gone")).distinct()
    rows = s.beliefs.join(gone, "id", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    made = {
        "relevance": policy.relevance(mean, F.lit(0.7)),
        "floored": policy.locked_floor(mean, F.col("lock_level"), 0.6),
        "demoted": policy.superseded_demotion(mean, F.col("gone"), 0.5),
        "recent": policy.recency(mean, (BASE + 2_000_000 - F.col("created_at")) / 86400.0),
        "penalty": policy.supersession_penalty(F.col("gone"), 0.4),
    }
    return rows.select("id", *(F.round(c, 6).alias(n) for n, c in made.items()))


@on_store("beliefs", f"SELECT id, round(least(1.0, greatest(0.0, seq % 17 / 10.0)) * (0.5 + 0.5 * {MEAN}), 6) AS score, round(least(1.0, greatest(0.0, seq % 17 / 10.0)) * (0.5 + 0.5 * {MEAN}), 6) >= 0.5 AS passes FROM beliefs")
def relevance_floor(s):
    score = F.round(policy.floor_score(F.col("seq") % 17 / 10.0, F.col("alpha"), F.col("beta")), 6)
    return s.beliefs.select("id", score.alias("score"), (score >= 0.5).alias("passes"))


COLLAPSED = r"replace(trim(regexp_replace(content, '\s+', ' ', 'g')), '\"', '''')"


@on_store(
    "beliefs",
    rf"""SELECT id, CASE WHEN rc = 'transient' AND stub_cost <= cost THEN 'stub' WHEN rc = 'snapshot' AND length(head) < length(content) AND ceil(length(head) / 4.0) <= cost THEN 'headline' ELSE 'verbatim' END AS strategy,
    CAST(CASE WHEN rc = 'transient' AND stub_cost <= cost THEN stub_cost WHEN rc = 'snapshot' AND length(head) < length(content) AND ceil(length(head) / 4.0) <= cost THEN ceil(length(head) / 4.0) ELSE cost END AS BIGINT) AS tokens FROM
    (SELECT id, content, CASE WHEN lock_level <> 'none' THEN 'fact' ELSE retention_class END AS rc, ceil(length(content) / 4.0) AS cost, ceil(length('[stub: belief=' || id || ' class=transient]') / 4.0) AS stub_cost,
    CASE WHEN i > 0 AND i <= 240 THEN rtrim(substr(content, 1, i)) || CASE WHEN i < length(content) THEN '…' ELSE '' END WHEN length(content) <= 240 AND i = 0 THEN content
      ELSE rtrim(substr(content, 1, CASE WHEN strpos(reverse(substr(content, 1, 241)), ' ') > 0 AND 241 - strpos(reverse(substr(content, 1, 241)), ' ') > 0 THEN 241 - strpos(reverse(substr(content, 1, 241)), ' ') ELSE 240 END)) || '…' END AS head
    FROM (SELECT *, CASE WHEN regexp_matches(content, '(?s)\.[ \n]') THEN length(regexp_extract(content, '(?s)^(.*?\.)[ \n]', 1)) ELSE 0 END AS i FROM beliefs) p) q""",
)
def compression(s):
    """How each belief is rendered by its retention, never at a higher cost than as it is."""
    made = policy.compressed(F.col("id"), F.col("content"), F.when(F.col("lock_level") != "none", "fact").otherwise(F.col("retention_class")))
    return s.beliefs.select("id", made.alias("c")).select("id", "c.strategy", "c.tokens")


@on_store("beliefs", rf"SELECT id, 'ref ' || id || ': \"' || t || '\"' AS line, CAST(ceil(length('ref ' || id || ': \"' || t || '\"') / 4.0) AS BIGINT) AS tokens FROM (SELECT id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(substr(c, 1, 80)) || '…' END AS t FROM (SELECT id, split_part({COLLAPSED}, '. ', 1) || CASE WHEN contains({COLLAPSED}, '. ') AND strpos({COLLAPSED}, '. ') <= 80 THEN '.' ELSE '' END AS c0, CASE WHEN contains({COLLAPSED}, '. ') AND strpos({COLLAPSED}, '. ') <= 80 THEN split_part({COLLAPSED}, '. ', 1) || '.' ELSE {COLLAPSED} END AS c FROM beliefs WHERE lock_level <> 'none') x) y".replace('\\"', '"'))
def lock_manifest(s):
    """Locks as one line each, and what the line costs."""
    line = policy.manifest_line("ref", F.col("id"), F.col("content"))
    return s.beliefs.where("lock_level <> 'none'").select("id", line.alias("line"), scoring.estimated_tokens(line).alias("tokens"))


# ---- cadences -------------------------------------------------------------------------------------------------------------

TICKS = ", t AS (SELECT session_id, feedback_id, source, row_number() OVER w AS fire, sum(100 + feedback_id % 900) OVER w AS bytes FROM feedback WINDOW w AS (PARTITION BY session_id ORDER BY feedback_id))"


@on_store(
    "feedback",
    TICKS
    + """ SELECT session_id, feedback_id, fire % 15 = 0 AS p1, bytes >= 10000 AS p2, CASE WHEN fire > 5 THEN (bytes - lag(bytes, 5) OVER w) / 5.0 >= 500 ELSE false END AS velocity,
    avg(CASE WHEN source <> 'view' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session_id ORDER BY feedback_id ROWS 9 PRECEDING) >= 0.6 AND fire >= 10 AS substantive FROM t WINDOW w AS (PARTITION BY session_id ORDER BY feedback_id)""",
)
def cadence_policies(s):
    """Which policies fire at each event of a session: every 15th, by bytes in all, by bytes an event, by the share of events that matter."""
    return policy.cadences(s.feedback.select("session_id", "feedback_id", (F.col("source") != "view").alias("matters"), (F.col("feedback_id") % 900 + 100).alias("bytes")))


@on_store(
    "feedback",
    TICKS
    + """, p AS (SELECT session_id, fire % 15 = 0 AS a, fire % 4 = 0 AS b FROM t) SELECT session_id, count(*) FILTER (WHERE a) AS p1, count(*) FILTER (WHERE b) AS p2, count(*) FILTER (WHERE a AND b) AS both_fire, count(*) FILTER (WHERE a = b) AS agree, count(*) AS n FROM p GROUP BY 1""",
)
def cadence_agreement(s):
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("feedback_id"))
    rows = s.feedback.select("session_id", (n % 15 == 0).alias("a"), (n % 4 == 0).alias("b"))
    return policy.agreement(rows, "session_id", "a", "b")


def _register_boundaries() -> None:
    from .catalog_text import SAID, _in, _sayings, _starts

    norm = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))"

    @on_tables(f"WITH {SAID} SELECT id, n <> '' AND length(n) <= 80 AND (n IN {_in(policy.BOUNDARY_PHRASES)} OR {_starts('n', policy.BOUNDARY_PREFIXES)}) AS boundary, trim(text) <> '' AND NOT (n <> '' AND length(n) <= 80 AND (n IN {_in(policy.BOUNDARY_PHRASES)} OR {_starts('n', policy.BOUNDARY_PREFIXES)})) AS substantive FROM (SELECT *, {norm} AS n FROM both_) q")
    def phase_boundaries(spark, sf_dir):
        t = F.col("text")
        return _sayings(spark, sf_dir).select("id", policy.is_boundary(t).alias("boundary"), policy.is_substantive(t).alias("substantive"))


# ---- measures -----------------------------------------------------------------------------------------------------------


def _rankings(s: Store) -> tuple[DataFrame, DataFrame]:
    def by(order) -> DataFrame:
        return s.active.select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy(order, "id")).alias("place")).where("place <= 10")

    return by(F.desc("alpha")), by(F.desc("beta"))


RANKED = ", a AS (SELECT * FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY alpha DESC, id) AS place FROM beliefs WHERE valid_to IS NULL) q WHERE place <= 10), b AS (SELECT * FROM (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY beta DESC, id) AS place FROM beliefs WHERE valid_to IS NULL) q WHERE place <= 10)"


@on_store("beliefs", RANKED + " SELECT a.session_id, round(count(*) FILTER (WHERE a.id = b.id) / 5.0, 6) AS overlap FROM a LEFT JOIN b ON a.session_id = b.session_id AND a.place = b.place WHERE a.place <= 5 GROUP BY 1")
def ordered_overlap(s):
    one, other = _rankings(s)
    return metrics.top_overlap(one, other, "session_id", "id", 5)


RBO = """, d AS (SELECT session_id, least(max(a.place), max(b.place)) AS depth FROM a JOIN b USING (session_id) GROUP BY 1), m AS (SELECT a.session_id, greatest(a.place, b.place) AS at FROM a JOIN b USING (session_id, id)),
    g AS (SELECT session_id, depth, unnest(range(1, depth + 1)) AS k FROM d), w AS (SELECT session_id, depth, k, (SELECT count(*) FROM m WHERE m.session_id = g.session_id AND m.at <= k) * 1.0 / k AS agreement FROM g)
    SELECT session_id, round(max(CASE WHEN k = depth THEN agreement END) * pow(0.9, max(depth)) + 0.1 * sum(pow(0.9, k - 1) * agreement), 6) AS rbo FROM w GROUP BY 1"""


@on_store("beliefs", RANKED + RBO)
def rank_biased_overlap(s):
    one, other = _rankings(s)
    return metrics.rank_biased_overlap(one, other, "session_id", "id", 0.9)


@on_store("beliefs", RANKED + RBO.replace("SELECT session_id, round(max(CASE", ", r AS (SELECT session_id, round(max(CASE") + "), o AS (SELECT a.session_id, round(count(*) FILTER (WHERE a.id = b.id) / 5.0, 6) AS overlap FROM a LEFT JOIN b ON a.session_id = b.session_id AND a.place = b.place WHERE a.place <= 5 GROUP BY 1) SELECT count(*) AS panels, round(avg(rbo), 6) AS rbo, round(avg(overlap), 6) AS overlap FROM r JOIN o USING (session_id)")
def ranking_panel(s):
    one, other = _rankings(s)
    rows = metrics.rank_biased_overlap(one, other, "session_id", "id", 0.9).join(metrics.top_overlap(one, other, "session_id", "id", 5), "session_id")
    return rows.agg(F.count("*").alias("panels"), F.round(F.avg("rbo"), 6).alias("rbo"), F.round(F.avg("overlap"), 6).alias("overlap"))


# ---- consolidation ----------------------------------------------------------------------------------------------------------


@on_store(
    "beliefs",
    """, c AS (SELECT id, content_hash, type FROM beliefs), p AS (SELECT a.id AS x, b.id AS y FROM c a JOIN c b ON a.content_hash = b.content_hash AND a.id < b.id), n AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
    r AS (SELECT DISTINCT x AS id, x AS root FROM n UNION SELECT n.y, r.root FROM r JOIN n ON n.x = r.id), g AS (SELECT id, min(root) AS root FROM r GROUP BY 1) SELECT root AS representative, count(*) AS members, count(*) - 1 AS would_remove FROM g GROUP BY 1""",
)
def duplicate_clusters(s):
    """Groups of beliefs that say the same, and what merging them would remove."""
    rows = s.beliefs.select("content_hash", "id")
    first = rows.groupBy("content_hash").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return similarity.clusters(rows.join(first, "content_hash").where("id <> a").select("a", F.col("id").alias("b")))


ORACLE_SQL["duplicate_clusters"] = ORACLE_SQL["duplicate_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


@on_store(
    "beliefs feedback",
    """, p AS (SELECT DISTINCT least(a.belief_id, b.belief_id) AS x, greatest(a.belief_id, b.belief_id) AS y FROM feedback a JOIN feedback b ON a.session_id = b.session_id AND b.feedback_id = a.feedback_id + 150 AND a.belief_id <> b.belief_id)
    SELECT sha256('wonder_ingest:' || x || ':' || y || '|walk') AS content_hash, x, y FROM p WHERE x IN (SELECT id FROM beliefs) AND y IN (SELECT id FROM beliefs)""",
)
def phantom_ingest(s):
    """Phantoms of pairs of beliefs that a session touched one round apart, by the key of their parts."""
    a = s.feedback.select("session_id", "feedback_id", F.col("belief_id").alias("a"))
    b = s.feedback.select("session_id", (F.col("feedback_id") - 150).alias("feedback_id"), F.col("belief_id").alias("b"))
    pairs = a.join(b, ["session_id", "feedback_id"]).where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    return policy.phantoms(s, pairs, "walk")


_register_matched()
_register_boundaries()
