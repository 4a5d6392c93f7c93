"""Walks in which the order of steps counts: greedy expansion with budgets, valence with a cap, the session spine, and what
conclusions are drawn from walks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import posterior_mean
from ..sources.model import Store
from .graph import VALENCE, WALK, weight_of

# Fixed values.
DEPTH, PER_NODE, TOTAL, LEAST_SCORE = 2, 16, 32, 0.10
VALENCE_HOPS, VALENCE_FLOOR = 3, 0.05
FEW_TRIALS, CLOSE_MEANS, TIE_FLOOR, TIE_TOLERANCE = 4, 0.15, 0.10, 0.20


def steps(store: Store, most: int) -> DataFrame:
    """For each belief the edges a walk may take from it (``node``, ``out``), best first, SUPERSEDES against its direction: by type weight, edge
    weight and id, each target once. Of a hub only the first ``most`` can ever be taken."""
    back = F.col("type") == "SUPERSEDES"
    e = store.edges.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("node"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("to"), "type", "weight")
    e = e.withColumn("w", weight_of(F.col("type"), WALK))
    best = e.groupBy("node", "to").agg(F.max(F.struct("w", "weight", "type")).alias("b")).select("node", "to", "b.*")
    n = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), F.desc("weight"), "to"))
    live = store.active.select(F.col("id").alias("to"), F.lit(True).alias("live"))
    top = best.withColumn("n", n).where(F.col("n") <= most).join(live, "to", "left").withColumn("live", F.coalesce("live", F.lit(False)))
    return top.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "to", "w", "type", "live"))).alias("out"))


_STATE = "seed string, visited array<string>, used int, front array<struct<node:string,score:double,trail:array<string>,kinds:array<string>>>"
_HOPS = "seed string, node string, score double, depth int, trail array<string>, kinds array<string>"


def expand(store: Store, seeds: DataFrame, depth: int = DEPTH, per_node: int = PER_NODE, total: int = TOTAL, least: float = LEAST_SCORE) -> DataFrame:
    """Greedy breadth-first expansion of each seed (``seed``): nodes are claimed in order, the best ``per_node`` steps of each, ``total`` in all.

    Each hop joins the frontiers with the steps and claims in a kernel, one seed at a time; a seed's state is bounded by the
    budgets: ``total`` nodes in the frontier, ``per_node`` looked at from each.
    """
    ways = steps(store, per_node + 1 + depth * total * per_node)

    def claim(hop: int):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    visited, used = set(row["visited"]), row["used"]
                    front, hops = [], []
                    for here in sorted(row["here"], key=lambda h: h["pos"]):
                        looked = 0
                        for step in here["out"] or []:
                            if looked == per_node or used >= total:
                                break
                            if step["to"] in visited:
                                continue
                            looked += 1
                            score = here["score"] * step["w"]
                            if step["w"] == 0.0 or score < least:
                                continue
                            visited.add(step["to"])
                            if step["live"]:
                                found = {"node": step["to"], "score": score, "trail": [*here["trail"], step["to"]], "kinds": [*here["kinds"], step["type"]]}
                                front.append(found)
                                hops.append(found | {"depth": hop})
                                used += 1
                    out.append({"seed": row["seed"], "visited": sorted(visited), "used": used, "front": front, "hops": hops})
                yield pa.RecordBatch.from_pylist(out, schema)

        return kernel

    step_type = [("node", pa.string()), ("score", pa.float64()), ("trail", pa.list_(pa.string())), ("kinds", pa.list_(pa.string()))]
    schema = pa.schema([("seed", pa.string()), ("visited", pa.list_(pa.string())), ("used", pa.int32()), ("front", pa.list_(pa.struct(step_type))), ("hops", pa.list_(pa.struct([*step_type, ("depth", pa.int32())])))])
    made = f"{_STATE}, hops array<struct<node:string,score:double,trail:array<string>,kinds:array<string>,depth:int>>"
    state = seeds.select("seed", F.array("seed").alias("visited"), F.lit(0).alias("used"), F.array(F.struct(F.col("seed").alias("node"), F.lit(1.0).alias("score"), F.array("seed").alias("trail"), F.array().cast("array<string>").alias("kinds"))).alias("front"))
    found = None
    for hop in range(1, depth + 1):
        at = state.select("seed", F.posexplode("front").alias("pos", "f")).select("seed", "pos", "f.*")
        at = at.join(ways, "node", "left").groupBy("seed").agg(F.collect_list(F.struct("pos", "score", "trail", "kinds", "out")).alias("here"))
        state = state.select("seed", "visited", "used").join(at, "seed").mapInArrow(claim(hop), made)
        hops = state.select("seed", F.explode("hops").alias("h")).select("seed", "h.node", "h.score", "h.depth", "h.trail", "h.kinds")
        found = hops if found is None else found.unionByName(hops)
        state = state.drop("hops")
    return found


def propagate_valence(store: Store, sources: DataFrame, hops: int = VALENCE_HOPS, floor: float = VALENCE_FLOOR) -> DataFrame:
    """What each event (``src``, ``valence``) does to beliefs near it (``src``, ``id``, ``delta``), at most ``hops`` times its valence in all.

    A hop multiplies by the edge type's valence and the mean of the belief it leaves. A belief is reached once, by its largest
    delta in the first hop that reaches it; the strongest go first, until the mass is used up.
    """
    mean = F.when(F.col("alpha") + F.col("beta") > 0, F.col("alpha") / (F.col("alpha") + F.col("beta"))).otherwise(0.0)
    live = store.active.select("id", mean.alias("broker"))
    ways = store.edges.withColumn("m", weight_of(F.col("type"), VALENCE)).where("m <> 0")
    ways = ways.join(live.select(F.col("id").alias("dst")), "dst", "left_semi").join(live.withColumnRenamed("id", "src"), "src")
    ways = ways.select(F.col("src").alias("node"), F.col("dst").alias("to"), (F.col("m") * F.col("broker")).alias("m"))
    front = sources.groupBy("src").agg(F.sum("valence").alias("valence")).select("src", F.col("src").alias("node"), F.col("valence").alias("carried"), (F.abs("valence") * hops).alias("cap"))
    used = front.select("src", F.lit(0.0).alias("mass"))
    reached = None
    for _ in range(hops):
        reach = front.where(F.abs("carried") >= floor).join(ways, "node").where("to <> src").select("src", "cap", F.col("to").alias("id"), (F.col("carried") * F.col("m")).alias("delta")).where(F.abs("delta") >= floor)
        if reached is not None:
            reach = reach.join(reached.select("src", "id"), ["src", "id"], "left_anti")
        # The first of a belief's deltas in the order of candidates: the largest; equal ones differ in sign alone.
        best = reach.groupBy("src", "cap", "id").agg(F.max(F.struct(F.abs("delta").alias("size"), "delta"))["delta"].alias("delta"))
        w = Window.partitionBy("src").orderBy(F.desc(F.abs("delta")), "id").rowsBetween(Window.unboundedPreceding, -1)
        rows = best.withColumn("before", F.coalesce(F.sum(F.abs("delta")).over(w), F.lit(0.0))).join(used, "src")
        left = F.col("cap") - F.col("mass") - F.col("before")
        rows = rows.withColumn("size", F.least(F.abs("delta"), left)).where((left > 1e-12) & (F.col("size") >= floor))
        here = rows.select("src", "id", (F.signum("delta") * F.col("size")).alias("delta"), "cap")
        used = used.join(here.groupBy("src").agg(F.sum(F.abs("delta")).alias("more")), "src", "left").select("src", (F.col("mass") + F.coalesce("more", F.lit(0.0))).alias("mass"))
        front = here.select("src", F.col("id").alias("node"), F.col("delta").alias("carried"), "cap")
        reached = here.drop("cap") if reached is None else reached.unionByName(here.drop("cap"))
    return reached.select("src", "id", F.round("delta", 6).alias("delta"))


def spine_neighbours(store: Store, seeds: DataFrame, budget: int = 32) -> DataFrame:
    """Active beliefs next to seeds (``group``, ``pos``, ``seed``) on the session spine, in order: by seed, successors before predecessors, id."""
    e = store.edges.where("type = 'TEMPORAL_NEXT'")
    near = e.select(F.col("dst").alias("seed"), F.col("src").alias("id"), F.lit(0).alias("side")).unionByName(e.select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.lit(1).alias("side")))
    rows = seeds.join(near, "seed").join(seeds.select("group", F.col("seed").alias("id")), ["group", "id"], "left_anti")
    first = rows.groupBy("group", "id").agg(F.min(F.struct("pos", "side")).alias("k")).join(store.active.select("id"), "id", "left_semi")
    w = Window.partitionBy("group").orderBy("k.pos", "k.side", "id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget).select("group", "id", "place")


# ---- conclusions ------------------------------------------------------------------------------------------------------------


def _means(store: Store) -> DataFrame:
    return store.beliefs.select("id", posterior_mean(F.col("alpha"), F.col("beta")).alias("mean"), (F.col("alpha") + F.col("beta") < FEW_TRIALS).alias("low"), (F.col("lock_level") == "user").alias("locked"))


def paths(store: Store, hops: DataFrame) -> DataFrame:
    """For each hop (``seed``, ``node``, ``trail``, ``kinds``) the product of means along its trail, its weakest belief (the last of equals) and the belief it forks from."""
    each = hops.select("seed", "node", F.posexplode("trail").alias("pos", "id")).join(_means(store).select("id", "mean"), "id")
    g = each.groupBy("seed", "node").agg(F.product("mean").alias("compound"), F.min_by("id", F.struct("mean", -F.col("pos"))).alias("weakest"))
    forks = F.when(F.element_at("kinds", -1) == "CONTRADICTS", F.element_at("trail", -2))
    return hops.select("seed", "node", F.size("kinds").alias("depth"), forks.alias("fork_from")).join(g, ["seed", "node"]).select("seed", "node", "depth", F.round("compound", 6).alias("compound"), "weakest", "fork_from")


def impasses(store: Store, seeds: DataFrame, hops: DataFrame) -> DataFrame:
    """Where the walks of seeds get stuck: (``seed``, ``kind``, ``ids``). NO_CHANGE without hops or without evidence; CONSTRAINT_FAILURE at a
    contradicting lock; TIE of contradicting beliefs with close means or of forks with close products; GAP at a leaf without evidence."""
    means = _means(store)
    at = hops.select("seed", F.col("node").alias("id"), F.element_at("kinds", -1).alias("kind")).join(means, "id")
    ids = F.array_join(F.array_sort(F.collect_list("id")), " ")
    none = seeds.join(hops.select("seed"), "seed", "left_anti").select("seed", F.lit("NO_CHANGE").alias("kind"), F.col("seed").alias("ids"))
    own = seeds.select("seed").join(means.select(F.col("id").alias("seed"), F.col("low").alias("seed_low")), "seed")
    low = at.groupBy("seed").agg(F.bool_and("low").alias("all_low"), ids.alias("ids")).join(own, "seed").where("all_low AND seed_low").select("seed", F.lit("NO_CHANGE").alias("kind"), "ids")
    contra = at.where("kind = 'CONTRADICTS'")
    blocked = contra.where("locked").select("seed", F.lit("CONSTRAINT_FAILURE").alias("kind"), F.col("id").alias("ids"))
    other = contra.select("seed", F.col("id").alias("o"), F.col("mean").alias("m"))
    pairs = contra.join(other, "seed").where("id < o").where(F.abs(F.col("mean") - F.col("m")) < CLOSE_MEANS)  # a seed has TOTAL hops at most
    ties = pairs.select("seed", F.lit("TIE").alias("kind"), F.concat_ws(" ", "id", "o").alias("ids"))
    leaf = at.where("low").join(store.edges.select(F.col("src").alias("id")), "id", "left_anti").select("seed", F.lit("GAP").alias("kind"), F.col("id").alias("ids"))
    p = paths(store, hops).where("fork_from IS NOT NULL").select("seed", "fork_from", F.col("node").alias("id"), "compound")
    q = p.select("seed", "fork_from", F.col("id").alias("o"), F.col("compound").alias("c"))
    close = (F.greatest("compound", "c") >= TIE_FLOOR) & (F.abs(F.col("compound") - F.col("c")) <= TIE_TOLERANCE * F.greatest("compound", "c"))
    forked = p.join(q, ["seed", "fork_from"]).where("id < o").where(close).select("seed", F.lit("TIE").alias("kind"), F.concat_ws(" ", "id", "o").alias("ids"))
    return none.unionByName(low).unionByName(blocked).unionByName(ties).unionByName(leaf).unionByName(forked)


def verdicts(store: Store, seeds: DataFrame, hops: DataFrame, stuck: DataFrame) -> DataFrame:
    """One verdict for each seed: CONTRADICTORY, INSUFFICIENT, PARTIAL, UNCERTAIN or SUFFICIENT, in this order of precedence."""
    sure = hops.select("seed", F.col("node").alias("id")).join(_means(store), "id").groupBy("seed").agg(F.bool_or(~F.col("low")).alias("sure"))
    has = stuck.groupBy("seed").agg(*(F.bool_or(F.col("kind") == k).alias(k) for k in ("TIE", "NO_CHANGE", "CONSTRAINT_FAILURE", "GAP")), F.count("*").alias("n"))
    rows = seeds.select("seed").join(has, "seed", "left").join(sure, "seed", "left").na.fill(False)
    verdict = (
        F.when(F.col("TIE"), "CONTRADICTORY")
        .when(F.col("NO_CHANGE"), "INSUFFICIENT")
        .when(F.col("CONSTRAINT_FAILURE"), "PARTIAL")
        .when(F.col("GAP") & ~F.col("sure"), "UNCERTAIN")
        .when(F.col("n").isNotNull() & F.col("sure"), "PARTIAL")
        .otherwise("SUFFICIENT")
    )
    return rows.select("seed", verdict.alias("verdict"))


def dispatch(verdict: DataFrame, stuck: DataFrame) -> DataFrame:
    """Who deals with each impasse of a seed whose verdict isn't SUFFICIENT."""
    role = F.when(F.col("kind").isin("GAP", "NO_CHANGE"), "Gap-filler").when(F.col("kind") == "TIE", "Fork-resolver").otherwise("Verifier")
    return stuck.join(verdict.where("verdict <> 'SUFFICIENT'"), "seed", "left_semi").select("seed", "kind", "ids", role.alias("role"))


def suggestions(store: Store, verdict: DataFrame, hops: DataFrame, stuck: DataFrame) -> DataFrame:
    """For each seed the beliefs to confirm (+1: with evidence, in no impasse) and those in question (?)."""
    asked = stuck.select("seed", F.explode(F.split("ids", " ")).alias("id")).distinct()
    fine = hops.select("seed", F.col("node").alias("id")).distinct().join(verdict.where("verdict <> 'INSUFFICIENT'"), "seed", "left_semi")
    fine = fine.join(asked, ["seed", "id"], "left_anti").join(_means(store).where("NOT low").select("id"), "id", "left_semi")
    return fine.select("seed", "id", F.lit("+1").alias("direction")).unionByName(asked.select("seed", "id", F.lit("?").alias("direction")))
