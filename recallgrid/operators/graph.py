"""Walks and spreads over the typed edge graph, and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import new_folder
from ..sources.model import Store

#: The weight of an edge type on a walk, its valence, and its sign in the Laplacian.
WALK = {"SUPERSEDES": 0.90, "CONTRADICTS": 0.85, "DERIVED_FROM": 0.70, "IMPLEMENTS": 0.65, "SUPPORTS": 0.60, "TESTS": 0.55, "CITES": 0.40, "RELATES_TO": 0.30, "TEMPORAL_NEXT": 0.25}
VALENCE = {"SUPPORTS": 1.0, "CITES": 0.5, "CONTRADICTS": -0.5, "SUPERSEDES": 0.0, "RELATES_TO": 0.3, "DERIVED_FROM": 0.5, "IMPLEMENTS": 0.65, "TEMPORAL_NEXT": 0.2, "TESTS": 0.55, "RESOLVES": 0.0}
LAPLACIAN = {"SUPPORTS": 1.0, "CITES": 1.0, "RELATES_TO": 1.0, "DERIVED_FROM": 1.0, "CONTRADICTS": -1.0, "SUPERSEDES": -0.5}


def weight_of(kind: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(kind == name, w).otherwise(out)
    return out


def walk_edges(store: Store) -> DataFrame:
    """Edges as they are walked, with their type's weight; SUPERSEDES against its direction."""
    e = store.edges.withColumn("w", weight_of(F.col("type"), WALK)).where("w > 0")
    back = F.col("type") == "SUPERSEDES"
    return e.select(F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"), "w")


def reachable(store: Store, seeds: DataFrame, depth: int = 2, least: float = 0.10) -> DataFrame:
    """Active beliefs within ``depth`` steps of ``seeds`` (``seed``) with their best path score, the product of type weights.

    The set-based form of the walk: every path whose score stays at ``least`` or more counts. Each hop keeps the best score
    of a (seed, node) before the next, so that rows don't multiply with the number of paths.
    """
    edges = walk_edges(store).groupBy("src", "dst").agg(F.max("w").alias("w")).join(store.active.select(F.col("id").alias("dst")), "dst", "left_semi")
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(1.0).alias("score"))
    out = None
    for _ in range(depth):
        front = front.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), (F.col("score") * F.col("w")).alias("score"))
        front = front.where(F.col("score") >= least).groupBy("seed", "node").agg(F.max("score").alias("score"))
        out = front if out is None else out.unionByName(front)
    return out.where("seed <> node").groupBy("seed", "node").agg(F.round(F.max("score"), 6).alias("score"))


def top_reached(store: Store, seeds: DataFrame, per_seed: int, **more) -> DataFrame:
    """The best ``per_seed`` nodes of each seed; ties by id."""
    w = Window.partitionBy("seed").orderBy(F.desc("score"), "node")
    return reachable(store, seeds, **more).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_seed)


def propagate(store: Store, hop_decay: float = 0.5) -> DataFrame:
    """Valence of feedback spread one step: the sum of a belief's valences times the valence of its edges' types, summed at the targets."""
    own = store.feedback.groupBy(F.col("belief_id").alias("src")).agg(F.sum("valence").alias("v"))
    spread = store.edges.withColumn("f", weight_of(F.col("type"), VALENCE)).where("f <> 0").join(own, "src")
    return spread.groupBy(F.col("dst").alias("id")).agg(F.round(F.sum(F.col("v") * F.col("f") * hop_decay), 6).alias("delta"))


def marker_rerank(store: Store, hops: DataFrame, penalties: dict[str, float]) -> DataFrame:
    """Scores of ``hops`` (``node``, ``score``) times the penalty of each type of marker edge that comes in."""
    marks = store.edges.where(F.col("type").isin(*penalties)).select(F.col("dst").alias("node"), "type").distinct()
    factor = marks.groupBy("node").agg(F.product(weight_of(F.col("type"), penalties)).alias("factor"))
    return hops.join(factor, "node", "left").withColumn("score", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 6)).drop("factor")


def signed_laplacian(store: Store, places: int | None = 6) -> DataFrame:
    """Entries (``i``, ``j``, ``v``) off the diagonal of I - D^-1/2 W D^-1/2, where W is symmetric and D has absolute row sums; rounded to so many
    places, or not at all."""
    e = store.edges.withColumn("w", weight_of(F.col("type"), LAPLACIAN) * F.col("weight")).where("w <> 0 AND src <> dst")
    both = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w").unionByName(e.select(F.col("dst").alias("i"), F.col("src").alias("j"), "w"))
    w = both.groupBy("i", "j").agg(F.sum("w").alias("w"))
    degree = w.groupBy("i").agg(F.sum(F.abs("w")).alias("d"))
    out = w.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j").where("d > 0 AND dj > 0")
    value = -F.col("w") / F.sqrt(F.col("d") * F.col("dj"))
    return out.select("i", "j", (value if places is None else F.round(value, places)).alias("v"))


def heat_step(store: Store, heat: DataFrame, time: float) -> DataFrame:
    """``heat`` (``i``, ``s``) after a first-order step of exp(-time * L): s - time * (s + L's other entries times s)."""
    flow = signed_laplacian(store).join(heat.select(F.col("i").alias("j"), "s"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("s")).alias("in"))
    both = heat.join(flow, "i", "full_outer").select("i", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("in", F.lit(0.0)).alias("in"))
    return both.select("i", F.round(F.col("s") - time * (F.col("s") + F.col("in")), 6).alias("s"))


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``root``): the least node that each node of ``edges`` (``a``, ``b``) reaches.

    Alternating large-star and small-star steps (Kiveris et al. 2014) hang every node below smaller ones until nothing
    changes; the rounds grow with the logarithm of the longest path, not with its length.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(new_folder(spark, "checkpoints"))
    edges = edges.select("a", "b").distinct().checkpoint()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        if new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
            break
        now = new
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL").distinct()
    return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def superposition(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """The element-wise sum of the vectors of each group: (``by``, ``k``, ``v``)."""
    return rows.select(by, F.posexplode(vector).alias("k", "x")).groupBy(by, "k").agg(F.round(F.sum(F.col("x").cast("double")), 4).alias("v"))
