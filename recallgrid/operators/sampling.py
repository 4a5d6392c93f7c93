"""Draws from the store: walks from uncertain beliefs, and compositions across sessions.

Random numbers are digests of what they are for (seed, walk, step), so that draws are the same for any partitioning and can be made
again after a task is lost. Uniform choices go by number: rows are numbered by scans over ranges, and a drawn number is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import beta_entropy
from ..sources.model import Store
from .scan import Ranges

# Fixed values.
ENTROPY_FLOOR, WALK_DEPTH, COMPOSITION = -0.5, 2, 2


def uniform(*of: str | Column) -> Column:
    """A number from 0 to below 1 by a digest of its arguments."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *of).cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


def chosen(n: Column | str, *of: str | Column) -> Column:
    """A number from 1 to ``n``."""
    return F.floor(uniform(*of) * (F.col(n) if isinstance(n, str) else n)).cast("long") + 1


def uncertain(store: Store, floor: float = ENTROPY_FLOOR) -> DataFrame:
    """The beliefs whose evidence has an entropy of ``floor`` or more, numbered in order of their ids (``id``, ``number``)."""
    entropy = F.round(beta_entropy(F.col("alpha"), F.col("beta")), 6)
    return Ranges(store.beliefs.where(entropy >= floor).select("id"), [], [F.col("id")]).places("number")


def random_walks(store: Store, walks: Column | int, seed: str, depth: int = WALK_DEPTH, floor: float = ENTROPY_FLOOR) -> DataFrame:
    """Bundles of beliefs (``composition``, ``seed_id``, ``cost``) met on walks from uncertain beliefs; the ids of a bundle in order.

    Each walk begins at a belief drawn with replacement and takes ``depth`` outgoing edges, each drawn uniformly from those of its
    belief; one without edges ends it. Its cost is all beliefs it touched, again or not. Bundles of one belief are dropped; of
    equal bundles that of the first walk stays. ``walks``: how many, a number or an expression of ``n``, the number of uncertain beliefs.

    The edges of a belief are numbered over ranges, and a drawn edge is joined by belief and number, so that a hub's edges are never
    in one task and its walks meet in as many keys as it has edges.
    """
    starts = uncertain(store, floor)
    total = starts.agg(F.count("*").alias("n"))
    drawn = total.select("n", F.explode(F.sequence(F.lit(1), F.greatest((walks if isinstance(walks, Column) else F.lit(walks)).cast("int"), F.lit(1)))).alias("walk")).where("n > 0")
    state = drawn.select("walk", chosen("n", F.lit(seed), "walk", F.lit("0")).alias("number")).join(starts, "number")
    state = state.select("walk", F.col("id").alias("seed_id"), F.col("id").alias("at"), F.array("id").alias("met"), F.lit(1).alias("cost"))
    edges = Ranges(store.edges.select("src", "dst", "type").distinct(), ["src"], [F.col("dst"), F.col("type")]).places("number")
    degrees = store.edges.select("src", "dst", "type").distinct().groupBy("src").agg(F.count("*").alias("degree"))
    for step in range(1, depth + 1):
        state = state.join(degrees.withColumnRenamed("src", "at"), "at", "left")
        state = state.withColumn("number", chosen("degree", F.lit(seed), "walk", F.lit(str(step)))).drop("degree")
        state = state.join(edges.select(F.col("src").alias("at"), "number", F.col("dst").alias("to")), ["at", "number"], "left")
        state = state.select("walk", "seed_id", F.coalesce("to", F.lit("")).alias("at"), F.when(F.col("to").isNull(), F.col("met")).otherwise(F.concat("met", F.array("to"))).alias("met"), (F.col("cost") + F.col("to").isNotNull().cast("int")).alias("cost"))
    bundles = state.select("walk", "seed_id", "cost", F.array_sort(F.array_distinct("met")).alias("composition")).where(F.size("composition") >= 2)
    first = bundles.groupBy("composition").agg(F.min(F.struct("walk", "seed_id", "cost")).alias("f"))
    return first.select("composition", "f.seed_id", "f.cost")


def session_compositions(store: Store, samples: int, seed: str, size: int = COMPOSITION) -> DataFrame:
    """Compositions (``composition``, ``cost``) of ``size`` beliefs from different sessions; beliefs without a session take no part.

    Each sample draws sessions uniformly without replacement: its i-th draw is among those that are left, by number. A session's
    beliefs stand by keyed priorities, and draws take them in that order, each once until all are used up and then from the
    first again. Only as many of a session as were ever drawn are needed: tasks keep their least priorities before anything
    moves, and what they keep is merged.
    """
    if size < 2:
        raise ValueError("a composition has two beliefs at least")
    beliefs = store.beliefs.where("session_id IS NOT NULL AND session_id <> ''").select("session_id", "id")
    sizes = beliefs.groupBy("session_id").agg(F.count("*").alias("held"))
    numbered = Ranges(sizes, [], [F.col("session_id")]).places("number")
    total = numbered.agg(F.count("*").alias("n")).where(F.col("n") >= size)
    drawn = total.select("n", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    # The i-th number is among n - i; it moves up past each number drawn before that isn't greater, least first.
    taken: list[Column] = []
    for i in range(size):
        number = chosen(F.col("n") - i, F.lit(seed), F.col("sample"), F.lit(str(i)))
        taken.append(reduce(lambda x, t: x + (x >= t).cast("long"), [F.array_sort(F.array(*taken))[k] for k in range(i)], number))
        drawn = drawn.withColumn(f"_t{i}", taken[-1])
        taken[-1] = F.col(f"_t{i}")
    draws = drawn.select("sample", F.posexplode(F.array(*taken)).alias("slot", "number")).join(numbered, "number")
    draws = Ranges(draws.select("session_id", "held", "sample", "slot"), ["session_id"], [F.col("sample"), F.col("slot")]).places("nth")
    most = draws.agg(F.max("nth")).first()[0] or 0
    priority = F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary"))
    least = beliefs.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy(priority, "id"))).where(F.col("nth") <= most)
    rows = draws.withColumn("nth", F.pmod(F.col("nth") - 1, F.col("held")) + 1).join(least, ["session_id", "nth"])
    found = rows.groupBy("sample").agg(F.array_sort(F.collect_set("id")).alias("composition")).where(F.size("composition") == size)
    return found.select("composition", F.lit(float(size)).alias("cost")).distinct()
