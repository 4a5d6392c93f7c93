"""Choices among the candidates of one query: clusters, packs under a budget, draws, and the order they are shown in.

Candidates (``query_id``, ``id``, ``score``, ``tokens``) are the few best of each query, so one task takes a query's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.model import Store
from .graph import components

# Fixed values.
EDGE_FLOOR, DIVERSITY = 0.4, 3
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_MASK = (1 << 64) - 1


def clusters(store: Store, candidates: DataFrame, floor: float = EDGE_FLOOR) -> DataFrame:
    """Candidates with their cluster in the graph of edges between candidates of the query: ``cluster`` counts from 0 by the best score of each
    (ties by its id), ``member`` from 0 by score and id."""
    e = store.edges.where(F.col("weight") >= floor).select("src", "dst")
    a = candidates.select("query_id", F.col("id").alias("src"))
    inside = e.join(a, "src").join(candidates.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"])
    key = lambda c: F.concat_ws("\0", F.col("query_id").cast("string"), c)
    found = components(inside.select(key("src").alias("a"), key("dst").alias("b"))).withColumnRenamed("id", "_key")
    rows = candidates.withColumn("_key", key("id")).join(found, "_key", "left").withColumn("root", F.coalesce("root", "_key")).drop("_key")
    within = Window.partitionBy("query_id", "root").orderBy(F.desc("score"), "id")
    rows = rows.withColumn("member", F.row_number().over(within) - 1)
    lead = rows.where("member = 0").select("query_id", "root", (F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")) - 1).alias("cluster"))
    return rows.join(lead, ["query_id", "root"]).drop("root")


def pack_clusters(clustered: DataFrame, budget: int, diversity: int = DIVERSITY) -> DataFrame:
    """Clustered candidates under a token budget: the best of each of the first clusters, then all by cluster as they fit.

    A first member that doesn't fit ends the first pass; in the second what doesn't fit is passed over.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cluster", "member"])
        taken, used = [], 0
        for r in rows[rows.member == 0].head(diversity).itertuples():
            if used + r.tokens > budget:
                break
            taken.append(r.id)
            used += r.tokens
        for r in rows.itertuples():
            if r.id not in taken and used + r.tokens <= budget:
                taken.append(r.id)
                used += r.tokens
        return pd.DataFrame({"query_id": rows.query_id.iloc[0], "id": taken, "place": range(1, len(taken) + 1)})

    kind = clustered.schema["query_id"].dataType.simpleString()
    return clustered.select("query_id", "id", "cluster", "member", "tokens").groupBy("query_id").applyInPandas(pack, f"query_id {kind}, id string, place int")


def pack_coverage(candidates: DataFrame, budget: int) -> DataFrame:
    """Candidates (with ``covers``: array of the query's terms they have, and ``weights``: map of terms to weights) that cover most for their tokens.

    Greedy by what a candidate adds, times the share of ranks at or below its own, by token; ties by rank. Where the best
    single candidate covers more than all chosen, it stands alone. Comes out by rank (score, then id).
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        n, weights = len(rows), dict(rows.weights.iloc[0])
        covers = [frozenset(c) for c in rows.covers]
        tokens = rows.tokens.tolist()
        value = lambda terms: sum(weights.get(t, 0.0) for t in sorted(terms))
        covered, used, chosen, left = frozenset(), 0, [], set(range(n))
        while left:
            left = {i for i in left if used + tokens[i] <= budget}
            if not left:
                break
            best = min(left, key=lambda i: (-value(covers[i] - covered) * (n - i) / n / max(tokens[i], 1), i))
            chosen.append(best)
            left.remove(best)
            covered |= covers[best]
            used += tokens[best]
        single = max((i for i in range(n) if tokens[i] <= budget), key=lambda i: (value(covers[i]), -i), default=None)
        if single is not None and value(covers[single]) > value(covered):
            chosen = [single]
        return pd.DataFrame({"query_id": rows.query_id.iloc[0], "id": [rows.id[i] for i in sorted(chosen)]})

    kind = candidates.schema["query_id"].dataType.simpleString()
    rows = candidates.select("query_id", "id", "score", "tokens", "covers", "weights")
    return rows.groupBy("query_id").applyInPandas(pack, f"query_id {kind}, id string")


def ordered_for_injection(packed: DataFrame, policy: str) -> DataFrame:
    """``packed`` (``query_id``, ``id``, ``place``, ``locked``, ``score`` or null) with its place under a policy: ``lane`` as it is, ``locks_last``, or
    ``score_desc`` (locks first, then by score); without any scores the last is the first."""
    keys: list[Column] = [F.lit(0)]
    if policy == "locks_last":
        keys = [F.col("locked").cast("int")]
    elif policy == "score_desc":
        any_score = F.max(F.col("score").isNotNull().cast("int")).over(Window.partitionBy("query_id"))
        packed = packed.withColumn("_any", any_score)
        best = F.when((F.col("_any") == 1) & ~F.col("locked"), -F.coalesce("score", F.lit(float("-inf"))))
        keys = [F.when(F.col("_any") == 1, (~F.col("locked")).cast("int")).otherwise(0), F.coalesce(best, F.lit(0.0))]
    w = Window.partitionBy("query_id").orderBy(*keys, "place")
    return packed.withColumn("shown", F.row_number().over(w)).select("query_id", "id", "place", "shown")


def seed_of(scope: Column, fire: Column, query: Column) -> Column:
    """The 64-bit seed of a draw, from its scope, number and query, as a decimal."""

    @F.pandas_udf("decimal(20,0)")
    def seed(text: pd.Series) -> pd.Series:
        from decimal import Decimal

        return text.map(lambda t: Decimal(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")), na_action="ignore")

    return seed(F.concat_ws("\x1f", scope, fire.cast("string"), query))


def words_of(seed: int) -> Iterator[int]:
    """Pseudo-random 64-bit words."""
    state = seed & _MASK
    while True:
        state = (state + GOLDEN) & _MASK
        z = ((state ^ (state >> 30)) * MIX_A) & _MASK
        z = ((z ^ (z >> 27)) * MIX_B) & _MASK
        yield z ^ (z >> 31)


def drawn(ids: list[str], seed: int, count: int) -> list[str]:
    """``count`` of the distinct ids, each as likely, in the order they are drawn; the same for one seed everywhere."""
    pool, words = sorted(set(ids)), words_of(seed)
    for i in range(min(count, len(pool))):
        bound = len(pool) - i
        fair = (1 << 64) - (1 << 64) % bound
        j = i + next(w for w in words if w < fair) % bound
        pool[i], pool[j] = pool[j], pool[i]
    return pool[: max(0, min(count, len(pool)))]


def draws(pool: DataFrame, count: int) -> DataFrame:
    """Ids drawn from the pool (``query_id``, ``seed``, ``id``) of each query."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        got = drawn(rows.id.tolist(), int(rows.seed.iloc[0]), count)
        return pd.DataFrame({"query_id": rows.query_id.iloc[0], "id": got, "place": range(1, len(got) + 1)})

    kind = pool.schema["query_id"].dataType.simpleString()
    return pool.select("query_id", "seed", "id").groupBy("query_id").applyInPandas(draw, f"query_id {kind}, id string, place int")


def displaced(packed: DataFrame, need: DataFrame) -> DataFrame:
    """Packs (``query_id``, ``id``, ``place``, ``tokens``, ``locked``) that give way to drawn beliefs of ``need`` tokens: the unlocked from the end on, until
    they free enough; a pack that can't free enough gives none."""
    rows = packed.where("NOT locked").join(need, "query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("place"))
    freed = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("tokens").over(Window.partitionBy("query_id"))
    return rows.withColumn("freed", freed).withColumn("total", total).where("freed < need AND total >= need").select("query_id", "id", "place")
