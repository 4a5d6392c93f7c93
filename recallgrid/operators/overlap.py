"""The rows that share most keys with each query, by pairs of blocks, so that only the best of a block leave a task."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import new_folder

#: Keys of a block of rows and of queries, and blocks of queries that there are at least, so that all tasks are busy.
BLOCK_KEYS, LEAST_BLOCKS = 4_000_000, 16
#: How far the bar for a query's best is lowered at a time.
STEP = 0.7


def _unique_keys(words: DataFrame, word: str) -> Column:
    """A hash of words that no two of them share."""
    for seed in itertools.count():
        key = F.xxhash64(word, F.lit(seed))
        if words.groupBy(key.alias("k")).count().where("count > 1").isEmpty():
            return key


def _best(count: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` greatest scores to 6 places among those that share something; of equal ones those that stand first."""
    bar = score.max() if len(score) else 0.0
    while True:
        bar *= STEP
        if bar < 1e-3:
            at = np.flatnonzero(count)
            break
        at = np.flatnonzero(score >= bar)
        if len(at) >= k:
            break
    value = np.rint(score[at] * 1e6)
    if len(at) > 4 * k:
        some = value >= np.partition(value, len(at) - k)[len(at) - k]
        at, value = at[some], value[some]
    return at[np.argsort(-value, kind="stable")[:k]]


def _compare(rows: tuple[np.ndarray, np.ndarray], n: int, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """Of each query's best among ``n`` rows: the query's place, the row's, how many keys they share and the sum of those keys' weights. ``rows``: keys, and how many each row has;
    ``queries``: keys, their weights, and how many each query has."""
    keys, sizes = rows
    order = np.argsort(keys, kind="stable")
    row = np.repeat(np.arange(n), sizes)[order]
    known, begins = np.unique(keys[order], return_index=True)
    begins = np.append(begins, len(keys))
    asked, weights, wanted = queries
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    hit = known[place] == asked
    plain = bool((weights == 1).all())
    ends = np.cumsum(wanted)
    out = []
    for q, (a, b) in enumerate(zip(ends - wanted, ends, strict=True)):
        own = place[a:b][hit[a:b]]
        if not len(own):
            continue
        lists = [row[begins[p] : begins[p + 1]] for p in own]
        met = np.concatenate(lists)
        at = None
        if 8 * len(met) < n:
            # Few rows are met: counts of those only.
            at, met = np.unique(met, return_inverse=True)
        size = n if at is None else len(at)
        count = np.bincount(met, minlength=size)
        score = count if plain else np.bincount(met, np.repeat(weights[a:b][hit[a:b]], [len(x) for x in lists]), size)
        best = _best(count, score, k)
        out.append((np.full(len(best), q), best if at is None else at[best], count[best], score[best].astype(float)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)


def most_shared(asked: DataFrame, rows: DataFrame, limit: int, weight: Column | None = None) -> DataFrame:
    """(``query_id``, ``belief_id``, ``overlap``, ``score``, ``place``): the ``limit`` rows (``belief_id``, ``entity_lower``) that share most with each query (``query_id``, ``entity_lower``);
    ties by id. A key counts 1, or ``weight`` of how many rows have it (``fan``), 0 at least. Both tables are of distinct rows.

    Both are dealt into blocks, and a task counts for the queries of one over the rows of another.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, "overlap")
    asked.write.parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    rows.join(asked.select("entity_lower").distinct(), "entity_lower", "left_semi").write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    rows.groupBy("entity_lower").agg(F.count("*").alias("fan")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    key = _unique_keys(words, "entity_lower").alias("k")
    # Keys of words that no row has are left out before.
    weighed = asked.join(words.withColumn("w", F.lit(1.0) if weight is None else weight), "entity_lower").select("query_id", key, "w")
    rows.groupBy("belief_id").agg(F.collect_list(key).alias("k")).write.parquet(f"{folder}/sets")
    weighed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("k")).write.parquet(f"{folder}/queries")
    sets, queries = (spark.read.parquet(f"{folder}/{x}") for x in ("sets", "queries"))
    many, some = (df.agg(F.coalesce(F.sum(F.size("k")), F.lit(0))).first()[0] for df in (sets, queries))
    ours, theirs = max(LEAST_BLOCKS, -(-some // BLOCK_KEYS)), max(1, -(-many // BLOCK_KEYS))
    row_kind, query_kind = sets.schema["belief_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    none = F.lit(None).cast("array<double>").alias("w")
    held = sets.select(F.explode(F.sequence(F.lit(0), F.lit(ours - 1))).alias("i"), F.pmod(F.xxhash64("belief_id"), F.lit(theirs)).cast("int").alias("j"), "belief_id", F.lit(None).cast(query_kind).alias("query_id"), "k", none)
    meets = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(ours)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))).alias("j"), F.lit(None).cast(row_kind).alias("belief_id"), "query_id", F.col("k.k").alias("k"), F.col("k.w").alias("w"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table["w"].is_valid()
        q, x = table.filter(asks), table.filter(pc.invert(asks))
        x = x.take(pc.sort_indices(x["belief_id"]))
        flat = lambda column: pc.list_flatten(column).to_numpy()
        size = lambda column: pc.list_value_length(column).to_numpy()
        if x.num_rows and q.num_rows:
            i, j, n, score = _compare((flat(x["k"]), size(x["k"])), x.num_rows, (flat(q["k"]), flat(q["w"]), size(q["k"])), limit)
        else:
            i, j, n, score = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        return pa.table({"query_id": q["query_id"].take(pa.array(i)), "belief_id": x["belief_id"].take(pa.array(j)), "overlap": pa.array(n, pa.int64()), "score": pa.array(score, pa.float64())})

    best = held.unionByName(meets).groupBy("i", "j").applyInArrow(compare, f"query_id {query_kind}, belief_id {row_kind}, overlap long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "belief_id")
    return best.withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
