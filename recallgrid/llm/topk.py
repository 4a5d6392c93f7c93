"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists, one for each dimension.

Vectors are dealt into blocks of bounded size by a hash of the whole row, so that no value, however often it stands, makes a block
large. A task gets a block first and then, one batch after another, all queries. It sorts the block's rows into a list for each
dimension and walks the lists from the ends that a query's signs favour: rows met under sorted access are scored whole; the values
at the places reached bound the score of every row not yet met. A query leaves a block when that bound can't beat its kth result.
The best of all blocks are merged by query, each block's k at most.

Components are integers; scores are exact: the number type is the narrowest in which no sum of products can round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import released

#: Rows of a block, about: they are dealt by a hash.
BLOCK_ROWS = 8192
#: Places that a query goes down each list at first; every further step goes twice as far.
FIRST_DEPTH = 32
#: Scores are longs; greater ones become the greatest before blocks are merged.
LONG = (1 << 63) - 1

FOUND = T.StructType().add("query_id", "long").add("vec_id", "long").add("score", "long")


class Lists:
    """The rows of a block and their sorted lists. Rows come in the order of their ids, so that equal values stand in that order too."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, dims = rows.shape
        self.order = np.empty((2, dims, n), np.int32)
        for d in range(dims):
            self.order[0, d] = np.argsort(rows[:, d], kind="stable")
            self.order[1, d] = np.argsort(-rows[:, d], kind="stable")
        self._typed: dict[str, np.ndarray] = {}
        self.most = np.abs(rows).max(axis=0) if n else np.zeros(dims, rows.dtype)

    def typed(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and query as numbers in which their products and sums are exact."""
        bound = sum(abs(int(a)) * int(b) for a, b in zip(query.tolist(), self.most.tolist(), strict=True))
        kind = "f4" if bound < 1 << 24 else "f8" if bound < 1 << 53 else "O"
        if kind not in self._typed:
            self._typed[kind] = np.array([[int(x) for x in r] for r in self.rows.tolist()], object).reshape(self.rows.shape) if kind == "O" else self.rows.astype(kind)
        return self._typed[kind], np.array([int(x) for x in query.tolist()], object) if kind == "O" else query.astype(kind)

    def top(self, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) for a query, of rows whose id isn't ``own``; ties to the smaller id."""
        rows, q = self.typed(query)
        n, dims = rows.shape
        weighs = np.flatnonzero(q != 0)
        side = (q[weighs] > 0).astype(np.intp)  # the lists in which q * x falls
        met = np.zeros(n, bool)
        met[np.searchsorted(self.ids, own) : np.searchsorted(self.ids, own, side="right")] = own is not None
        best: list[tuple[int, int]] = []
        at, depth = 0, FIRST_DEPTH
        while at < n:
            to = min(n, at + depth)
            here = np.zeros(n, bool)
            places = self.order[side, weighs, at:to] if len(weighs) else np.arange(at, to)[None]
            here[places.ravel()] = True
            fresh = np.flatnonzero(here & ~met)
            met[fresh] = True
            best = _best(best, rows[fresh] @ q, self.ids[fresh], k)
            if len(best) == k:
                ends = places[:, -1]
                bound = (rows[ends, weighs] * q[weighs]).sum() if len(weighs) else 0
                # A row not met that ties with the kth has the end's value in every list, and stands behind it there by its id.
                last = self.ids[ends].max()
                if bound < best[-1][0] or (bound == best[-1][0] and best[-1][1] < last):
                    break
            at, depth = to, 2 * depth
        return best


def _best(best: list[tuple[int, int]], scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        if len(keep) > k:  # of ties at the end the smallest ids, which stand first
            tied = np.flatnonzero(scores[keep] == least)
            keep = np.delete(keep, tied[k - len(keep) :])
        scores, ids = scores[keep], ids[keep]
    both = best + [(int(s), int(i)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
    return sorted(both, key=lambda x: (-x[0], x[1]))[:k]


def _vectors(values: pa.Array, dims: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), dims)


def _search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists, ids, rows = None, None, [], []
        for batch in batches:
            keys = list(zip(batch["dims"].to_pylist(), batch["block"].to_pylist(), batch["asks"].to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                to = next((j for j in range(at, len(keys)) if keys[j] != keys[at]), len(keys))
                dims, block, asks = keys[at]
                if (dims, block) != key:
                    key, lists, ids, rows = (dims, block), None, [], []
                ids_here, here = batch["id"].slice(at, to - at).to_numpy(zero_copy_only=False), _vectors(batch["vector"].slice(at, to - at), dims)
                at = to
                if not asks:
                    ids.append(ids_here)
                    rows.append(here)
                    continue
                if lists is None:
                    if not ids:
                        continue
                    every = np.concatenate(ids)
                    order = np.argsort(every, kind="stable")
                    lists, ids, rows = Lists(every[order], np.concatenate(rows)[order]), [], []
                found = [(q, *x) for q, v in zip(ids_here.tolist(), here, strict=True) for x in lists.top(v, q, k)]
                if found:
                    q, score, vec = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(vec, pa.int64()), pa.array([max(-LONG - 1, min(LONG, s)) for s in score], pa.int64())], ["query_id", "vec_id", "score"])

    return kernel


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(``id``, ``vector``): floor(scale * x) of each component as a double; rows without an id, without a vector or with a null or
    non-finite component take no part, of equal rows one does."""
    x = F.col("v").cast("array<double>")
    usable = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where(usable)
    # In doubles, as a long can't hold every one; the product with a power of two rounds nothing.
    return rows.select("id", F.transform(x, lambda c: _floor(c * float(scale))).alias("vector")).distinct()


def _floor(x: Column) -> Column:
    """floor as a double; beyond 2**53 every double is whole."""
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): for each row of ``queries`` the ``k`` rows of ``vectors`` with the greatest inner product and
    another id, all if there are fewer; ties go to the smaller id. Both have (``id``, ``vector``) as ``whole_vectors`` makes them.

    Vectors meet those of their own length only; vectors without components score 0. Several vectors of one id are candidates each;
    where an id asks with several, its rows are the best over all of them.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    sized = F.size("vector").alias("dims")
    held = vectors.select(sized, F.expr(f"pmod(xxhash64(id, vector), {blocks}L)").alias("block"), F.lit(False).alias("asks"), "id", "vector")
    asked = queries.select(sized, F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"), F.lit(True).alias("asks"), "id", "vector")
    dealt = held.unionByName(asked).repartition("dims", "block").sortWithinPartitions("dims", "block", "asks")
    found = dealt.mapInArrow(released(_search(k)), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
