"""Nearest vectors: an index of inverted lists over trained centroids, whose bounds make its results exact.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors, the least by a hash of the id); every vector is indexed. A cell is dealt
into blocks of bounded size, so that no cell is one task. A search looks at the ``few`` cells nearest to a probe first; after that it
looks at each other cell in which, by the widest angle and the greatest norm of its vectors, a product could still be among the
probe's best. A task streams blocks and the probes that ask for them, so that neither is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import _delete, new_folder

#: Vectors that centroids are fitted on, the most cells, rounds of fitting, vectors of a block, and cells looked at first.
SAMPLE, CELLS, ROUNDS, BLOCK_ROWS, FEW = 4096, 256, 8, 8192, 8
#: What rounding may add to a bound.
SLACK = 1e-9


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length, those without length as they are, and their norms."""
    norms = np.linalg.norm(x, axis=1)
    return x / np.where(norms > 0, norms, 1.0)[:, None], norms


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by angle. They begin at sample vectors far from those before; one that no vector is nearest to stays."""
    x, _ = unit(sample)
    chosen = [0]
    nearest = x @ x[0]
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(ROUNDS):
        of = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, x)
        moved = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(moved[:, None], unit(sums)[0], centroids)
    return centroids


def bounds(probes: np.ndarray, centroids: np.ndarray, widest: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For each probe and cell the greatest product that a vector of the cell can have with it: the greatest norm times the cosine of the least
    angle, which is that to the centroid less the cell's widest; where that cosine is below zero, no product is above it."""
    x, norms = unit(probes)
    angle = np.arccos(np.clip(x @ centroids.T, -1, 1)) - widest
    return norms[:, None] * np.maximum(np.cos(np.clip(angle, 0, np.pi)), 0) * np.maximum(longest, 0) + SLACK


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _sampled(vectors: DataFrame) -> np.ndarray:
    """The vectors that centroids are fitted on, by hash and id. Ids are picked first, so that no task brings vectors that others' displace."""
    chosen = vectors.select(F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE)
    last = chosen.agg(F.max("h")).first()[0]
    if last is None:
        return np.zeros((0, 0))
    # Rows of the last hash beyond the sample's size are few.
    found = vectors.withColumn("h", F.xxhash64("id")).where(F.col("h") <= last).select("h", "id", "vector").toArrow()
    found = found.take(pc.sort_indices(found, [("h", "ascending"), ("id", "ascending")])[:SAMPLE])
    return _matrix(found["vector"].combine_chunks())


class VectorIndex:
    """An index of (``id``, ``vector``), vectors of one length of finite doubles."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, made: bool = False):
        """``made``: that the vectors are read from files, or are made from such at no cost; else they are written first, as they are read three times."""
        spark = vectors.sparkSession
        self.folder, self.id_type = new_folder(spark, "vectors"), vectors.schema["id"].dataType.simpleString()
        vectors = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
        given = f"{self.folder}-given"
        if not made:
            vectors = _stored(vectors, given)
        sample = _sampled(vectors)
        self.centroids = fitted(sample, cells or min(CELLS, max(1, int(len(sample) ** 0.5)))) if len(sample) else np.zeros((0, 0))
        centroids = self.centroids

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, norms = unit(_matrix(batch.column("vector")))
                    cosines = x @ centroids.T
                    cell = cosines.argmax(axis=1)
                    made = [pa.array(cell.astype(np.int32)), pa.array(cosines[np.arange(len(cell)), cell]), pa.array(norms)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["id", "vector", "cell", "cosine", "norm"])

        vectors.mapInArrow(assign, f"id {self.id_type}, vector array<double>, cell int, cosine double, norm double").write.parquet(self.folder)
        if not made:
            _delete(spark, given)
        self.rows = spark.read.parquet(self.folder)
        # One row a cell, and no more cells than ``CELLS``.
        known = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("cosine"), F.max("norm").alias("norm")).collect()
        k = len(centroids)
        self.blocks, self.widest, self.longest = np.zeros(k, np.int64), np.zeros(k), np.full(k, -1.0)
        for r in known:
            self.blocks[r.cell], self.widest[r.cell], self.longest[r.cell] = -(-r.n // BLOCK_ROWS), np.arccos(np.clip(r.cosine, -1, 1)), r.norm

    def search(self, probes: DataFrame, k: int, least: float = float("-inf"), few: int = FEW, places: int = 9) -> DataFrame:
        """(``probe``, ``id``, ``score``): the ``k`` greatest inner products of each probe (``probe``, ``vector``) that are ``least`` or more, rounded to so many
        places before they are compared; ties by id. Cells are left out only where their bound says that they hold none of them."""
        spark = probes.sparkSession
        probes = probes.select("probe", F.col("vector").cast("array<double>").alias("vector"))
        kind = probes.schema["probe"].dataType.simpleString()
        if not len(self.centroids):
            return spark.createDataFrame([], f"probe {kind}, id {self.id_type}, score double")
        folder = new_folder(spark, "probes")
        probes.write.parquet(f"{folder}/probes")
        probes = spark.read.parquet(f"{folder}/probes")
        known, blocks = (self.centroids, self.widest, self.longest), self.blocks

        def cells(first: bool):
            def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    most = np.where(blocks > 0, bounds(_matrix(batch.column("vector")), *known), -np.inf)
                    order = np.argsort(-most, axis=1, kind="stable")
                    near = np.zeros(most.shape, bool)
                    np.put_along_axis(near, order[:, :few], True, axis=1)
                    wanted = near if first else ~near & (most >= batch.column("bar").to_numpy(zero_copy_only=False)[:, None])
                    row, cell = np.nonzero(wanted & (most >= least - 10.0**-places) & (blocks > 0))
                    yield pa.RecordBatch.from_arrays([batch.column("probe").take(pa.array(row)), batch.column("vector").take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array(blocks[cell])], ["probe", "vector", "cell", "blocks"])

            return kernel

        asked = f"probe {kind}, vector array<double>, cell int, blocks long"
        best = self._in_cells(probes.mapInArrow(cells(True), asked), kind, k, least, places)
        best.write.parquet(f"{folder}/first")
        best = spark.read.parquet(f"{folder}/first")
        bar = best.groupBy("probe").agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(f"n >= {k}").select(F.col("probe").alias("p"), "bar")
        rest = probes.join(bar, F.col("probe") == F.col("p"), "left").select("probe", "vector", (F.coalesce("bar", F.lit(float("-inf"))) - 10.0**-places).alias("bar"))
        more = self._in_cells(rest.mapInArrow(cells(False), asked), kind, k, least, places)
        return self._top(best.unionByName(more), k)

    @staticmethod
    def _top(rows: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
        return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")

    def _in_cells(self, asked: DataFrame, kind: str, k: int, least: float, places: int) -> DataFrame:
        """The best of each probe in the cells that it asks for; a task gets a block of vectors, then the probes that meet it."""
        blocks = F.element_at(F.array(*(F.lit(int(max(b, 1))) for b in self.blocks)), F.col("cell") + 1)
        held = self.rows.select("cell", F.pmod(F.xxhash64("id"), blocks).cast("long").alias("block"), F.lit(False).alias("asks"), F.lit(None).cast(kind).alias("probe"), "id", "vector")
        meets = asked.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "probe", F.lit(None).cast(self.id_type).alias("id"), "vector")
        dealt = held.unionByName(meets).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks", "id")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, rows, block = None, [], [], None
            for batch in batches:
                keys = list(zip(batch["cell"].to_pylist(), batch["block"].to_pylist(), batch["asks"].to_pylist(), strict=True))
                at = 0
                while at < len(keys):
                    to = next((j for j in range(at, len(keys)) if keys[j] != keys[at]), len(keys))
                    part, here = batch.slice(at, to - at), keys[at]
                    at = to
                    if here[:2] != key:
                        key, ids, rows, block = here[:2], [], [], None
                    if not here[2]:
                        ids.append(part["id"])
                        rows.append(_matrix(part["vector"]))
                        continue
                    if block is None:
                        if not ids:
                            continue
                        block, ids = np.concatenate(rows), [pa.concat_arrays(ids)]
                        rows = []
                    scores = np.round(_matrix(part["vector"]) @ block.T, places)
                    found = [(i, j) for i in range(len(scores)) for j in _best(scores[i], k, least)]
                    i, j = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                    yield pa.RecordBatch.from_arrays([part["probe"].take(pa.array(i)), ids[0].take(pa.array(j)), pa.array(scores[i, j])], ["probe", "id", "score"])

        return self._top(dealt.mapInArrow(score, f"probe {kind}, id {self.id_type}, score double"), k)


def _best(scores: np.ndarray, k: int, least: float) -> np.ndarray:
    """The places of the ``k`` greatest scores that are ``least`` or more; of equal ones those that stand first."""
    at = np.flatnonzero(scores >= least)
    return at[np.argsort(-scores[at], kind="stable")[:k]] if len(at) <= 4 * k else _best_of_many(scores, at, k)


def _best_of_many(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    bar = np.partition(scores[at], len(at) - k)[len(at) - k]
    at = at[scores[at] >= bar]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def cosine_top(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """For each query vector the ``k`` nearest rows (``vec_id``, ``embedding``) by cosine to 6 places, itself left out; ties by id. A vector without
    length has a cosine of 0 with all. Rows without a vector or with a null or non-finite component take no part."""

    def ready(df: DataFrame, name: str) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, v: a + v * v))
        rows = df.where(F.size("embedding") > 0).select(F.col("vec_id").alias(name), F.transform(e, lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("vector"), norm.alias("norm"))
        return rows.where(F.col("norm") < float("inf")).select(name, "vector")  # a NaN is greater

    found = VectorIndex(ready(rows, "id"), made=True).search(ready(queries, "probe"), k + 1, places=6).where("probe <> id")
    place = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id"))
    return found.select(F.col("probe").alias("q"), F.col("id").alias("r"), F.col("score").alias("cosine"), place.alias("place")).where(F.col("place") <= k)
