"""The least eigenpairs of the signed Laplacian by its components, dense or by block Lanczos steps, and heat from them.

A pair of a component of the graph is one of the whole, as no entry leaves a component. Components of up to ``DENSE`` nodes are solved
within tasks; the others together by Lanczos steps, unless as many pairs as wanted have the value 0 already, below which there is none.

The basis of these is a table of (``i``, ``q``): for each node its row of the orthonormal columns found so far. It is written bucketed by node, so
that a step joins it without moving it; what moves in a step are the block's products with the matrix. The matrix is bucketed by
the column it is joined on. Sums over all nodes come to the driver as matrices of the basis' width, never of the graph's.

A step multiplies the last block by a Chebyshev polynomial of the Laplacian that is largest where eigenvalues are least and falls up
to a cut, and is 1 at most from there on; eigenvectors stay, and the basis needs a fraction of the columns. Each new block is made orthogonal to all columns
before it twice. A last small problem in the Laplacian itself gives eigenvalues and the norms of what is left over.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import new_folder
from .graph import components

#: Columns of a block, and the most columns of a basis.
BLOCK, MOST = 8, 400
#: Terms that one job chains.
CHAIN = 6
#: Cuts of the polynomial, each with its degree, from the sharpest on: the next is taken where fewer eigenvalues than wanted lie below one.
#: Half of a spectrum whose mean is 1 lies below the last, about.
CUTS = ((0.1, 24), (0.4, 12), (1.0, 8))
#: Directions are taken for rounding that keep less than the first of a block's length when they are made orthogonal to the basis, or have less
#: than the second of the longest that is left: squares of lengths are exact to 1e-16.
TINY, FAINT = 1e-12, 1e-7
#: The most nodes of a component that is solved as a dense matrix, and values that are taken for 0 (and for equal).
DENSE, ZERO = 512, 1e-9


class _Tables:
    """Tables of one run, bucketed by a column, and gone when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.names = spark, new_folder(spark, "spectrum"), []
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def put(self, rows: DataFrame, key: str) -> DataFrame:
        name = f"spectrum_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, key).sortBy(key).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")


def _columns(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{c}" for c in range(n)]


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def _summed(rows: DataFrame, product: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of a small matrix over all batches: within tasks first, then by its cells."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += product(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    out = np.zeros(shape[0] * shape[1])
    for cell, v in rows.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[cell] = v
    return out.reshape(shape)


def _filtered(tables: _Tables, matrix: DataFrame, block: DataFrame, width: int, degree: int) -> DataFrame:
    """The polynomial of the matrix times a block (``i``, ``w``). A term and the one before go along as columns, so that a term is one join and
    one sum. ``matrix``: (``i``, ``j``, ``v``) of A = (L - middle) / half, all of the diagonal in it."""
    now, before = _columns("y", width), _columns("z", width)
    rows = block.select(F.col("i").alias("j"), *(F.col("w")[c].alias(now[c]) for c in range(width)), *(F.lit(0.0).alias(z) for z in before))
    for k in range(degree):
        if k and k % CHAIN == 0:
            rows = tables.put(rows, "j")
        twice = 1.0 if k == 0 else 2.0
        own = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
        new = [F.sum(twice * F.col("v") * F.col(y) - own * F.col(z)).alias(f"n{y}") for y, z in zip(now, before, strict=True)]
        old = [F.sum(own * F.col(y)).alias(f"o{y}") for y in now]
        rows = matrix.join(rows, "j").groupBy("i").agg(*new, *old)
        rows = rows.select(F.col("i").alias("j"), *(F.col(f"n{y}").alias(y) for y in now), *(F.col(f"o{y}").alias(z) for y, z in zip(now, before, strict=True)))
    return rows.select(F.col("j").alias("i"), F.array(*now).alias("w"))


def _orthonormal(gram: np.ndarray, length: float) -> np.ndarray:
    """R with (W R)^T (W R) = 1, given W^T W and the length that W had before; ``TINY`` and ``FAINT`` directions are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    lengths = np.sqrt(np.maximum(values, 0))
    keep = lengths > max(TINY * length, FAINT * lengths.max())
    return vectors[:, keep] / np.sqrt(values[keep])


def least_eigenpairs(laplacian: DataFrame, k: int, block: int = BLOCK, most: int = MOST, close: float = 1e-11, dense: int = DENSE) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The ``k`` least eigenvalues of a symmetric matrix with a unit diagonal and a spectrum from 0 to 2, the norms |L v - lambda v|, and a
    table (``i``, ``v``) of the vectors' rows.

    ``laplacian``: its entries off the diagonal (``i``, ``j``, ``v``), both halves; nodes without one take no part. Values within ``ZERO``
    of each other are taken by their components' least nodes, so that a graph always gives the same pairs; components of up to ``dense`` nodes come before the others. Fewer nodes than ``k`` give fewer pairs.
    """
    spark = laplacian.sparkSession
    folder = new_folder(spark, "pairs")
    laplacian.select("i", "j", "v").write.parquet(f"{folder}/entries")
    entries = spark.read.parquet(f"{folder}/entries")
    components(entries.select(F.col("i").alias("a"), F.col("j").alias("b"))).write.parquet(f"{folder}/roots")
    roots = spark.read.parquet(f"{folder}/roots")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= dense).select("root")
    parts = entries.join(roots.withColumnRenamed("id", "i"), "i")
    kind = entries.schema["i"].dataType.simpleString()
    pairs = parts.join(small, "root", "left_semi").groupBy("root").applyInArrow(_dense(k), f"root {kind}, value double, rest double, place int, i array<{kind}>, x array<double>")
    pairs.write.parquet(f"{folder}/dense")
    solved = spark.read.parquet(f"{folder}/dense")
    found = solved.select("root", "place", "value", "rest").orderBy(F.round(F.col("value") / ZERO), "root", "place").limit(k).collect()
    large = parts.join(small, "root", "left_anti").select("i", "j", "v")
    vectors = None
    values, left = np.zeros(0), np.zeros(0)
    if (len(found) < k or found[-1].value > ZERO) and not large.isEmpty():
        values, left, vectors = _by_steps(large, k, block, most, close)
    # Of all pairs the least; those of small components first where values are equal.
    every = sorted([(round(r.value / ZERO), 0, n) for n, r in enumerate(found)] + [(round(float(v) / ZERO), 1, n) for n, v in enumerate(values)])[:k]
    chosen = [(r.root, r.place, at) for at, (_, steps, n) in enumerate(every) if not steps for r in (found[n],)]
    places = spark.createDataFrame(chosen, f"root {kind}, place int, at int")
    rows = solved.join(F.broadcast(places), ["root", "place"]).select("at", F.explode(F.arrays_zip("i", "x")).alias("e")).select("at", "e.i", "e.x")
    own = rows.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("own"))
    table = roots.select(F.col("id").alias("i")).join(own, "i", "left")
    if vectors is not None:
        table = table.join(vectors.withColumnRenamed("v", "by_steps"), "i", "left")
    columns = [F.coalesce(F.col("by_steps")[n] if steps else F.col("own")[at], F.lit(0.0)) for at, (_, steps, n) in enumerate(every)]
    table.select("i", F.array(*columns).cast("array<double>").alias("v")).write.parquet(f"{folder}/vectors")
    of = [(values[n], left[n]) if steps else (found[n].value, found[n].rest) for _, steps, n in every]
    return np.array([v for v, _ in of]), np.array([r for _, r in of]), spark.read.parquet(f"{folder}/vectors")


def _dense(k: int) -> Callable[[pa.Table], pa.Table]:
    """The ``k`` least pairs of a component from its entries, each with its nodes and what is left over."""

    def solve(rows: pa.Table) -> pa.Table:
        names, (i, j) = rows["i"].combine_chunks().unique().sort(), (rows["i"], rows["j"])
        at, of = (pc.index_in(x, names).to_numpy() for x in (i, j))
        matrix = np.eye(len(names))
        matrix[at, of] += rows["v"].to_numpy()
        values, vectors = np.linalg.eigh(matrix)
        values, vectors = values[:k], vectors[:, :k]
        # The sign is such that the entry of the first node that isn't small is positive.
        vectors = vectors * np.array([np.sign(x[np.flatnonzero(np.abs(x) > 1e-6)[0]]) for x in vectors.T])
        left = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        n = len(values)
        nodes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), pa.concat_arrays([names] * n))
        return pa.table({"root": pa.array([rows["root"][0].as_py()] * n, names.type), "value": values, "rest": left, "place": pa.array(range(n), pa.int32()), "i": nodes, "x": _lists(vectors.T)})

    return solve


def _by_steps(laplacian: DataFrame, k: int, block: int, most: int, close: float) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """The same by Lanczos steps. Start vectors come from a hash of the node's name. Steps end when the ``k`` values of the polynomial stand
    still to ``close``, when nothing new is found, or at ``most`` columns."""
    tables = _Tables(laplacian.sparkSession)
    try:
        nodes = laplacian.select("i").distinct().withColumn("v", F.lit(1.0))
        entries = tables.put(laplacian.select("i", "j", "v").unionByName(nodes.select("i", F.col("i").alias("j"), "v")), "j")
        for cut, degree in CUTS:
            basis, gram, form, enough = _lanczos(tables, entries, k, block, most, close, cut, degree)
            if enough or cut == CUTS[-1][0]:
                break
        return _finished(tables, entries, basis, gram, form, k)
    finally:
        tables.drop()


def _lanczos(tables: _Tables, entries: DataFrame, k: int, block: int, most: int, close: float, cut: float, degree: int) -> tuple[DataFrame, np.ndarray, np.ndarray, bool]:
    """The basis, the products of its columns with each other and with the polynomial's, and whether ``k`` eigenvalues lie below the cut (or
    the basis holds all that the start vectors reach)."""
    middle, half = (2 + cut) / 2, (2 - cut) / 2
    own = F.when(F.col("i") == F.col("j"), middle).otherwise(0.0)
    matrix = entries.select("i", "j", ((F.col("v") - own) / half).alias("v"))
    start = [(F.pmod(F.xxhash64("i", F.lit(c)), F.lit(2000003)) / 1000001.0 - 1.0) for c in range(block)]
    fresh = tables.put(entries.where("i = j").select("i", F.array().cast("array<double>").alias("q"), F.array(*start).alias("w")), "i")
    width, new = 0, block
    gram, form = np.zeros((0, 0)), np.zeros((0, 0))
    last: np.ndarray | None = None
    while True:
        fresh, added, overlap = _appended(tables, fresh, width, new)
        if not added:
            return fresh, gram, form, True
        width, new, gram = width + added, added, overlap
        if width + block > most:
            return fresh, gram, form, last is not None and last[-1] > 1
        product = _filtered(tables, matrix, fresh.select("i", F.slice("q", width - new + 1, new).alias("w")), new, degree)
        fresh = tables.put(fresh.join(product, "i"), "i")
        form = _grown(form, _summed(fresh, lambda b: _matrix(b, "q").T @ _matrix(b, "w"), (width, new)))
        values = _ritz(gram, form)[0][::-1][:k]
        still = last is not None and len(last) == k and bool(np.all(np.abs(values - last) <= close * np.abs(values)))
        if width >= 2 * k and still:
            return fresh, gram, form, bool(values[-1] > 1)
        if width >= 8 * max(k, block) and values[-1] <= 1 and cut < CUTS[-1][0]:
            return fresh, gram, form, False
        last = values


def _appended(tables: _Tables, rows: DataFrame, width: int, new: int) -> tuple[DataFrame, int, np.ndarray]:
    """The basis (``i``, ``q``) with the block ``w`` after it, made orthogonal to it and within itself; how many columns that adds; the products
    of all columns with each other."""

    def both(batch: pa.RecordBatch, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, w = _matrix(batch, "q").reshape(batch.num_rows, width), _matrix(batch, "w")
        return q, w - q @ first

    def products(batch: pa.RecordBatch, first: np.ndarray) -> np.ndarray:
        q, w = both(batch, first)
        return np.hstack([q, w]).T @ w

    whole = _summed(rows, lambda b: products(b, np.zeros((width, new))), (width + new, new))
    first, length = whole[:width], float(np.sqrt(np.diag(whole[width:]).max()))
    second = _summed(rows, lambda b: products(b, first), (width + new, new))
    again = second[:width]
    # What is left is w - q (first + again); its own products follow, as the basis is orthonormal up to rounding.
    turn = _orthonormal(second[width:] - again.T @ again, length)
    added = turn.shape[1]
    total = first + again

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, w = both(batch, total)
                yield pa.RecordBatch.from_arrays([batch.column("i"), _lists(np.hstack([q, w @ turn]))], ["i", "q"])

    kind = f"i {rows.schema['i'].dataType.simpleString()}, q array<double>"
    basis = tables.put(rows.mapInArrow(append, kind), "i")
    return basis, added, _summed(basis, lambda b: _matrix(b, "q").T @ _matrix(b, "q"), (width + added, width + added)) if added else np.zeros((0, 0))


def _grown(form: np.ndarray, products: np.ndarray) -> np.ndarray:
    """The symmetric matrix with the products of its new columns with all."""
    width, new = products.shape
    out = np.zeros((width, width))
    out[: len(form), : len(form)] = form
    out[:, width - new :] = products
    out[width - new :] = products.T
    corner = products[width - new :]
    out[width - new :, width - new :] = (corner + corner.T) / 2
    return out


def _ritz(gram: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, ascending, and vectors of form x = value gram x; columns of the basis that have no products yet take no part."""
    n = len(form)
    lower = np.linalg.inv(np.linalg.cholesky(gram[:n, :n]))
    values, vectors = np.linalg.eigh(lower @ form @ lower.T)
    return values, lower.T @ vectors


def _times(batch: pa.RecordBatch, column: str, by: np.ndarray) -> np.ndarray:
    return _matrix(batch, column)[:, : len(by)] @ by


def _turned(rows: DataFrame, column: str, by: np.ndarray, out: str) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("i"), _lists(_times(batch, column, by))], ["i", out])

    return rows.mapInArrow(kernel, f"i {rows.schema['i'].dataType.simpleString()}, {out} array<double>")


def _finished(tables: _Tables, entries: DataFrame, basis: DataFrame, gram: np.ndarray, form: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Eigenpairs of the matrix itself among the best of the polynomial's."""
    width = len(gram)
    ways = _ritz(gram, form)[1][:, ::-1][:, : k + BLOCK] if width >= 2 * k else np.eye(width)
    n = ways.shape[1]
    if n == 0:
        return np.zeros(0), np.zeros(0), tables.spark.createDataFrame([], "i string, v array<double>")
    found = tables.put(_turned(basis.select("i", "q"), "q", ways, "v"), "i")
    wide = found.select(F.col("i").alias("j"), *(F.col("v")[c].alias(f"x{c}") for c in range(n)))
    product = entries.join(wide, "j").groupBy("i").agg(*(F.sum(F.col("v") * F.col(f"x{c}")).alias(f"x{c}") for c in range(n)))
    pairs = tables.put(found.join(product.select("i", F.array(*_columns("x", n)).alias("w")), "i"), "i")
    sums = _summed(pairs, lambda b: np.hstack([_matrix(b, "v"), _matrix(b, "w")]).T @ np.hstack([_matrix(b, "v"), _matrix(b, "w")]), (2 * n, 2 * n))
    values, vectors = _ritz(sums[:n, :n], (sums[:n, n:] + sums[n:, :n]) / 2)
    values, vectors = values[:k], vectors[:, :k]
    left = []
    for value, x in zip(values, vectors.T, strict=True):
        both = np.concatenate([-value * x, x])
        left.append(float(np.sqrt(max(0.0, both @ sums @ both))))
    folder = f"{tables.folder}/vectors"
    _turned(pairs, "v", vectors, "v").write.parquet(folder)
    return values, np.array(left), tables.spark.read.parquet(folder)


def heat_by_basis(values: np.ndarray, vectors: DataFrame, seeds: DataFrame, time: float) -> DataFrame:
    """exp(-time * L) applied to seed vectors (``query_id``, ``i``, ``s``) as far as the eigenpairs go: (``query_id``, ``i``, ``s``) for every node."""
    k = len(values)
    parts = seeds.join(vectors, "i").groupBy("query_id").agg(*(F.sum(F.col("s") * F.col("v")[c]).alias(f"c{c}") for c in range(k)))
    heat = sum((F.col("v")[c] * F.col(f"c{c}") * float(np.exp(-time * values[c])) for c in range(k)), F.lit(0.0))
    # One row for each query of the batch meets every node: the result has that many rows.
    return vectors.join(F.broadcast(parts)).select("query_id", "i", heat.alias("s"))
