"""Near duplicates by b-bit MinHash.

A document is the set of its distinct word shingles. Equal sets are one node. Each node has bands of ``ROWS`` minima; nodes
that share the minima of a band (a bucket) are candidates for each other. All minima are kept by their low ``BITS`` bits,
packed into words; the number of equal fields, counted by bit operations and corrected for equality by chance, estimates
the similarity. What is not clearly below the threshold is confirmed on the full sets.

1. The nodes of a bucket are compared with the least of them. Components of these links are classes, so that a group of
   copies of any size is one class after as many comparisons as it has nodes.
2. Only buckets with several classes are left. Their nodes are dealt into blocks of bounded size, those of a large class
   apart, and blocks are compared with each other but for those of one class, first by signatures alone; the sets of
   nodes with a pair that passes are then sent to the same blocks. Links are reduced to a spanning forest within a
   block, and components of all links are the classes of near duplicates.

The bands are as many as the threshold needs for a pair at it to share none with probability below ``MISS``: 24 bands of 5
rows at a similarity of 0.85 (7.7e-7), 36 at 0.80 (6.2e-7). The estimate discards a pair at the threshold with probability
below 1e-6 (five standard deviations).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import binary_array, files_for, flat, keep_rows, released, row_keys, slices, written
from ._graph import components
from ._text import mix, shingles, word_hashes

SHINGLE = 5
#: Bands at 0.85, and the rows of a band at any threshold.
BANDS, ROWS = 24, 5
#: A pair at the threshold shares no band with a probability below this.
MISS = 8e-7
#: Low bits of each minimum that are compared. Fields of 4 bits, 16 in a 64-bit word.
BITS = 4
#: Nodes of a block; larger groups of candidates are compared block against block.
BLOCK = 2048
DEVIATIONS = 5

_N = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(8))
_MULTIPLY = _rng.integers(1, 2**63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(1, 2**63, _N, dtype=np.uint64)
_ONES = np.uint64(0x1111111111111111)


def bands_for(percent: int) -> int:
    """How many bands of ``ROWS`` a threshold needs."""
    share = (percent / 100) ** ROWS
    return 1 if share >= 1 else math.ceil(math.log(MISS) / math.log1p(-share))


@functools.cache
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and turns of ``n`` minima; fewer are the first of more."""
    more = np.random.Generator(np.random.PCG64(80)).integers(1, 2**63, (max(n - _N, 0), 2), dtype=np.uint64)
    multiply = np.concatenate([_MULTIPLY, more[:, 0] * np.uint64(2) + np.uint64(1)])
    return multiply[:n], np.concatenate([_TURN, more[:, 1]])[:n]


def minima(sets: np.ndarray, starts: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(sets, bands x rows) minima; sets stand one after another and none is empty."""
    multiply, turn = _factors(bands * ROWS)
    out = np.empty((len(starts) - 1, bands * ROWS), np.uint64)
    for k in range(bands * ROWS):
        out[:, k] = np.minimum.reduceat((sets ^ turn[k]) * multiply[k], starts[:-1])
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    """(sets, bands) hashes of the minima of each band; different bands never share one but by chance."""
    bands = found.shape[1] // ROWS
    keys = np.full((len(found), bands), np.uint64(0))
    for r in range(ROWS):
        keys = mix(keys + found[:, r::ROWS] + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys


def signatures(found: np.ndarray) -> np.ndarray:
    """(sets, words) words with the low bits of all minima, 16 in each; unused fields are 0 in all."""
    # The low bits of a product depend on few bits of the set's hashes, so those of the mixed minimum are kept.
    n = found.shape[1]
    n_words = -(-n // 16)
    low = np.zeros((len(found), 16 * n_words), np.uint64)
    low[:, :n] = mix(found) & np.uint64(15)
    return np.bitwise_or.reduce(low.reshape(len(found), n_words, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2)


def equal_fields(one: np.ndarray, many: np.ndarray, n: int = _N) -> np.ndarray:
    """Of ``n`` fields, those equal in ``one`` and each of ``many``."""
    x = one ^ many
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return n - np.bitwise_count(x & _ONES).sum(1, dtype=np.int64)


def estimate(fields: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal fields, less what is equal by chance."""
    chance = 2.0**-BITS
    return (fields / _N - chance) / (1 - chance)


def least_fields(percent: int) -> int:
    """Equal fields below which a pair is clearly under ``percent`` of similarity."""
    chance, n = 2.0**-BITS, bands_for(percent) * ROWS
    q = chance + (1 - chance) * percent / 100
    return int(np.floor(n * q - DEVIATIONS * np.sqrt(n * q * (1 - q))))


def _rest(i: int, root: np.ndarray, side: np.ndarray, size: np.ndarray, signature: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows after ``i`` of another class, and another side if there are two, that may be similar enough, and their fields."""
    rest = np.arange(i + 1, len(root))
    rest = rest[(root[rest] != root[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
    if side.min() != side.max():
        rest = rest[side[rest] != side[i]]
    fields = equal_fields(signature[i], signature[rest], bands_for(percent) * ROWS)
    return rest[fields >= least_fields(percent)], fields[fields >= least_fields(percent)]


def block_links(node: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int, root: np.ndarray | None = None, signature: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the rows of a block.

    ``side``: 0 or 1; only rows on different sides are compared, unless all are on one. ``root``: classes known before.
    """
    m = len(node)
    if m < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    if signature is None:
        signature = signatures(minima(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), bands_for(percent)))
    root = np.arange(m) if root is None else np.unique(root, return_inverse=True)[1]
    links = []
    for i in range(m - 1):
        rest, fields = _rest(i, root, side, size, signature, percent)
        rest = rest[np.argsort(-fields, kind="stable")]
        while len(rest):
            now, rest = rest[:32], rest[32:]
            both = np.array([_common(sets[i], sets[j]) for j in now], np.int64)
            for j in now[100 * both >= percent * (size[now] + size[i] - both)]:
                if root[j] != root[i]:
                    links.append((int(node[i]), int(node[j])))
                    root[root == root[j]] = root[i]
            rest = rest[root[rest] != root[i]]
    return links


def passing(side: np.ndarray, size: np.ndarray, root: np.ndarray, signature: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a block have another, of another class, that their signatures don't rule out."""
    out = np.zeros(len(size), bool)
    for i in range(len(size) - 1):
        rest, _ = _rest(i, root, side, size, signature, percent)
        out[rest] = True
        out[i] |= len(rest) > 0
    return out


def star_links(size: np.ndarray, sets: list[np.ndarray], signature: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of a block are linked to its first."""
    rest, _ = _rest(0, np.arange(len(size)), np.zeros(len(size), int), size, signature, percent)
    both = np.array([_common(sets[0], sets[j]) for j in rest], np.int64)
    return rest[100 * both >= percent * (size[rest] + size[0] - both)]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def shingle_sets(docs: DataFrame, text: str = "text", with_sets: bool = False, bands: int = BANDS) -> DataFrame:
    """``docs`` without the text, with ``n_shingles``, ``set_key`` (digest; null if empty) and ``bands`` (array<long>), or with
    ``signature`` (binary) and the sets themselves (binary, sorted 64-bit hashes) in place of the bands."""
    kept = [c for c in docs.columns if c != text]
    added = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType())]
    added += [T.StructField("signature", T.BinaryType()), T.StructField("shingles", T.BinaryType())] if with_sets else [T.StructField("bands", T.ArrayType(T.LongType()))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found, starts = shingles(*word_hashes(*flat(batch.column(text))), SHINGLE)
                size = np.diff(starts)
                raw = found.astype("<u8").tobytes()
                parts = [raw[8 * a : 8 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                key = pa.array([xxhash.xxh3_128_digest(p) if p else None for p in parts], pa.binary())
                full = size > 0
                least = minima(found, np.concatenate([starts[:-1][full], starts[-1:]]), bands) if full.any() else np.zeros((0, bands * ROWS), np.uint64)
                if with_sets:
                    signed = iter(signatures(least).astype("<u8"))
                    last = [binary_array([next(signed).tobytes() if f else b"" for f in full.tolist()]), binary_array(parts)]
                else:
                    offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                    last = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(band_keys(least).astype(np.int64).ravel()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(size), key, *last], [*kept, *(f.name for f in added)])

    schema = T.StructType([*(docs.schema[c] for c in kept), *added])
    return docs.select(*[F.col(f"`{c}`") for c in kept], text).mapInArrow(released(kernel), schema)


def _by_task(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each key, one after another; the batches are sorted by the keys."""
    open_key, rows = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*keys, *values)]
        for r in zip(*columns, strict=True):
            if r[: len(keys)] != open_key:
                if len(rows) > 1:
                    yield open_key, rows
                open_key, rows = r[: len(keys)], []
            rows.append(r[len(keys) :])
    if len(rows) > 1:
        yield open_key, rows


def _signed(rows: list[tuple], k: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), "<u8").reshape(len(rows), -1)


def _star(buckets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between the least node of a bucket and others of it. A leader of many is sent to several tasks."""
    leaders = buckets.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    pairs = buckets.join(leaders, "key").where("node <> a").select("a", "node").distinct()
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    followers = pairs.join(blocks, "a").select("a", "node", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(1).alias("place"))
    leading = blocks.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("place"))
    rows = followers.unionByName(leading).join(members.select("node", "n_shingles", "signature", "shingles"), "node")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, _), rows in _by_task(batches, ["a", "block"], ["place", "node", "n_shingles", "signature", "shingles"]):
            if rows[0][0] != 0:
                continue
            hit = star_links(np.array([r[2] for r in rows]), [np.frombuffer(r[4], "<u8") for r in rows], _signed(rows, 3), percent).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([a] * len(hit), pa.int64()), pa.array([rows[j][1] for j in hit], pa.int64())], ["a", "b"])

    ordered = rows.repartition("a", "block").sortWithinPartitions("a", "block", "place", "node")
    return ordered.select("a", "block", "place", "node", "n_shingles", "signature", "shingles").mapInArrow(released(kernel), "a long, b long")


def _blocks(buckets: DataFrame, classes: DataFrame, files: int) -> DataFrame:
    """(``key``, ``left``, ``right``, ``side``, ``node``, ``root``): the nodes of buckets that have several classes, once for
    each pair of blocks they are compared in."""
    placed = buckets.join(classes, "node").select("key", "node", "root")
    per_class = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    small = F.col("c") <= BLOCK
    per_key = per_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum(F.when(small, F.col("c")).otherwise(0)).alias("few")).where("classes > 1")
    large = per_class.where(~small)
    placed = placed.join(per_key.select("key", "few"), "key").join(large, ["key", "root"], "left")
    # A block is (0, its number) where it has several classes, and (1 + class, its number) for a part of a large one.
    own = F.when(F.col("c").isNull(), F.struct(F.lit(None).cast("long").alias("of"), F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), F.ceil(F.col("few") / BLOCK))).cast("long").alias("no")))
    own = own.otherwise(F.struct(F.col("root").alias("of"), F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK)).cast("long").alias("no")))
    placed = written(placed.select("key", "node", "root", own.alias("own")), "placed", files)
    lists = placed.groupBy("key").agg(F.collect_set("own").alias("all"))
    others = F.filter("all", lambda q: q["of"].isNull() | F.col("own.of").isNull() | (q["of"] != F.col("own.of")))
    rows = placed.join(lists, "key").select("key", "node", "root", "own", F.explode(others).alias("other"))
    left, right = F.least("own", "other"), F.greatest("own", "other")
    return rows.select("key", left.alias("left"), right.alias("right"), (F.col("own") != left).cast("int").alias("side"), "node", "root")


def _across(rows: DataFrame, members: DataFrame, percent: int, files: int) -> DataFrame:
    """Links (``a``, ``b``) between classes in the blocks of ``rows``."""
    task = ["key", "left_of", "left_no", "right_of", "right_no"]
    flatter = rows.select("key", "left.of", "left.no", F.col("right.of").alias("right_of"), F.col("right.no").alias("right_no"), "side", "node", "root")
    flatter = flatter.withColumnRenamed("of", "left_of").withColumnRenamed("no", "left_no")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(c, pa.int64()) for c in task] + [("side", pa.int32()), ("node", pa.int64()), ("root", pa.int64())])
        for key, found in _by_task(batches, task, ["side", "node", "root", "n_shingles", "signature"]):
            side, node, root, size = (np.array([r[k] for r in found]) for k in range(4))
            keep = np.flatnonzero(passing(side, size, root, _signed(found, 4), percent)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(keep), pa.int64()) for x in key] + [pa.array([found[j][k] for j in keep], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], schema=kinds)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _by_task(batches, task, ["side", "node", "root", "signature", "shingles"]):
            side, node, root = (np.array([r[k] for r in found]) for k in range(3))
            links = block_links(node, side, [np.frombuffer(r[4], "<u8") for r in found], percent, root, _signed(found, 3))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    def dealt(rows: DataFrame, more: list[str]) -> DataFrame:
        rows = rows.join(members.select("node", *more), "node").repartition(*task).sortWithinPartitions(*task, "node")
        return rows.select(*task, "side", "node", "root", *more)

    schema = "key long, left_of long, left_no long, right_of long, right_no long, side int, node long, root long"
    kept = written(dealt(flatter, ["n_shingles", "signature"]).mapInArrow(released(passed), schema), "passing", files)
    return dealt(kept, ["signature", "shingles"]).mapInArrow(released(kernel), "a long, b long")


def near_classes(docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and ``_id`` and ``_th`` of the row.

    Two documents are linked if their shingles in common are ``percent`` of all theirs or more; ``component_id`` is the least id
    that links lead to. Null and empty texts, and texts without words, are linked with nothing, copies of theirs
    included. A null id counts as the least long. Rows repeated with one id are kept alike (``keep_rows`` leaves one).
    An empty table gives no rows; other columns of ``docs`` are left out.
    """
    files = files_for(docs, text)
    keyed = docs.withColumns(row_keys(doc_id, text))
    rows = written(shingle_sets(keyed.select(F.col(doc_id).alias("doc_id"), "_rg_id", "_rg_th", F.col(text).alias("text")), bands=bands_for(percent)), "rows", files)
    sets = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("_rg_id", "_rg_th")).alias("rep"), F.first("bands").alias("bands"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets", files)

    buckets = sets.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = written(buckets.join(shared, "key").select("key", "node"), "buckets", files)
    near = sets.join(buckets.select("node").distinct(), "node").select("node", "rep._rg_id", "rep._rg_th")
    texts = keyed.select("_rg_id", "_rg_th", F.col(text).alias("text")).join(near, ["_rg_id", "_rg_th"]).select("node", "text")
    # Rows repeated in full give a node more than once.
    members = written(shingle_sets(texts, with_sets=True, bands=bands_for(percent)).dropDuplicates(["node"]), "members", files)
    links = written(_star(buckets, members, percent), "links", files)
    first = written(components(links, files), "first", files)
    classes = members.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    more = written(_across(_blocks(buckets, classes, files), members, percent, files), "links", files)
    if not more.isEmpty():
        classes = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), files)
    else:
        classes = first

    ids = sets.select("set_key", "node", "rep._rg_id").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = written(ids, "classes", files)
    least = ids.groupBy("root").agg(F.min("_rg_id").alias("component_id"))
    ids = written(ids.join(least, "root").select("set_key", "component_id"), "classes", files)
    out = rows.drop("bands").join(ids, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id", "_rg_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("_rg_id") == F.col("component_id")).alias("kept"), "_rg_id", "_rg_th")


def near_dedup(docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` of which each class of near duplicates keeps one, that with the least id."""
    return keep_rows(docs, near_classes(docs, percent, text, doc_id).where("kept"), text)
