"""Shards of nearly equal bytes by a minimax contiguous partition.

Groups are equal texts and are never split. They stand in the order of a 64-bit hash of the text, so that a
shard is a range of hashes and a row finds its shard from the cuts alone, without a join. The smallest
capacity that lets ``n_shards`` consecutive runs hold all groups is found by binary search; a capacity is checked
greedily, filling each shard as far as it goes. Under that capacity the cuts are then made as near to equal shares as it
allows.

The driver never holds all groups. It holds sizes of hash ranges, at most ``MAX_BLOCKS`` at a time, and looks
closer only where that matters: first at ranges that are large, then at those in which a cut can fall.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

#: Hash bits of the first ranges, and by how many a range is divided when looked at closer.
FIRST_BITS, MORE_BITS = 14, 14
#: Rows of the ranges whose single groups may come to the driver at once.
MAX_BLOCKS = 1 << 19
#: Sub-buckets in which the rows of a shard are numbered, for each shuffle partition.
BUCKETS = 4


class _Blocks:
    """Hash ranges in order: first hash (unsigned), bits that are fixed, bytes and rows."""

    def __init__(self, low, bits, size, rows):
        order = np.argsort(low, kind="stable")
        self.low, self.bits, self.size, self.rows = (np.asarray(x)[order] for x in (low, bits, size, rows))
        self.atomic = self.bits == 64

    def ends(self) -> np.ndarray:
        return np.cumsum(self.size)


def greedy(ends: np.ndarray, capacity: int, n_shards: int) -> list[int] | None:
    """Fill each shard up to ``capacity``; the number of items before each cut, or None if ``n_shards`` don't hold all.

    ``ends`` are running totals of the item sizes.
    """
    cuts, done, at = [], 0, 0
    for _ in range(n_shards):
        at = int(np.searchsorted(ends, done + capacity, side="right"))
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (n_shards - len(cuts))
        done = int(ends[at - 1]) if at else 0
    return None


def smallest_capacity(sizes: np.ndarray, n_shards: int) -> int:
    """The least capacity with which consecutive runs of ``sizes`` fit into ``n_shards``, by binary search."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    low, high = max(int(sizes.max()) if len(sizes) else 0, -(-total // n_shards)), total
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, n_shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def near_equal(ends: np.ndarray, capacity: int, n_shards: int) -> list[int]:
    """Cuts under ``capacity`` that lie as near to equal shares as it allows, so that no shard is left small at the end."""
    before = np.concatenate([[0], ends])
    least = [len(ends)] * (n_shards + 1)  # the i-th cut can't come earlier, or the rest wouldn't fit
    for i in range(n_shards - 1, 0, -1):
        least[i] = int(np.searchsorted(before, before[least[i + 1]] - capacity, side="left"))
    cuts, at = [], 0
    for i in range(1, n_shards):
        most = int(np.searchsorted(before, before[at] + capacity, side="right")) - 1
        ideal = before[-1] * i / n_shards
        c = int(np.searchsorted(before, ideal))
        if c and ideal - before[c - 1] < before[min(c, len(ends))] - ideal:
            c -= 1
        at = min(max(c, least[i], at), most)
        cuts.append(at)
    return [*cuts, len(ends)]


def _suspects(b: _Blocks, n_shards: int) -> np.ndarray:
    """Ranges that must be looked at closer before the cuts are known."""
    wide = ~b.atomic & (b.rows > 1)
    large = wide & (b.size * (4 * n_shards * 64) > b.size.sum())
    if large.any():
        return large
    ends = b.ends()
    total = int(ends[-1])
    high = smallest_capacity(b.size, n_shards)  # cuts at the known bounds only: feasible
    low = max(-(-total // n_shards), int(b.size[~wide].max()) if (~wide).any() else 0)
    inside = np.zeros(len(ends), bool)
    # The i-th cut of any capacity between low and high lies between these two.
    begin = end = 0
    for _ in range(n_shards):
        begin = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + low, side="right"))
        end_size = (int(ends[end - 1]) if end else 0) + high
        end = min(len(ends), int(np.searchsorted(ends, end_size, side="left")) + 1)
        inside[max(0, begin - 1) : end] = True
        if begin >= len(ends):
            break
    return inside & wide


def cut_hashes(sized: DataFrame, n_shards: int) -> tuple[list[int], int]:
    """The first hash (unsigned) of each shard but the first, and the capacity; ``sized`` has ``h`` and ``size``."""

    def blocks(rows: DataFrame, bits: int) -> list:
        key = F.shiftrightunsigned("h", 64 - bits) if bits < 64 else F.col("h")
        return rows.groupBy(key.alias("k")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()

    def table(found: list, bits: int):
        k = np.array([r["k"] for r in found], np.int64).astype(np.uint64)
        low = k << np.uint64(64 - bits) if bits < 64 else k
        return low, np.full(len(k), bits), np.array([r["size"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)

    b = _Blocks(*table(blocks(sized, FIRST_BITS), FIRST_BITS))
    if not len(b.low):
        return [0] * (n_shards - 1), 0
    while (closer := _suspects(b, n_shards)).any():
        bits = int(b.bits[closer].min())
        closer &= b.bits == bits
        many = np.cumsum(b.rows * closer) <= MAX_BLOCKS
        to = 64 if (many | ~closer).all() else min(64, bits + MORE_BITS)
        chosen = closer if to == 64 else closer & (np.cumsum(closer) <= MAX_BLOCKS >> MORE_BITS)
        spark = sized.sparkSession
        keys = spark.createDataFrame([(int(x),) for x in (b.low[chosen] >> np.uint64(64 - bits)).astype(np.int64)], "k long")
        part = sized.join(F.broadcast(keys), F.shiftrightunsigned("h", 64 - bits) == F.col("k"), "left_semi")
        new = table(blocks(part, to), to)
        b = _Blocks(*(np.concatenate([x[~chosen], y]) for x, y in zip((b.low, b.bits, b.size, b.rows), new, strict=True)))
    capacity = smallest_capacity(b.size, n_shards)
    cuts = near_equal(b.ends(), capacity, n_shards)
    return [int(b.low[c]) if c < len(b.low) else 2**64 for c in cuts[:-1]], capacity


def shard(docs: DataFrame, n_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text plus 1), ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (0, 1, ...
    in each shard).

    The largest shard is as small as runs of whole groups in hash order allow. Null and empty texts are one
    group of size 1 a row. Rows repeated in full get slots of their own; a null id is numbered like any other.
    An empty table gives no rows. Columns of these names that ``docs`` brings along are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot", "_rg_h", "_rg_b")
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"size": F.octet_length(t).cast("long") + 1, "_rg_h": F.xxhash64(t)})
    n_buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = keyed.withColumn("_rg_b", F.pmod(F.xxhash64(F.lit(7), F.col(doc_id), "_rg_h"), F.lit(n_buckets)).cast("int"))
    sized = written(keyed.select(F.col("_rg_h").alias("h"), "size", F.col("_rg_b").alias("b")), "sizes")
    cuts, _ = cut_hashes(sized, n_shards)
    signed = [c - 2**63 for c in cuts]  # unsigned order is signed order after the top bit is flipped

    def shard_of(h):
        flipped = h.bitwiseXOR(F.lit(-(2**63)))
        return sum((flipped >= F.lit(c)).cast("int") if c < 2**63 else F.lit(0) for c in signed) + F.lit(0)

    counts = sized.groupBy(shard_of(F.col("h")).alias("s"), "b").count().collect()  # n_shards * n_buckets at most
    base, seen = [], [0] * n_shards
    for s, b, n in sorted(tuple(r) for r in counts):
        base.append((s, b, seen[s]))
        seen[s] += n
    offsets = spark.createDataFrame(base, "shard int, _rg_b int, _rg_base long")
    w = Window.partitionBy("shard", "_rg_b").orderBy(doc_id, "_rg_h")
    placed = keyed.withColumn("shard", shard_of(F.col("_rg_h")).cast("int")).withColumn("_rg_r", F.row_number().over(w))
    placed = placed.join(F.broadcast(offsets), ["shard", "_rg_b"], "left")
    return placed.withColumn("slot", F.col("_rg_base") + F.col("_rg_r") - 1).select(*[F.col(f"`{c}`") for c in docs.columns], "size", "shard", "slot")
