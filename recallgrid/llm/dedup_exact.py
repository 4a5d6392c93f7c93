"""Exact duplicates by content-defined chunk recipes.

A text, A-Z lower-cased, is cut where a rolling hash of its last 32 bytes has low bits of zero. A chunk is named by its
hash, and the names are verified: the bytes of each (hash, bytes) pair meet once in a shuffle, after every task has
dropped what it has sent before, and a hash that stands for several byte strings has them numbered. A text's recipe is
the list of its chunk names in order; recipes are compared, and the texts themselves do not move again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import binary_array, files_for, flat, keep_rows, released, row_keys, slices, written
from ._text import BYTE, LOWER

#: Least, usual and greatest bytes of a chunk.
LEAST, USUAL, MOST = 512, 2048, 16384
#: Bytes of chunks that a task remembers to send each once.
REMEMBER_BYTES = 24 << 20

_GEAR = (BYTE >> np.uint64(32)).astype(np.uint32)


def cuts(low: np.ndarray, bounds: np.ndarray, usual: int = USUAL, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each text; an empty text has none.

    The hash at a byte takes in the 32 bytes up to it. As no chunk is shorter than that, texts before have no effect.
    """
    h = _GEAR[low]
    for step in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
    marks = np.flatnonzero((h >> np.uint32(32 - (usual - least).bit_length() + 1)) == 0) + 1
    where = np.searchsorted(marks, bounds)
    out = []
    for i in range(len(bounds) - 1):
        at, end, found = int(bounds[i]), int(bounds[i + 1]), []
        for m in marks[where[i] : where[i + 1]].tolist():
            while m - at > most:
                at += most
                found.append(at)
            if m - at >= least:
                at = m
                found.append(at)
        while end - at > most:
            at += most
            found.append(at)
        if end > at:
            found.append(end)
        out.append(found)
    return out


def _name(chunk: bytes, hash_bytes: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:hash_bytes]


def recipes(docs: DataFrame, text: str = "text", hash_bytes: int = 16) -> DataFrame:
    """``docs`` with ``text_sha`` (binary, of the lower-cased text) and ``recipe`` (binary, the chunk hashes in order)."""
    names = docs.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = flat(batch.column(text))
                low = LOWER[data]
                view, shas, lists = low.tobytes(), [], []
                for i, ends in enumerate(cuts(low, bounds)):
                    starts = [int(bounds[i]), *ends[:-1]] if ends else []
                    shas.append(hashlib.sha256(view[bounds[i] : bounds[i + 1]]).digest())
                    lists.append(b"".join([_name(view[a:b], hash_bytes) for a, b in zip(starts, ends, strict=True)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, binary_array(shas), binary_array(lists)], [*names, "text_sha", "recipe"])

    extra = [T.StructField("text_sha", T.BinaryType()), T.StructField("recipe", T.BinaryType())]
    return docs.mapInArrow(released(kernel), T.StructType([*docs.schema.fields, *extra]))


def chunks(docs: DataFrame, text: str = "text", hash_bytes: int = 16) -> DataFrame:
    """(``name``, ``data``) of the chunks of all texts; a task sends a pair again only after much else."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, bytes] = {}
        held = 0
        for whole in batches:
            for batch in slices(whole, text):
                low, bounds = flat(batch.column(text))
                low = LOWER[low]
                view, keys, values = low.tobytes(), [], []
                for i, ends in enumerate(cuts(low, bounds)):
                    at = int(bounds[i])
                    for end in ends:
                        chunk = view[at:end]
                        at = end
                        key = _name(chunk, hash_bytes)
                        if sent.get(key) == chunk:
                            continue
                        if held > REMEMBER_BYTES:
                            sent.clear()
                            held = 0
                        sent[key] = chunk
                        held += len(chunk)
                        keys.append(key)
                        values.append(chunk)
                yield pa.RecordBatch.from_arrays([binary_array(keys), binary_array(values)], ["name", "data"])

    return docs.select(text).mapInArrow(released(kernel), "name binary, data binary")


def _ambiguous(docs: DataFrame, text: str, hash_bytes: int) -> DataFrame:
    """Verified identifiers of those chunks whose hash stands for several byte strings: ``name``, ``data``, ``number``."""
    pairs = chunks(docs, text, hash_bytes).repartition(F.col("name")).dropDuplicates(["name", "data"])
    several = written(pairs.groupBy("name").agg(F.count("*").alias("n"), F.collect_list("data").alias("data")).where("n > 1"), "ambiguous") if hash_bytes < 8 else None
    if several is None:
        # With long hashes a second byte string is next to impossible; gathering lists of all bytes would be a waste.
        names = written(pairs.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "ambiguous")
        if names.isEmpty():
            return names.select("name", F.lit(b"").alias("data"), F.lit(0).alias("number"))
        several = pairs.join(names, "name").groupBy("name").agg(F.collect_list("data").alias("data"))
    return several.select("name", F.posexplode(F.array_sort("data")).alias("number", "data"))


def identified(docs: DataFrame, text: str = "text", hash_bytes: int = 16) -> DataFrame:
    """The rows of ``docs`` without their text, with ``text_sha``, ``recipe`` of verified identifiers and ``_row``, written
    in the shared folder.

    ``recipe`` is followed by the numbers of chunks whose hash is ambiguous (place and number), so that equal recipes
    mean equal bytes.
    """
    made = recipes(docs, text, hash_bytes).drop(text)
    made = written(made.withColumn("_rg_row", F.monotonically_increasing_id()), "recipes", files_for(docs, text))
    ambiguous = _ambiguous(docs, text, hash_bytes)
    if ambiguous.isEmpty():
        return made
    ambiguous = written(ambiguous, "numbers")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, bounds = flat(batch.column(text))
                low = LOWER[data]
                view, rows = low.tobytes(), []
                for i, ends in enumerate(cuts(low, bounds)):
                    sha, at = hashlib.sha256(view[bounds[i] : bounds[i + 1]]).digest(), int(bounds[i])
                    for k, end in enumerate(ends):
                        rows.append((sha, k, _name(view[at:end], hash_bytes), view[at:end]))
                        at = end
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                types = [pa.binary(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["text_sha", "place", "name", "data"])

    placed = docs.select(text).mapInArrow(released(kernel), "text_sha binary, place int, name binary, data binary")
    numbers = (
        placed.join(ambiguous, ["name", "data"])
        .select("text_sha", "place", "number")
        .distinct()
        .groupBy("text_sha")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "number"))), lambda x: F.concat_ws(":", x["place"], x["number"])), ",").alias("_rg_numbers"))
    )
    return made.join(numbers, "text_sha", "left").withColumn("recipe", F.concat("recipe", F.coalesce(F.col("_rg_numbers").cast("binary"), F.lit(b"")))).drop("_rg_numbers")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, one of each group; columns as they are."""
    keyed = docs.select(doc_id, text).withColumns(row_keys(doc_id, text))
    return keep_rows(docs, exact_dedup(keyed, text, doc_id).where("kept"), text)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hash_bytes: int = 16) -> DataFrame:
    """One row for each of ``docs``: its columns but the text, ``text_sha`` (binary), ``keep_id``, ``group_size`` and ``kept``.

    Texts are equal if they are after A-Z is lower-cased; null counts as empty, and all empty texts are one group. Of each
    group exactly one row is kept: that with the largest id (null is least); of rows repeated with that id, any one. An
    empty table gives no rows. Columns of the names above that ``docs`` brings along are replaced.

    A group that holds much of the corpus is summed before the shuffle, and the join back to its rows is one that
    adaptive execution can split.
    """
    docs = docs.drop("text_sha", "recipe", "keep_id", "group_size", "kept", "_rg_row")
    made = identified(docs, text, hash_bytes)
    best = F.max(F.struct(F.col(doc_id).alias("id"), F.col("_rg_row").alias("row"))).alias("_rg_best")
    groups = written(made.groupBy("recipe").agg(best, F.count("*").alias("group_size")), "groups", files_for(docs, text))
    joined = made.join(groups, "recipe", "left")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return joined.select(*rest, "text_sha", F.col("_rg_best.id").alias("keep_id"), "group_size", (F.col("_rg_best.row") == F.col("_rg_row")).alias("kept"))
