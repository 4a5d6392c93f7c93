"""Removal of repeated passages of lines, by content-defined chunks of lines, in DataFrame operations only.

Each line is hashed, and a rolling window of three hashes picks the boundaries: every line whose hash isn't the single greatest of its
window. A chunk is framed at a boundary: the boundary line with the neighbour that made it one. Of two neighbouring lines the one
with the lesser hash is a boundary by the other, whatever stands around them, so that the lines of a repeated passage are chunked
alike wherever it stands, and no two lines of it are without a chunk. Chunks that stand elsewhere before, anywhere in the corpus,
are removed after their bytes are compared; those that overlap make up the common run to its full length.

Only hashes meet in the first aggregation, which sums copies before the shuffle. Bytes move for the chunks that it leaves.

``line_runs`` removes repeated lines of many words too: all pairs of neighbouring lines are compared, by their MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import row_keys, written

#: A line of more words than this is a passage by itself.
MANY_WORDS = 50


def line_chunks(lines: Column) -> Column:
    """An array of the chunks (``i``: the number of the first of two lines, ``chunk``: a hash over their hashes) of an array of lines; chunks of
    spaces only are left out."""

    def framed(x: Column) -> Column:
        def at_boundary(i: Column) -> Column:
            """The chunks that the boundary line ``i`` frames: with the line before, with the line after."""
            own, before, after = F.get(x["h"], i), F.get(x["h"], i - 1), F.get(x["h"], i + 1)
            said = F.get(x["said"], i)
            with_before = F.when((own < before) & (said | F.get(x["said"], i - 1)), F.struct((i - 1).alias("i"), F.xxhash64(before, own).alias("chunk")))
            with_after = F.when((own <= after) & (said | F.get(x["said"], i + 1)), F.struct(i.alias("i"), F.xxhash64(own, after).alias("chunk")))
            return F.array_compact(F.array(with_before, with_after))

        def is_boundary(i: Column) -> Column:
            own = F.get(x["h"], i)
            return (own < F.get(x["h"], i - 1)) | (own <= F.get(x["h"], i + 1))

        boundaries = F.filter(F.sequence(F.lit(0), F.size(x["h"]) - 1), is_boundary)
        return F.flatten(F.transform(boundaries, at_boundary))

    # The step stands in an array of one element, so that its value is made once and not wherever it is named.
    step = F.transform(F.array(lines), lambda a: F.struct(F.transform(a, lambda x: F.xxhash64(x)).alias("h"), F.transform(a, lambda x: F.trim(x) != "").alias("said")))
    return F.transform(step, framed)[0]


def _two_lines(lines: Column, i: Column) -> Column:
    return F.concat(F.get(lines, i), F.lit("\n"), F.get(lines, i + 1))


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` (lines) and ``kept_text``.

    A line goes if it is in a chunk that stands before; so a run of two lines or more goes to its full length. The first occurrence is
    that with the least id, then the earliest in the text; a null id is the least, a null text is one empty line. Rows repeated with
    one id and text keep or lose alike; rows of one id with different texts count as one place, so that a chunk at the same number
    in both is first in both. Chunks of spaces and line breaks only stay. A text that loses all its lines is empty. Columns of
    these names that ``docs`` brings along are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "kept_text")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    keyed = docs.withColumns(row_keys(doc_id, text))
    place = F.struct("_rg_id", "i")
    chunks = written(keyed.select("_rg_id", "_rg_th", F.inline(line_chunks(lines))), "line-chunks")
    several = chunks.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    found = written(chunks.join(several.select("chunk"), "chunk").select("_rg_id", "_rg_th", "i", "chunk"), "line-found")
    # The bytes of each: for most hashes there is one text, which the hash then names; those that stand for several are taken apart.
    wanted = found.groupBy("_rg_id", "_rg_th").agg(F.collect_set(F.struct("i", "chunk")).alias("_rg_found"))
    bodies = keyed.select("_rg_id", "_rg_th", lines.alias("lines")).join(wanted, ["_rg_id", "_rg_th"])
    bodies = bodies.select("_rg_id", "_rg_th", F.inline(F.transform("_rg_found", lambda x: F.struct(x["i"].alias("i"), x["chunk"].alias("chunk"), _two_lines(F.col("lines"), x["i"]).alias("body")))))
    texts = bodies.groupBy("chunk", "body").agg(F.min(place).alias("first"))
    named = written(texts.groupBy("chunk").agg(F.count("*").alias("texts"), F.min("first").alias("first")), "line-texts")
    again = found.join(named.where("texts = 1").select("chunk", "first"), "chunk")
    if not named.where("texts > 1").isEmpty():
        apart = named.where("texts > 1").select("chunk")
        again = again.unionByName(bodies.join(apart, "chunk", "left_semi").join(texts.join(apart, "chunk", "left_semi"), ["chunk", "body"]).drop("body"))
    again = again.where("_rg_id > first._rg_id OR i > first.i AND _rg_id = first._rg_id")
    lost = again.groupBy("_rg_id", "_rg_th").agg(F.flatten(F.collect_set(F.array(F.col("i"), F.col("i") + 1))).alias("_rg_lost"))
    return _without(docs, keyed, lines, lost)


def _without(docs: DataFrame, keyed: DataFrame, lines: Column, lost: DataFrame) -> DataFrame:
    """``docs`` without the lines whose numbers ``_rg_lost`` holds."""
    cut = keyed.join(lost, ["_rg_id", "_rg_th"], "left").withColumn("_rg_lines", lines)
    stays = F.array_except(F.sequence(F.lit(0), F.size("_rg_lines") - 1), F.coalesce("_rg_lost", F.array().cast("array<int>")))
    cut = cut.withColumn("_rg_stays", stays)
    return cut.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_rg_lines").cast("long").alias("n_lines"),
        (F.size("_rg_lines") - F.size("_rg_stays")).cast("long").alias("n_removed"),
        F.array_join(F.transform("_rg_stays", lambda i: F.get("_rg_lines", i)), "\n").alias("kept_text"),
    )


def line_windows(lines: Column) -> Column:
    """An array of (``i``, ``n``, ``body``): all pairs of neighbouring lines, and the lines of more than ``MANY_WORDS`` words."""

    def windows(x: Column) -> Column:
        def line(i: Column) -> Column:
            return F.struct(i.alias("i"), F.lit(1).alias("n"), F.get(x, i).alias("body"))

        def pair(i: Column) -> Column:
            return F.struct(i.alias("i"), F.lit(2).alias("n"), F.concat(F.get(x, i), F.lit("\n"), F.get(x, i + 1)).alias("body"))

        places = F.sequence(F.lit(0), F.size(x) - 1)
        long = F.filter(places, lambda i: (F.length(F.get(x, i)) > 2 * MANY_WORDS) & (F.regexp_count(F.get(x, i), F.lit(r"\S+")) > MANY_WORDS))
        return F.concat(F.transform(F.filter(places, lambda i: i < F.size(x) - 1), pair), F.transform(long, line))

    return F.transform(F.array(lines), windows)[0]


def line_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` (lines) and ``kept_text``.

    A line goes if it is part of a pair of neighbouring lines, or is a line of more than ``MANY_WORDS`` words, that stands
    before; so a run of two lines or more goes to its full length, whatever stands around it. The order, null ids, repeated
    rows and white space are as in ``line_dedup``. The first occurrence of a line's text never goes.
    """
    docs = docs.drop("n_lines", "n_removed", "kept_text")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    keyed = docs.withColumns(row_keys(doc_id, text))
    rows = keyed.select("_rg_id", "_rg_th", F.inline(line_windows(lines))).where("trim(replace(body, '\\n', ' ')) <> ''")
    rows = rows.select("_rg_id", "_rg_th", "i", "n", F.unhex(F.md5(F.col("body").cast("binary"))).alias("body_hash"))
    groups = rows.groupBy("body_hash").agg(F.min(F.struct("_rg_id", "i")).alias("first"), F.count("*").alias("times"))
    again = rows.join(written(groups.where("times > 1").select("body_hash", "first"), "line-runs"), "body_hash")
    again = again.where("_rg_id > first._rg_id OR i > first.i AND _rg_id = first._rg_id")
    lost = again.groupBy("_rg_id", "_rg_th").agg(F.flatten(F.collect_set(F.sequence("i", F.expr("i + n - 1")))).alias("_rg_lost"))
    return _without(docs, keyed, lines, lost)
