"""Scores, knobs, renderings and cadences as expressions, and small roll-ups of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import estimated_tokens, posterior_mean
from ..sources.model import Store

# Fixed values.
HALF_LIFE, ANCHORS, DEPTHS, GATE, TEMPERATURES = (3 * 86400.0, 14 * 86400.0), (1, 10), (1, 6), (20, 320), (0.5, 2.0)
HEADLINE_LENGTH, TOPIC_LENGTH = 240, 80
RECENCY, SUPERSESSION_FLOOR, PERSISTENCE_FLOOR = 1 / 180, 1e-6, 1e-3
BOUNDARY_PHRASES = (
    "done", "thanks", "thank you", "ok", "okay", "ok thanks", "okay thanks", "ok cool", "okay cool", "ok great", "okay great", "great", "awesome", "perfect", "nice", "got it", "sounds good", "good", "good to go", "all good", "looks good", "next", "next task", "next step", "move on", "ship it", "merge it",
)
BOUNDARY_PREFIXES = ("switch to ", "lets switch to ", "let us switch to ", "lets move on ", "let us move on ", "now lets ", "now let us ", "moving on to ", "lets do ", "let us do ", "next lets ", "next let us ")
BOUNDARY_LENGTH = 80
EVERY, CONTEXT_BYTES, VELOCITY, WINDOW, SHARE = 15, 10_000, 500, 10, 0.6


def _between(value: Column, ends: tuple[float, float]) -> Column:
    """The number that a value of 0 to 1 stands for on a logarithmic scale."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.exp(F.lit(math.log(ends[0])) + v * (math.log(ends[1]) - math.log(ends[0])))


def half_life(value: Column) -> Column:
    return _between(value, HALF_LIFE)


def temperature(value: Column) -> Column:
    """The temperature of the posterior term; 1 where the knob isn't installed (null)."""
    return F.when(value.isNull(), 1.0).otherwise(_between(value, TEMPERATURES))


def anchor_weight(value: Column) -> Column:
    return F.bround(_between(value, ANCHORS), 0).cast("long")


def depth(value: Column) -> Column:
    return F.bround(_between(value, DEPTHS), 0).cast("long")


def gate_threshold(value: Column) -> Column:
    return F.bround(_between(value, GATE), 0).cast("long")


def relevance(mean: Column, overlap: Column) -> Column:
    return mean * overlap


def locked_floor(score: Column, lock_level: Column, floor: float) -> Column:
    return F.when(lock_level != "none", F.greatest(score, F.lit(floor))).otherwise(score)


def superseded_demotion(score: Column, superseded: Column, factor: float) -> Column:
    return F.when(superseded, score * factor).otherwise(score)


def recency(score: Column, age_days: Column, rate: float = RECENCY) -> Column:
    return score * F.exp(-rate * F.greatest(F.lit(0.0), age_days))


def supersession_penalty(superseded: Column, factor: float) -> Column:
    """What is added to a logarithmic score of a superseded belief."""
    return F.when(superseded, min(0.0, math.log(max(factor, SUPERSESSION_FLOOR)))).otherwise(0.0)


def persistence_penalty(score: Column) -> Column:
    """What is added to a logarithmic score by how durable a belief's entities are; nothing where it has none."""
    return F.coalesce(F.least(F.lit(0.0), F.log(score + PERSISTENCE_FLOOR)), F.lit(0.0))


def floor_score(match: Column, alpha: Column, beta: Column) -> Column:
    """A match of 0 to 1 times the better half of the mean."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), match)) * (0.5 + 0.5 * posterior_mean(alpha, beta))


# ---- renderings ---------------------------------------------------------------------------------------------------------


def headline(text: Column) -> Column:
    """The first sentence, or as many whole words as ``HEADLINE_LENGTH`` holds; an ellipsis says that there is more."""
    end = F.when(text.rlike(r"(?s)\.[ \n]"), F.length(F.regexp_extract(text, r"(?s)^(.*?\.)[ \n]", 1))).otherwise(0)
    more = F.when(end < F.length(text), "…").otherwise("")
    head = F.substring(text, 1, HEADLINE_LENGTH + 1)
    space = F.locate(" ", F.reverse(head))
    cut = F.when((space > 0) & (HEADLINE_LENGTH + 1 - space > 0), HEADLINE_LENGTH + 1 - space).otherwise(HEADLINE_LENGTH)
    first = F.concat(F.rtrim(F.substring(text, F.lit(1), end)), more)
    return F.when((end > 0) & (end <= HEADLINE_LENGTH), first).when((F.length(text) <= HEADLINE_LENGTH) & (end == 0), text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), cut)), F.lit("…")))


def compressed(id: Column, text: Column, retention: Column) -> Column:
    """(``strategy``, ``tokens``): facts and unknowns as they are, snapshots as a headline, transients as a stub, if that costs no more."""
    cost, head = estimated_tokens(text), headline(text)
    stub = estimated_tokens(F.concat(F.lit("[stub: belief="), id, F.lit(" class=transient]")))
    strategy = F.when((retention == "transient") & (stub <= cost), "stub").when((retention == "snapshot") & (F.length(head) < F.length(text)) & (estimated_tokens(head) <= cost), "headline").otherwise("verbatim")
    return F.struct(strategy.alias("strategy"), F.when(strategy == "stub", stub).when(strategy == "headline", estimated_tokens(head)).otherwise(cost).alias("tokens"))


def topic(text: Column) -> Column:
    """A text on one line: its first sentence if that is short, else its beginning."""
    line = F.replace(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit('"'), F.lit("'"))
    at = F.locate(". ", line)
    short = F.when((at > 0) & (at <= TOPIC_LENGTH), F.substring(line, F.lit(1), at)).otherwise(line)
    return F.when(F.length(short) <= TOPIC_LENGTH, short).otherwise(F.concat(F.rtrim(F.substring(short, 1, TOPIC_LENGTH)), F.lit("…")))


def manifest_line(word: str, id: Column, text: Column) -> Column:
    """A reference (``ref``) or a reminder (``seen``) of a belief on one line."""
    return F.concat(F.lit(word + " "), id, F.lit(': "'), topic(text), F.lit('"'))


# ---- cadences -------------------------------------------------------------------------------------------------------------


def is_boundary(text: Column) -> Column:
    """A short prompt that ends one piece of work or opens the next."""
    n = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))
    starts = F.lit(False)
    for p in BOUNDARY_PREFIXES:
        starts = starts | n.startswith(p)
    return (n != "") & (F.length(n) <= BOUNDARY_LENGTH) & (n.isin(*BOUNDARY_PHRASES) | starts)


def is_substantive(text: Column) -> Column:
    return (F.trim(text) != "") & ~is_boundary(text)


def cadences(ticks: DataFrame) -> DataFrame:
    """Policies at each tick (``session_id``, ``feedback_id``, ``matters``, ``bytes``) of a session."""
    w = Window.partitionBy("session_id").orderBy("feedback_id")
    fire, total = F.row_number().over(w), F.sum("bytes").over(w)
    rows = ticks.select("session_id", "feedback_id", fire.alias("fire"), total.alias("total"), F.avg(F.col("matters").cast("double")).over(w.rowsBetween(1 - WINDOW, 0)).alias("share"))
    speed = F.when(F.col("fire") > 5, (F.col("total") - F.lag("total", 5).over(w)) / 5.0 >= VELOCITY).otherwise(False)
    return rows.select("session_id", "feedback_id", (F.col("fire") % EVERY == 0).alias("p1"), (F.col("total") >= CONTEXT_BYTES).alias("p2"), speed.alias("velocity"), ((F.col("share") >= SHARE) & (F.col("fire") >= WINDOW)).alias("substantive"))


def agreement(rows: DataFrame, by: str, one: str, other: str) -> DataFrame:
    """How often two policies fire, both fire, and agree."""
    a, b = F.col(one), F.col(other)
    return rows.groupBy(by).agg(F.count_if(a).alias("p1"), F.count_if(b).alias("p2"), F.count_if(a & b).alias("both_fire"), F.count_if(a == b).alias("agree"), F.count("*").alias("n"))


def phantoms(store: Store, pairs: DataFrame, generator: str) -> DataFrame:
    """Phantoms of pairs (``x`` < ``y``) of beliefs that exist, by the hash of their parts; those that exist already are left out."""
    ids = store.beliefs.select("id")
    rows = pairs.join(ids.withColumnRenamed("id", "x"), "x", "left_semi").join(ids.withColumnRenamed("id", "y"), "y", "left_semi")
    key = F.sha2(F.concat(F.lit("wonder_ingest:"), "x", F.lit(":"), "y", F.lit("|" + generator)), 256)
    return rows.select(key.alias("content_hash"), "x", "y").join(store.beliefs.select("content_hash"), "content_hash", "left_anti")
