"""Operators put together: audits of duplicates, lanes, routes and reports over a store."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import estimated_tokens, normalised_uncertainty, posterior_mean
from ..functions.text import title_tokens
from ..plans.session import new_folder
from ..sources.model import Store
from . import ledger, similarity
from .graph import VALENCE, components
from .retrieval import Index, top
from .scan import Ranges

# Fixed values.
RING_STEP, FULL_ANGLE = 480, 4294967295.0
MARKER = r"^([A-Z][A-Z_]*):(\S.*)$"


def near_pairs(rows: DataFrame, jaccard: float, ratio: float) -> DataFrame:
    """Pairs (``a`` < ``b``) of (``id``, ``text``) that are alike by their words and by edit distance."""
    sets = rows.select("id", title_tokens(F.col("text")).alias("t"))
    near = similarity.similar_to(sets.withColumnRenamed("id", "a"), None, "a", "b", jaccard)
    both = near.join(rows.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(rows.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "jaccard", F.round(similarity.edit_ratio(F.col("ta"), F.col("tb")), 6).alias("ratio")).where(F.col("ratio") >= ratio)


def consolidation(rows: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Components of pairs with ``least`` members or more, their medoid, and how many merging would remove."""
    found = components(pairs.select("a", "b"))
    size = found.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") >= least)
    members = found.join(size, "root").join(rows, "id").select(F.col("root").alias("cluster"), "members", "id", "text")
    medoids = similarity.medoids(members, "cluster", "id", "text")
    return medoids.join(size.withColumnRenamed("root", "cluster"), "cluster").select("cluster", "medoid", "members", (F.col("members") - 1).alias("would_remove"))


def entity_lane(store: Store, wanted: DataFrame, limit: int, budget: int) -> DataFrame:
    """The beliefs with most entities of each query, without locks, until the first that the budget doesn't hold."""
    hits = ledger.entity_overlap(store, wanted, limit)
    free = store.active.where("lock_level = 'none'").select(F.col("id").alias("belief_id"), estimated_tokens(F.col("content")).alias("tokens"))
    w = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.join(free, "belief_id").withColumn("spent", F.sum("tokens").over(w))
    return rows.where(F.col("spent") <= budget).select("query_id", "belief_id", "tokens", "spent")


def structural(store: Store, prompts: DataFrame) -> DataFrame:
    """For prompts (``prompt``, ``text``) of the form KIND:target the active beliefs that have such an edge to the target, by id."""
    t = F.trim("text")
    asked = prompts.select("prompt", F.regexp_extract(t, MARKER, 1).alias("type"), F.trim(F.regexp_extract(t, MARKER, 2)).alias("dst")).where(F.col("type").isin(*VALENCE))
    rows = store.edges.join(asked, ["type", "dst"]).join(store.active.select(F.col("id").alias("src")), "src", "left_semi")
    return rows.select("prompt", F.col("src").alias("id"), F.row_number().over(Window.partitionBy("prompt").orderBy("src")).alias("place"))


def covered_terms(index: Index, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(``query_id``, ``id``, ``term``, ``weight``): the query's terms that each hit has, and their inverse frequency."""
    asked = index.asked(queries)
    n, df = F.col("n"), F.col("df")
    weights = asked.join(index.frequencies_of(asked), "term").crossJoin(F.broadcast(index.totals.select("n")))
    weights = weights.select("query_id", "term", F.round(F.log(1 + (n - df + 0.5) / (df + 0.5)), 6).alias("weight"))
    return index.postings_of(asked).select("id", "term").join(weights, "term").join(hits.select("query_id", "id"), ["query_id", "id"])


def gaps(store: Store, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """For each query the share of its terms that the best ``k`` hits have, how many they lack, how uncertain the hits are and how many of them contradict
    each other."""
    hits = top(index.match(queries), k)
    terms = index.asked(queries).groupBy("query_id").agg(F.count("*").alias("terms"))
    covered = covered_terms(index, queries, hits).groupBy("query_id").agg(F.countDistinct("term").alias("covered"))
    facts = hits.join(store.beliefs.select("id", normalised_uncertainty(F.col("alpha"), F.col("beta")).alias("u")), "id").groupBy("query_id").agg(F.round(F.avg("u"), 6).alias("uncertainty"))
    e = store.edges.where("type = 'CONTRADICTS'").select("src", "dst").distinct()
    inside = e.join(hits.select("query_id", F.col("id").alias("src")), "src").join(hits.select("query_id", F.col("id").alias("dst")), ["query_id", "dst"])
    against = inside.groupBy("query_id").agg(F.countDistinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("contradictions"))
    rows = terms.join(covered, "query_id", "left").join(facts, "query_id", "left").join(against, "query_id", "left").na.fill(0, ["covered", "contradictions"])
    return rows.select("query_id", F.round(F.col("covered") / F.col("terms"), 6).alias("coverage"), (F.col("terms") - F.col("covered")).alias("uncovered"), "uncertainty", "contradictions")


# Below which coverage is low, above which a belief is uncertain, and how many axes there are at most.
LOW_COVERAGE, UNCERTAIN, MOST_AXES = 0.5, 0.7, 6


def research_axes(store: Store, index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(``query_id``, ``place``, ``axis``, ``context``): what to look for where a query's best ``k`` hits leave gaps. Two axes always; one each for contradictions among the hits, for
    uncertain hits, and for terms that no hit has."""
    hits = top(index.match(queries), k)
    unsure = hits.join(store.beliefs.where(normalised_uncertainty(F.col("alpha"), F.col("beta")) > UNCERTAIN).select("id"), "id").groupBy("query_id").agg(F.count("*").alias("unsure"))
    rows = gaps(store, index, queries, k).join(unsure, "query_id", "left").na.fill(0, ["unsure"])

    def axis(name: str, context: Column | str, where: Column | None = None) -> Column:
        made = F.struct(F.lit(name).alias("axis"), (F.lit(context) if isinstance(context, str) else context).alias("context"))
        return made if where is None else F.when(where, made)

    made = F.array_compact(
        F.array(
            axis("domain_research", "always-on"),
            axis("internal_gap_analysis", "always-on"),
            axis("contradiction_resolution", F.concat(F.lit("unresolved_contradicts_pairs="), "contradictions"), F.col("contradictions") > 0),
            axis("uncertainty_deep_dive", F.concat(F.lit("high_uncertainty_count="), "unsure"), F.col("unsure") > 0),
            axis("coverage_extension", F.concat(F.lit("query_term_coverage="), F.format_number("coverage", 2)), (F.col("coverage") < LOW_COVERAGE) | (F.col("uncovered") > 0)),
        )
    )
    return rows.select("query_id", F.posexplode(F.slice(made, 1, MOST_AXES)).alias("at", "a")).select("query_id", (F.col("at") + 1).alias("place"), "a.axis", "a.context")


def onboarding(store: Store, found: DataFrame, rejected: DataFrame) -> DataFrame:
    """How many of the texts found (``content_hash``) are beliefs, were rejected, or are new."""
    own = store.beliefs.select("content_hash").distinct().withColumn("own", F.lit(True))
    no = rejected.withColumn("no", F.lit(True))
    state = F.when(F.col("own"), "present").when(F.col("no"), "rejected").otherwise("new")
    return found.join(own, "content_hash", "left").join(no, "content_hash", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def canvas(nodes: DataFrame) -> DataFrame:
    """Places and colours of nodes (beliefs with a ``depth``)."""
    angle = F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("long") / FULL_ANGLE * 2 * math.pi
    r, mean = F.col("depth") * RING_STEP, posterior_mean(F.col("alpha"), F.col("beta"))
    colour = F.when(F.col("lock_level") == "user", "5").when(mean >= 0.75, "4").when(mean < 0.25, "6").otherwise("")
    return nodes.select("id", (r * F.cos(angle)).cast("long").alias("x"), (r * F.sin(angle)).cast("long").alias("y"), colour.alias("color"))


def adoption(rates: DataFrame, null_rate: float, clears: float, junk: float) -> DataFrame:
    """A verdict on the strategies of each group (``group``, ``confirmed``, ``junk``): drop all, defer, keep a single one, or an ensemble."""
    g = rates.groupBy("group").agg(F.count("*").alias("n"), F.count_if(F.col("confirmed") < null_rate).alias("under"), F.count_if(F.col("junk") > junk).alias("junky"), F.count_if(F.col("confirmed") >= clears).alias("clear"))
    verdict = F.when(F.col("under") == F.col("n"), "drop").when((F.col("junky") > 0) | (F.col("clear") == 0), "defer").when(F.col("clear") == 1, "single").otherwise("ensemble")
    return g.select("group", verdict.alias("verdict"))


def capped_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """Of pairs (``a`` < ``b``) in order those whose ends both have fewer than ``most`` before them that are taken.

    All pairs are settled in rounds at once. A pair is taken when, at both ends, it and all pairs before it that are still open would
    fit; an end that is full drops what it has left, which all comes after what it took. The first open pair of a component is
    settled in each round, so that rounds end. Of an end's open pairs only the first ``most`` are looked at, which tasks pick
    before anything moves; a round is written to the shared folder.
    """
    spark, folder = pairs.sparkSession, new_folder(pairs.sparkSession, "pairs")
    open_pairs = pairs.select("a", "b").distinct()
    taken, n = None, 0
    while True:
        open_pairs.write.parquet(f"{folder}/open{n}")
        open_pairs = spark.read.parquet(f"{folder}/open{n}")
        if open_pairs.isEmpty():
            return taken if taken is not None else open_pairs
        ends = open_pairs.select(F.explode(F.array("a", "b")).alias("end"), "a", "b")
        if taken is not None:
            used = taken.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("used"))
            ends = ends.join(used, "end", "left")
        else:
            ends = ends.withColumn("used", F.lit(0).cast("long"))
        place = F.row_number().over(Window.partitionBy("end").orderBy("a", "b"))
        first = ends.withColumn("place", place).where(F.col("place") <= most)
        fits = first.where(F.col("place") <= most - F.coalesce("used", F.lit(0))).groupBy("a", "b").agg(F.count("*").alias("ends")).where("ends = 2").select("a", "b")
        fits.write.parquet(f"{folder}/taken/round={n}")
        taken = spark.read.parquet(f"{folder}/taken").select("a", "b")
        full = taken.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("used")).where(F.col("used") >= most).select("end")
        left = open_pairs.join(taken, ["a", "b"], "left_anti")
        open_pairs = left.join(full.withColumnRenamed("end", "a"), "a", "left_anti").join(full.withColumnRenamed("end", "b"), "b", "left_anti").select("a", "b")
        n += 1


def atoms(store: Store) -> DataFrame:
    """Beliefs as numbered atoms of their type: (``id``, ``topic``, ``session``, ``content``)."""
    rows = Ranges(store.beliefs.select("type", "id", "session_id"), ["type"], [F.col("id")]).places()
    return rows.select("id", F.col("type").alias("topic"), F.col("session_id").alias("session"), F.concat("type", F.lit(" atom "), F.col("place") - 1).alias("content"))
