"""Measures of rankings, answers and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answer_tokens


def ranking(rows: DataFrame, by: str, k: int) -> DataFrame:
    """Precision at k, reciprocal rank, and NDCG at k of each group of (``place`` from 1, ``relevant`` boolean)."""
    hit = F.col("relevant").cast("int")
    gain = F.when(F.col("place") <= k, hit / F.log2(F.col("place") + 1)).otherwise(0.0)
    w = Window.partitionBy(by).orderBy(F.desc("relevant"), "place")
    ideal = F.when(F.col("best") <= k, hit / F.log2(F.col("best") + 1)).otherwise(0.0)
    g = rows.withColumn("best", F.row_number().over(w)).groupBy(by).agg(
        F.sum(F.when(F.col("place") <= k, hit).otherwise(0)).alias("hits"), F.min(F.when(F.col("relevant"), F.col("place"))).alias("first"), F.sum(gain).alias("dcg"), F.sum(ideal).alias("ideal")
    )
    ndcg = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return g.select(by, F.round(F.col("hits") / k, 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.round(ndcg, 6).alias("ndcg"))


def roc_auc(rows: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """Mann-Whitney estimate with mean ranks for ties; null for groups of one class."""
    counted = rows.groupBy(by, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = counted.select(by, "p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("won")).groupBy(by).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.select(by, F.round(F.when(F.col("p") * F.col("n") > 0, F.col("won") / (F.col("p") * F.col("n"))), 6).alias("auc"))


def spearman(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Pearson correlation of mean ranks."""
    from .ordered import value_places

    def ranks(c: str, name: str) -> DataFrame:
        return value_places(rows, by, c).select(by, c, (F.col("before") + (F.col("c") + 1) / 2).alias(name))

    joined = rows.select(by, x, y).join(ranks(x, "rx"), [by, x]).join(ranks(y, "ry"), [by, y])
    return joined.groupBy(by).agg(F.round(F.corr("rx", "ry"), 6).alias("rho"))


def top_overlap(one: DataFrame, other: DataFrame, by: str, id: str, k: int) -> DataFrame:
    """Share of the first k places at which two rankings have the same row."""
    b = other.select(by, F.col(id).alias("_o"), "place")
    joined = one.where(F.col("place") <= k).join(b, [by, "place"], "left")
    return joined.groupBy(by).agg(F.round(F.sum((F.col(id) == F.col("_o")).cast("int")) / k, 6).alias("overlap"))


def answers(rows: DataFrame, key: str, predicted: str, truth: str) -> DataFrame:
    """Exact match, containment and token F1 of answers after normalisation."""
    t = rows.select(key, answer_tokens(F.col(predicted)).alias("p"), answer_tokens(F.col(truth)).alias("t"))
    joined = t.select(key, F.array_join("p", " ").alias("ps"), F.array_join("t", " ").alias("ts"), F.size("p").alias("np"), F.size("t").alias("nt"), "p", "t")
    same = F.aggregate(F.array_distinct("p"), F.lit(0), lambda a, w: a + F.least(F.size(F.filter("p", lambda x: x == w)), F.size(F.filter("t", lambda x: x == w))))
    f1 = F.when((F.col("np") + F.col("nt")) > 0, 2 * same / (F.col("np") + F.col("nt"))).otherwise(1.0)
    return joined.select(key, (F.col("ps") == F.col("ts")).alias("exact"), F.col("ps").contains(F.col("ts")).alias("contains"), F.round(f1, 6).alias("f1"))


def calibration_error(rows: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, and the rows of each bin's sum."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("share"))
    return g.select("bin", "n", F.round(F.abs(F.col("mean_p") - F.col("share")), 6).alias("gap"))


def kappa(rows: DataFrame, by: str, one: str, other: str) -> DataFrame:
    """Cohen's kappa of two boolean judgements in each group."""
    g = rows.groupBy(by).agg(F.avg((F.col(one) == F.col(other)).cast("double")).alias("agreed"), F.avg(F.col(one).cast("double")).alias("a"), F.avg(F.col(other).cast("double")).alias("b"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return g.select(by, F.round(F.when(chance < 1, (F.col("agreed") - chance) / (1 - chance)).otherwise(1.0), 6).alias("kappa"))


def rank_biased_overlap(one: DataFrame, other: DataFrame, by: str, id: str, p: float) -> DataFrame:
    """Agreement of two rankings at each depth, weighted by ``p`` to the depth, the last carried on."""
    depth = one.groupBy(by).agg(F.max("place").alias("da")).join(other.groupBy(by).agg(F.max("place").alias("db")), by).select(by, F.least("da", "db").alias("depth"))
    met = one.join(other.select(by, id, F.col("place").alias("_p")), [by, id]).select(by, F.greatest("place", "_p").alias("at"))
    counts = met.groupBy(by, "at").agg(F.count("*").alias("c"))
    levels = depth.select(by, "depth", F.explode(F.sequence(F.lit(1), "depth")).alias("at"))
    w = Window.partitionBy(by).orderBy("at")
    rows = levels.join(counts, [by, "at"], "left").withColumn("agreement", F.sum(F.coalesce("c", F.lit(0))).over(w) / F.col("at"))
    weighted = F.sum(F.pow(F.lit(p), F.col("at") - 1) * F.col("agreement"))
    last = F.max(F.when(F.col("at") == F.col("depth"), F.col("agreement") * F.pow(F.lit(p), "depth")))
    return rows.groupBy(by).agg(F.round(last + (1 - p) * weighted, 6).alias("rbo"))
