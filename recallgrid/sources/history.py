"""Commit history from an exported log, and the scan of a repository's texts into candidates for beliefs.

The log is what ``git log --name-only --format=%x1e%H%x09%aI%x09%s`` prints, in one file or many. Records begin with a separator of their own, so
that Spark cuts files of any size into splits at record ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import paragraphs

#: What stands before each record, and as many of a commit's digits as its source names.
SEPARATOR, SHORT = "\x1e", 7


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(``sha``, ``at``, ``subject``, ``files``) of the records of a log; those without three fields in their first line are left out."""
    rows = spark.read.option("lineSep", SEPARATOR).text(path)
    lines = F.split("value", "\r?\n")
    head = F.split(F.get(lines, F.lit(0)), "\t", 3)
    files = F.filter(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.rtrim(x)), lambda x: x != "")
    found = rows.select(head.alias("h"), files.alias("files")).where("size(h) = 3")
    return found.select(F.col("h")[0].alias("sha"), F.to_timestamp(F.col("h")[1]).alias("at"), F.trim(F.col("h")[2]).alias("subject"), "files")


def commit_candidates(log: DataFrame, limit: int | None = None) -> DataFrame:
    """(``text``, ``source``, ``at``): one candidate for each commit with a subject; with ``limit``, of the newest so many commits."""
    rows = log if limit is None else log.orderBy(F.desc("at"), "sha").limit(limit)
    return rows.where("subject <> ''").select(F.col("subject").alias("text"), F.concat(F.lit("git:commit:"), F.substring("sha", 1, SHORT)).alias("source"), "at")


def file_recency(log: DataFrame) -> DataFrame:
    """(``path``, ``at``): when each file was last committed."""
    return log.select(F.explode("files").alias("path"), "at").groupBy("path").agg(F.max("at").alias("at"))


def paragraph_candidates(texts: DataFrame, recency: DataFrame) -> DataFrame:
    """(``text``, ``source``, ``at``): one candidate for each paragraph of the files (``path``, ``text``), dated by the file's last commit."""
    rows = texts.select("path", F.posexplode(paragraphs(F.col("text"))).alias("n", "p")).join(recency, "path", "left")
    return rows.select(F.col("p").alias("text"), F.concat(F.lit("doc:"), "path", F.lit(":p"), "n").alias("source"), "at")


def scanned(candidates: DataFrame, known: DataFrame, keeps: Column) -> DataFrame:
    """(``content_hash``, ``text``, ``source``, ``at``, ``seen``): what a scan adds to a store: each text that is to be kept and whose hash isn't among ``known`` (``content_hash``) once, by
    its first source in order of name, with how often it was seen. So a scan that runs again adds nothing."""
    rows = candidates.where(keeps).withColumn("content_hash", F.sha2("text", 256))
    fresh = rows.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    best = fresh.groupBy("content_hash").agg(F.min(F.struct("source", "at", "text")).alias("b"), F.count("*").alias("seen"))
    return best.select("content_hash", "b.text", "b.source", "b.at", "seen")

