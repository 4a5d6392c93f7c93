"""A corpus made ready for training in five stages, each over all that the one before has kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import dedup_exact, dedup_near, dedup_substrings, packing, toxicity
from recallgrid.llm._common import written

#: The byte-level vocabulary as ranks, its pattern, its special token and the id that ends a document.
PACKING = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),), 1)


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with columns but the id and the text under names that no operator uses, and what gives them their names back."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"_stage_{k}" for k, c in enumerate(others)}
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in names.items())), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the class-conditional models call toxic; all labels are learned from.

    Null and empty texts have no words and stay; repeated rows go or stay alike; label rows without an id or a label don't
    count, and without labels of both kinds all stay. An empty table gives none. Other columns of any name come along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    inner, back = _apart(docs)
    return toxicity.score(inner, labels, keep_text=True).where("predicted = 0").select(*back)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest id.

    Null counts as empty, so that one row without a text stays; of rows repeated in full one stays; a null id stays only where
    no equal text has one. An empty table gives none. Other columns of any name come along.
    """
    inner, back = _apart(docs)
    return dedup_exact.keep_one(inner).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share 0.8 of their five-word shingles, the one with the least id.

    Null and empty texts are like no other and stay; of rows repeated in full one stays; a null id counts as the least. An
    empty table gives none. Other columns of any name come along.
    """
    inner, back = _apart(docs)
    return dedup_near.near_dedup(inner, 80).select(*back)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that stand elsewhere (49 words in a row that are equal).

    Null and empty texts, and those of fewer words, stay as they are; rows repeated in full lose all they share, as passages of
    the input count wherever they stand. ``n_chars`` follows the text where there is such a column. An empty table gives none.
    Other columns of any name come along.
    """
    inner, back = _apart(docs)
    rows = dedup_substrings.remove_passages(inner)
    changed = F.col("n_removed") > 0
    rows = rows.withColumn("text", F.when(changed, F.col("kept_bytes").cast("string")).otherwise(F.col("text")))  # whole words go, so characters stay whole
    for k, c in enumerate(docs.columns):
        if c == "n_chars":
            back[k] = F.when(changed, F.length("text").cast(docs.schema[c].dataType)).otherwise(back[k]).alias(c)
    return rows.select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    Null counts as empty and has the end token only; repeated rows and null ids are packed like others; an empty table gives
    none.
    """
    rows = packing.pack(docs.select("doc_id", "text"), *PACKING)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_strings),
    ("packing", pack_sequences),
]

#: Trained models, similarity classes and tokens can't be written in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
