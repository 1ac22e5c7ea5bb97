"""A corpus pipeline: language, repeated lines, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All but
the last return the columns of documents, with n_chars the length of the text they return.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import jaccard_join, language, line_dedup, packing, secret_scan
from veilscan.llm.store import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter; lang becomes the predicted language, `und` where no row has one to learn from."""
    model = language.learn(docs)
    if not model.langs:
        return _documents(language.with_letters(docs.select(COLUMNS)).withColumn("lang", F.lit(language.UNKNOWN)))
    found = language.predict(docs.select(COLUMNS), model, lang_col="lang_pred", score_col="lang_score")
    return _documents(found.filter(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out lines like an earlier one; documents of which nothing is left go."""
    kept = line_dedup.dedup_lines(docs.select(COLUMNS))
    return _documents(kept.filter(F.col("text").rlike(r"\S")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (five words, similarity 0.8), the first by doc_id (nulls last), text hash and row number.

    Rows that repeat an id, or have none, are documents of their own; rows without a word are no copies.
    """
    rows = write_table(docs.select(COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    groups = jaccard_join.similar_documents(rows, 5, 80, id_col="row_id").toDF("row_id", "n_shingles", "component")
    keys = rows.select("row_id", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row_id").alias("key"))
    first = groups.join(keys, "row_id").groupBy("component").agg(F.min("key").alias("key"))
    return _documents(rows.join(first.select("key.row_id"), "row_id", "left_semi"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of a secret in its place."""
    return _documents(secret_scan.mask_secrets(docs.select(COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, along the curve."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Fuzzy lines and trained models have no statement in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
