"""A training corpus from documents: quality, language, near-duplicates, source mix, tokens.

Each stage reads the Parquet table that the stage before it wrote. Rows without
words (null or empty text) go in the first stage; an empty table passes through
all of them; columns beyond those of `documents`, whatever their names, travel
along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm import bpe, jaccard, langid, mixing, quality
from srcatlas.llm.queries import vocabulary
from srcatlas.llm.shared import table, written

#: A document farther than this from every language profile (0 to 1) is in none of them.
FARTHEST = 0.8


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """All of a document in one column, beside the columns that an operator reads."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *names)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return quality.classify(_packed(docs, "doc_id", "text"), keep=("_doc",)).where("kept").select("_doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    known = langid.profiles(docs.where(langid.remainder(F.col("doc_id"), 5) != 0))
    found = langid.identify(_packed(docs, "text"), known, keep=("_doc",))
    return found.where((F.col("lang_pred") != "und") & (F.col("distance") <= FARTHEST)).select("_doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the first row) of each group of five-word shingle similarity 0.8 or more."""
    # rows get numbers that hold for both reads, whatever their ids
    rows = written(_packed(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.join(rows.select("_row", F.col("_doc.text").alias("text")), key="_row", n=5, percent=80)
    first = groups.where("_row = component_id").select("_row")
    return rows.join(first, "_row").select("_doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the curriculum takes them, a row for each time, in training order."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "token_ids")


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: The classifier and the language model of stages 1 and 2 are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
