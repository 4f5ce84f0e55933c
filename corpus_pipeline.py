"""Training-corpus pipeline: quality selection, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet in the shared checkpoint folder and read again as the next stage's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from snapweave.llm import ordinal
from snapweave.llm.minhash_forest import near_duplicates
from snapweave.llm.packing import pack_documents
from snapweave.llm.suffix_trees import without_repeats
from snapweave.llm.tables import written
from snapweave.session import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are clean (grade 2) with a probability of at least ordinal.CUT.

    Null and empty texts are judged by their measures alone; of several labels of a document the worse counts.
    """
    labels = ordinal.grades_of(read_table(spark, sf_dir, "labels"))
    return ordinal.select(docs, ordinal.fit(docs, labels, ordinal.GRADES), ordinal.CLEAN)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8).

    Rows with a null id stay; rows with the same id and the same text are one, the one whose other
    columns come first as JSON text. Null and empty texts are near nothing.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").select(docs.columns)
    others = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("doc_id", "text")])
    one = one.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias("rest")).select("doc_id", "text", "rest.*")
    return one.select(docs.columns).union(docs.where("doc_id is null"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more stay in their first document only.

    Rows with a null id or text stay as they are; a null text has a null n_chars.
    """
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of 4096 tokens; null and empty texts are one end id."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substrings), ("packing", packing)]

#: Neither the classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents at ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
