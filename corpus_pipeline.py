"""A training corpus from raw documents, in five stages; each works on all that the one before kept.

Every stage function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import decontaminate, langid, linedup, sentencepiece, shared, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or a clear language go. The model learns from a sample of two thirds of docs (operator 5).

    Null and empty texts go. Repeated rows stay or go together, here and in the stages below but
    near_duplicates; texts of any length are taken whole; an empty table stays empty; further columns are kept.
    """
    shared.release()
    return langid.keep_identified(docs, langid.learned(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are nearly equal one stays in the whole corpus; documents left empty go (operator 2).

    Null and empty texts stay as they are. Of equal lines the first by doc_id stays, so repeated rows keep equal texts.
    """
    shared.release()
    return linedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id (operator 4).

    Null and empty texts are equal to each other. Of repeated rows one stays.
    """
    shared.release()
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark windows go (operator 3). Null and empty texts stay."""
    shared.release()
    return decontaminate.drop_contaminated(docs, shared.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number, and whether they decode to the text again (operator 10). Null and empty texts have no ids."""
    shared.release()
    return sentencepiece.encode(docs, sentencepiece.Pieces.read()).select("doc_id", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the MinHash bands nor the piece merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread."""
    docs, before = shared.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            shared.drop(before)
        before = docs
    return docs
