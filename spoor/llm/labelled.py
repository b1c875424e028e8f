"""What the quality and toxicity models share: which rows they learn from, and cuts. Both queries learn from all rows of once(); samples are for callers who want one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import remainder

#: A sample has about so many rows of each label at most, those with the least hash of their id.
SAMPLE = 12_000


def once(labels: DataFrame, label_col: str) -> DataFrame:
    """doc_id, label of all labelled rows whose crc32(doc_id) mod 4 is not 2; repeated labels of one id count once, conflicting ones as the greater."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (remainder("doc_id", 4) != 2))
    return usable.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))


def chosen(labels: DataFrame, label_col: str, most: int = SAMPLE) -> DataFrame:
    """_id, label, weight of a bounded sample of the rows of once().

    Where a label has more than `most` rows, those below a threshold on a hash of the id stay, so nothing is sorted.
    A row's weight is how many rows of its label the table has for each one sampled, so weighted
    sums keep the table's ratio of labels at every size.
    """
    rows = once(labels, label_col)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    share = F.lit(0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, F.lit(min(1 << 20, int(most / n * (1 << 20))))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).withColumnRenamed("doc_id", "_id")
    weight = F.lit(1.0)
    if max(sizes.values(), default=0) > most:
        for r in picked.groupBy("label").count().collect():
            weight = F.when(F.col("label") == r.label, F.lit(sizes[r.label] / r["count"])).otherwise(weight)
    return picked.withColumn("weight", weight)


def texts(documents: DataFrame, picked: DataFrame) -> DataFrame:
    """doc_id, text, label, weight of the sample; its ids are broadcast, as their number is bounded, and no text is shuffled."""
    return documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label", "weight")


def sample(documents: DataFrame, labels: DataFrame, label_col: str, most: int = SAMPLE) -> DataFrame:
    return texts(documents, chosen(labels, label_col, most))


def met_by_cut(y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By number of rows before a cut, rows in order of score: the weight of label 0 before it and of label 1 beyond it."""
    below, beyond = np.where(y == 0, weights, 0.0), np.where(y == 1, weights, 0.0)
    return np.concatenate(([0], np.cumsum(below))) + np.concatenate((np.cumsum(beyond[::-1])[::-1], [0]))


def greatest(met: np.ndarray) -> np.ndarray:
    """Where met is greatest, but for the rounding of sums of weights."""
    return np.flatnonzero(met >= met.max() * (1 - 1e-12))


def deviation(x: np.ndarray, weights: np.ndarray):
    """Standard deviation of weighted rows."""
    return np.sqrt(np.average((x - np.average(x, axis=0, weights=weights)) ** 2, axis=0, weights=weights))


def held_out():
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
