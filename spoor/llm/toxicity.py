"""Toxicity by class-conditional word models with absolute discounts and shared backoff counts (operator 9).

Interpolated Kneser-Ney over word pairs was built and left out: the README has its figures.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import labelled, shared
from .langid import remainder

#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Standard errors by which a class's count must differ from its share of both classes' before it says anything.
DISCOUNT = 3.0


@dataclass
class Model:
    logs: dict[bytes, float]  # log P(word | toxic) - log P(word | ordinary), where that isn't zero
    slope: float = 1.0
    offset: float = 0.0

    def ratio(self, text: str | None) -> float:
        """The toxic less the ordinary log-likelihood of a text, by the number of its words; 0 without words."""
        words = shared.words_of(text)
        get = self.logs.get
        return sum(get(w, 0.0) for w in words) / len(words) if words else 0.0

    def score(self, ratio: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * ratio + self.offset, -30, 30))))


def _counted(rows: DataFrame) -> DataFrame:
    """word, n0, n1: the number of distinct texts of either label that a word stands in; batches are counted before the shuffle."""

    def run(batches):
        for batch in batches:
            by_label: dict[int, Counter] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_label.setdefault(label, Counter()).update(set(shared.words_of(text)))
            for label, found in by_label.items():
                words, counts = list(found), list(found.values())
                for at in range(0, len(words), 20_000):
                    w, n = words[at : at + 20_000], counts[at : at + 20_000]
                    arrays = [pa.array([label] * len(w), pa.int32()), pa.array(w, pa.binary()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["label", "word", "n"])

    distinct = rows.select("label", "text").where("text is not null").distinct()
    counts = distinct.mapInArrow(run, "label int, word binary, n long")
    sums = [F.expr(f"coalesce(sum(n) filter (where label = {c}), 0)").alias(f"n{c}") for c in (0, 1)]
    return counts.groupBy("word").agg(*sums)


def learn(rows: DataFrame) -> Model | None:
    """From label, text and, if there is one, weight (one for each label) of labelled rows; None without words of both labels.

    As Kneser-Ney counts contexts, a word counts once for each distinct text, so a word repeated
    in one text, or a text copied often, says no more than once. Of N texts' words of a class,
    E = N * shared is what the counts of both classes together lead one to expect of a word. Its
    own count's difference from E is discounted by D = 3 * sqrt(E + 1), absolutely, and what
    is left added to the backoff: P = (E + discounted) / N. Rare words' differences fall to zero,
    so both classes give them the shared probability and they weigh nothing. The shared
    probability takes each class by its weight, so it is the whole table's where the rows are a
    sample; E, D and a class's own count are in rows that were counted, as a standard error is.
    """
    weights = {0: 1.0, 1: 1.0}
    if "weight" in rows.columns:
        weights |= {r.label: r.weight for r in rows.groupBy("label").agg(F.max("weight").alias("weight")).collect()}
    counts = shared.cut(_counted(rows), "word-texts")
    total = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total.n0 or not total.n1:
        return None
    common = F.col("n0") * F.lit(weights[0]) + F.col("n1") * F.lit(weights[1])
    whole = total.n0 * weights[0] + total.n1 * weights[1]
    parts = []
    for c, n in (("n0", total.n0), ("n1", total.n1)):
        expected = common * F.lit(n / whole)
        off = F.col(c) - expected
        own = F.signum(off) * F.greatest(F.abs(off) - DISCOUNT * F.sqrt(expected + 1), F.lit(0.0))
        parts.append(F.greatest(expected + own, F.lit(1e-3)) / F.lit(float(n)))
    scored = counts.select("word", F.when(F.abs(F.ln(parts[1] / parts[0])) > 1e-9, F.ln(parts[1] / parts[0])).alias("log")).where("log is not null")
    logs = {bytes(r.word): r.log for r in scored.toLocalIterator()}
    shared.drop(counts)
    return Model(logs)


def _cut_at(model: Model, cut: float, deviation: float) -> None:
    model.slope = 4.0 / max(1e-6, deviation)
    model.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - model.slope * cut)


def calibrate(model: Model, ratios: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> None:
    """Set the threshold where it cuts rows that weren't counted best, each by its weight (1 where none are given), and a logistic curve about it."""
    if not len(ratios):
        model.offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - 0.01)
        return
    order = np.argsort(ratios, kind="stable")
    weights = np.ones(len(ratios)) if weights is None else weights
    r = ratios[order]
    met = labelled.met_by_cut(y[order], weights[order])
    met[1:-1][r[1:] == r[:-1]] = -1  # no cut within equal ratios
    best = labelled.greatest(met)
    k = int(best[-1])
    ends = np.concatenate(([r[0] - 1e-3], r, [r[-1] + 1e-3]))
    _cut_at(model, (ends[k] + ends[k + 1]) / 2, float(labelled.deviation(ratios, weights)))


def calibrate_all(model: Model, rows: DataFrame) -> None:
    """What calibrate() does with arrays, from label and ratio of a table of any size.

    The labels met by a cut are those met by none, and the running sum of label 0 less label 1 up
    to it. It is taken over distinct ratios, inside ranges of them and over one row a range, so
    nothing is sorted in one task; only the best cut comes to the driver. The deviation is
    rounded, so the order in which tasks end doesn't show.
    """
    tallies = shared.cut(rows.groupBy("ratio").agg(F.count("*").alias("n"), F.sum(1 - 2 * F.col("label")).alias("gain")), "toxicity-tallies")
    whole = tallies.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("ratio")).alias("sum"), F.min("ratio").alias("least")).first()
    if not whole.n:
        calibrate(model, np.zeros(0), np.zeros(0))
        return
    ranged = shared.cut(tallies.repartitionByRange("ratio").withColumn("part", F.spark_partition_id()), "toxicity-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("gain").alias("gain")).select("part", F.coalesce(F.sum("gain").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("part").orderBy("ratio").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.join(starts, "part").select((F.col("start") + F.sum("gain").over(upto)).alias("gain"), "ratio")
    best = sums.agg(F.max(F.struct("gain", "ratio")).alias("best")).first().best
    low = best.ratio if best.gain >= 0 else None
    after = ranged.where(F.lit(True) if low is None else F.col("ratio") > low)
    high = after.agg(F.min("ratio")).first()[0]
    low, high = whole.least - 1e-3 if low is None else low, low + 1e-3 if high is None else high
    middle = F.lit(whole.sum / whole.n)
    square = ranged.agg(F.sum(F.col("n") * (F.col("ratio") - middle) ** 2)).first()[0]
    shared.drop(tallies, ranged)
    _cut_at(model, (low + high) / 2, float(f"{np.sqrt(square / whole.n):.9g}"))


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Count all labelled rows whose crc32(doc_id) mod 4 is 0 or 1, and calibrate on all where it is 3; none is left out or sampled.

    Neither texts nor ids come to the driver or are broadcast, only the words that say anything:
    a word needs several texts of its own, so their number grows far slower than the table.
    """
    known, part = labelled.once(labels, "toxic"), remainder("doc_id", 4)
    counted = documents.where(part.isin(0, 1) & F.col("text").isNotNull()).select("doc_id", "text")
    model = learn(counted.join(known.hint("merge"), "doc_id"))  # one plan at every size: ids are many in a large table
    if model is None:
        return None
    held = documents.sparkSession.sparkContext.broadcast(model)
    ratios = shared.map_texts(documents.where(part == 3), "doc_id", "text", "ratio double", lambda texts: ([held.value.ratio(t) for t in texts],))
    calibrate_all(model, ratios.join(known, "doc_id"))
    return model


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and score (0 to 1) from the length-normalised log-likelihood ratio of the whole text.

    Texts that are null or without words have a ratio of 0; without a model every score is 0. Texts
    may have any length. Repeated rows each keep their row; an empty table gives an empty result.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        own = held.value
        return ([own.score(own.ratio(t)) if own else 0.0 for t in texts],)

    return shared.map_texts(df, id_col, text_col, "score double", work)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; a quarter of them is held out from learning."""
    documents = shared.table(spark, sf_dir, "documents")
    found = score(documents, fit(documents, shared.table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", labelled.held_out(), "score", predicted)
