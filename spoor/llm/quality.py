"""Quality by Bradley-Terry ranking of preference pairs (operator 8)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled, shared
from .langid import remainder

#: predicted is 1 from this score on.
THRESHOLD = 0.7
#: Preference pairs that fit() draws from arrays, with a fixed seed.
PAIRS = 60_000
#: Rows of the more frequent label, and at least so many of the other on average, whose pairs a block of learn() takes all of.
BLOCK, OTHERS = 64, 32
#: Pairs whose differences are held at once.
HELD = 1 << 15
#: Steps of the range of raw scores among whose edges learn() looks for the cut.
STEPS = 1 << 16
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BEYOND = np.zeros(256, bool)
_BEYOND[128:] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PROSE = [ord(c) for c in ".,;:'\"-?"]
FEATURES = 18


def features(text: str | None) -> np.ndarray:
    """Counts of characters, words, repeats and lines of a whole text, as ratios."""
    data = (text or "").encode("utf-8", "replace")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[_BEYOND].sum()
    symbols, prose = counts[_SYMBOL].sum(), counts[_PROSE].sum()
    words = data.split()
    m = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    again = sum(map(bytes.__eq__, words, words[1:])) if m > 1 else 0
    return np.array(
        [
            np.log1p(n),
            np.log1p(m),
            letters / max(1, n),
            counts[_UPPER].sum() / max(1, letters),
            (symbols - prose) / max(1, m),
            prose / max(1, m),
            counts[_DIGIT].sum() / max(1, n),
            counts[ord("|")] / max(1, m),
            counts[ord("!")] / max(1, m),
            (counts[ord(".")] + counts[ord("?")]) / max(1, m),
            len(set(words)) / max(1, m) * min(1.0, np.log1p(m) / 7),
            len(pairs) / max(1, m - 1) if m > 1 else 1.0,
            again / max(1, m - 1),
            n / max(1, m),
            len(set(lines)) / max(1, len(lines)),
            min(1.0, len(lines) / max(1, m)),
            float(m == 0),
            float(m < 20),
        ]
    )


@dataclass
class Ranker:
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    quantile: float | None = None  # the part of the rows, by weight, whose raw scores lie below the cut

    def _wide(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, clipped, and their distances from the middle."""
        z = np.clip((x - self.center) / self.spread, -5, 5)
        return np.concatenate([z, np.abs(z)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._wide(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, exactly at the threshold where the raw score is at the chosen quantile."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def _median(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Median of every column of weighted rows; between two middle values their mean."""
    out = []
    for column in x.T:
        order = np.argsort(column, kind="stable")
        share = np.cumsum(weights[order]) / weights.sum()
        ends = np.searchsorted(share, (0.5 - 1e-12, 0.5 + 1e-12), "left")
        out.append(column[order][np.minimum(ends, len(column) - 1)].mean())
    return np.array(out)


def _slopes(d: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Of differences, better less worse: their number, and the sums of the gradient and Hessian of the logistic loss."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return len(d), -d.T @ p, (d * (p * (1 - p))[:, None]).T @ d


def _newton(width: int, slopes) -> np.ndarray:
    """Weights of the least mean loss, from the sums that slopes(weights) gives."""
    w = np.zeros(width)
    for _ in range(25):
        pairs, gradient, hessian = slopes(w)
        step = np.linalg.solve(hessian / pairs + (1e-3 + 1e-9) * np.eye(width), gradient / pairs + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 8, weights: np.ndarray | None = None, quantile: float | None = None) -> Ranker:
    """Bradley-Terry: P(a over b) = sigmoid(s(a) - s(b)), s linear, by Newton steps on the logistic loss of differences.

    Each pair sets a random row of label 1 over a random row of label 0. Then the cut: a quantile
    of the sample's raw scores, that given or else the one at which labels are met best (of equal
    ones the middle one), each row by its weight (1 where none are given), which also holds for the features'
    middle and spread. Without rows of both labels every score is 1 or 0 by the only label, or 0.5.
    """
    width = FEATURES
    one = Ranker(np.zeros(width), np.ones(width), np.zeros(2 * width), 0.0)
    good, bad = x[y == 1] if len(x) else x, x[y == 0] if len(x) else x
    if not len(good) or not len(bad):
        one.cut = -30.0 if len(good) else 30.0 if len(bad) else np.log(THRESHOLD / (1 - THRESHOLD))
        return one
    weights = np.ones(len(x)) if weights is None else weights
    rank = Ranker(_median(x, weights), np.maximum(labelled.deviation(x, weights), 1e-6), np.zeros(2 * width), 0.0)
    rnd = np.random.default_rng(seed)
    wide = rank._wide(x)
    a, b = rnd.choice(np.flatnonzero(y == 1), pairs), rnd.choice(np.flatnonzero(y == 0), pairs)
    d = wide[a] - wide[b]
    rank.weights = w = _newton(2 * width, lambda w: _slopes(d, w))
    raw = wide @ w
    order = np.argsort(raw, kind="stable")
    upto = np.concatenate(([0.0], np.cumsum(weights[order]))) / weights.sum()
    if quantile is None:
        best = labelled.greatest(labelled.met_by_cut(y[order], weights[order]))
        k = int(best[len(best) // 2])
    else:
        k = int(np.searchsorted(upto, quantile - 1e-12))
    rank.quantile = float(upto[k])
    ends = np.concatenate(([raw[order[0]] - 1], raw[order], [raw[order[-1]] + 1]))
    rank.cut = float((ends[k] + ends[k + 1]) / 2)
    return rank


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(-1, FEATURES)


def _vectors(rows: pa.ListArray) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """good, bad: the features of the rows of either label in each block, as a written table.

    Every row of the more frequent label is in one block, by a hash of its id, and every other row
    in as many blocks as give each about OTHERS of them; with one block these are all pairs. A
    block misses a label, so that its rows meet none there, with odds of e^-32.
    """
    major = max(counts, key=lambda c: (counts[c], c))
    n = -(-counts[major] // BLOCK)
    copies = min(n, -(-OTHERS * n // counts[1 - major]))
    at = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == major, 0).otherwise(copies - 1)))
    spread = rows.select("label", "x", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("first"), at.alias("i"))
    keyed = spread.select("label", "x", F.pmod(F.col("first") + F.col("i"), F.lit(n)).alias("block"))
    of = lambda c: F.sort_array(F.collect_list(F.when(F.col("label") == c, F.col("x"))))
    return shared.cut(keyed.groupBy("block").agg(of(1).alias("good"), of(0).alias("bad")).drop("block"), "quality-blocks")


def _block_slopes(blocks: DataFrame, rank: Ranker, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The sums of _slopes over all pairs of all blocks; each task gives one row."""
    width = len(w)

    def run(batches):
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            for at in range(batch.num_rows):
                good, bad = (rank._wide(_vectors(c[at].values)) for c in batch.columns)
                few = max(1, HELD // max(1, len(bad)))
                for i in range(0, len(good), few):
                    d = (good[i : i + few, None, :] - bad[None, :, :]).reshape(-1, width)
                    n, gradient, hessian = _slopes(d, w)
                    total += np.concatenate(([n], gradient, hessian.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    total = np.sum(sorted(r.sums for r in blocks.mapInArrow(run, "sums array<double>").collect()), axis=0)
    return total[0], total[1 : 1 + width], total[1 + width :].reshape(width, width)


def _binned(rows: DataFrame, rank: Ranker, limit: float) -> np.ndarray:
    """By label and step of the raw scores from -limit to limit: the number of rows."""

    def run(batches):
        for batch in batches:
            raw = rank.raw(_vectors(batch.column(1)))
            steps = np.clip(((raw + limit) / (2 * limit) * STEPS).astype(int), 0, STEPS - 1)
            keys, n = np.unique(batch.column(0).to_numpy() * STEPS + steps, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    found = np.zeros(2 * STEPS)
    for r in rows.select(F.col("label").cast("long"), "x").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toLocalIterator():
        found[r.key] = r.n
    return found.reshape(2, STEPS)


def learn(documents: DataFrame, labels: DataFrame) -> Ranker:
    """Bradley-Terry as in fit(), on every labelled row that may be learnt from; none is left out or sampled.

    Features are taken on the executors and written; sums alone come to the driver, whose size the
    input doesn't change. The features' middle is their mean. Pairs are those inside blocks of rows,
    some 32 for each row, in which every row takes part. The cut is that edge of STEPS equal steps
    of the raw scores' range at which all labels are met best.
    """
    usable = documents.where(remainder("doc_id", 4) != 2)
    taken = shared.map_texts(usable, "doc_id", "text", "x array<double>", lambda texts: (list(_matrix(texts)),))
    rows = shared.cut(taken.join(labelled.once(labels, "quality"), "doc_id"), "quality-rows")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return fit(np.zeros((len(counts), FEATURES)), np.array(list(counts)))
    x = [F.get("x", F.lit(i)) for i in range(FEATURES)]
    middle = np.array(rows.agg(*map(F.avg, x)).first())
    spread = np.array(rows.agg(*map(F.stddev_pop, x)).first())
    rank = Ranker(middle, np.maximum(spread, 1e-6), np.zeros(2 * FEATURES), 0.0)
    blocks = _blocks(rows, counts)
    rank.weights = _newton(2 * FEATURES, lambda w: _block_slopes(blocks, rank, w))
    limit = 5 * float(np.abs(rank.weights).sum()) + 1e-9
    below, beyond = _binned(rows, rank, limit)
    before = np.concatenate(([0], np.cumsum(below)))
    best = labelled.greatest(before + np.concatenate((np.cumsum(beyond[::-1])[::-1], [0])))
    k = int(best[len(best) // 2])
    rank.quantile = float((below + beyond)[:k].sum() / sum(counts.values()))
    rank.cut = k * 2 * limit / STEPS - limit
    shared.drop(rows, blocks)
    return rank


def score(df: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and score (0 to 1).

    Null texts score as empty ones; texts may have any length; equal texts get equal scores. Repeated
    rows each keep their row; an empty table gives an empty result.
    """
    held = shared.hold(df.sparkSession, ranker)
    return shared.map_texts(df, id_col, text_col, "score double", lambda texts: (held.value.score(_matrix(texts)),))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; a quarter of them is held out from learning."""
    documents = shared.table(spark, sf_dir, "documents")
    found = score(documents, learn(documents, shared.table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", labelled.held_out(), "score", predicted)
