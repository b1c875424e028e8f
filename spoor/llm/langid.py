"""Language identification by words first, then ever shorter character n-grams (operator 5)."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The model learns from about so many rows of each language at most, those with the least hash of
#: their id. All words and n-grams of these rows count, so the rows alone bound its size.
SAMPLE = 4_000
MAX_GRAM = 4
UNKNOWN = "und"
#: Words that a score weighs at most: beyond, more text makes the languages no more certain.
EVIDENCE = 24
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Unseen words whose n-grams a worker remembers, and counts that it gathers before it passes them on.
_REMEMBERED = 20_000
_GATHERED = 100_000


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text.encode("utf-8", "replace")) is not None or any(map(str.isalpha, text)))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; anything beyond ASCII counts as one here."""
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).decode("utf-8").split() if text else []


def grams_of(word: str, n: int) -> list[str]:
    whole = f"^{word}$" if n > 1 else word  # the ends say nothing on their own
    return [whole[i : i + n] for i in range(len(whole) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray  # one row a word, one column a language
    grams: list[dict[str, int]]  # by length - 1
    gram_logs: list[np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        """The mean log frequency of the word's n-grams of the greatest length at which any is known."""
        for n in range(MAX_GRAM, 0, -1):
            found = [k for g in grams_of(word, n) if (k := self.grams[n - 1].get(g)) is not None]
            if found:
                return self.gram_logs[n - 1][found].mean(axis=0)
        return np.zeros(len(self.languages))

    def score(self, words: list[str], memory: dict[str, np.ndarray]) -> tuple[str, float]:
        get = self.words.get
        ids = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
        total = self.word_logs[ids[ids >= 0]].sum(axis=0)
        if (ids < 0).any():
            for word, n in Counter(w for w, k in zip(words, ids, strict=True) if k < 0).items():
                if (v := memory.get(word)) is None:
                    if len(memory) >= _REMEMBERED:
                        memory.clear()
                    v = memory[word] = self.unseen(word)
                total = total + n * v
        mean = total / max(1, len(words)) * min(len(words), EVIDENCE)
        odds = np.exp(mean - mean.max())
        best = int(np.argmax(odds))  # ties: the first in alphabetical order
        return self.languages[best], float(odds[best] / odds.sum())


def bounded(df: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", most: int = SAMPLE) -> DataFrame:
    """The rows of df with a language, or where a language has more than `most`, those below a threshold on a hash of the id."""
    rows = df.where(F.col(lang_col).isNotNull())
    share = F.lit(1 << 20)
    for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).where(F.col("n") > most).collect():
        share = F.when(F.col(lang_col) == r.lang, F.lit(int(most / r.n * (1 << 20)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share)


def _counted(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, word, n over all rows; each batch is counted before anything is shuffled."""
    shared.small_batches(df.sparkSession)

    def run(batches):
        counts: dict[str, Counter] = {}

        def packed():
            for lang, found in counts.items():
                arrays = [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
                if sum(map(len, counts.values())) > _GATHERED:
                    yield from packed()
        yield from packed()

    slim = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    return slim.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _logs(rows, languages: list[str], totals: dict[str, int]) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies by name; a name not counted in a language has half an occurrence there."""
    ids: dict[str, int] = {}
    cells = [(ids.setdefault(name, len(ids)), languages.index(lang), n) for lang, name, n in sorted(rows)]
    out = np.full((len(ids), len(languages)), 0.5)
    for i, j, n in cells:
        out[i, j] = n
    return ids, np.log(out) - np.log([max(1, totals.get(x, 1)) for x in languages])


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count words by language over all rows of df, which bound the model; n-gram counts are derived from the word counts."""
    counts = shared.cut(_counted(df, text_col, lang_col), "words")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    ids, logs = _logs([tuple(r) for r in counts.select("lang", "word", "n").toLocalIterator()], languages, totals)

    whole = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    lengths = F.sequence(F.lit(1), F.lit(MAX_GRAM))
    grams = counts.select(
        "lang",
        "n",
        F.explode(
            F.flatten(
                F.transform(
                    lengths,
                    lambda g: F.transform(
                        F.sequence(F.lit(1), F.greatest(F.length(whole) - g + 1, F.lit(1))),
                        lambda i: F.struct(g.alias("size"), F.substring(whole, i, g).alias("gram")),
                    ),
                )
            )
        ).alias("g"),
    )
    grams = grams.groupBy("lang", "g.size", "g.gram").agg(F.sum("n").alias("n")).where("length(gram) = size and gram not in ('^', '$')")
    grams = shared.cut(grams, "grams")
    sums = {(r.lang, r["size"]): r.n for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    found = grams.select("size", "lang", "gram", "n").collect()
    by_size = [_logs([(r.lang, r.gram, r.n) for r in found if r["size"] == n], languages, {x: sums.get((x, n), 1) for x in languages}) for n in range(1, MAX_GRAM + 1)]
    shared.drop(counts, grams)
    return Model(languages, ids, logs, [x[0] for x in by_size], [x[1] for x in by_size])


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, lang_pred and score.

    A word the model knows counts by its log frequency in each language, any other by the mean
    of its longest known n-grams. score is the likeliest language's share of the likelihood, at
    the mean of the words and as if there were 24 of them at most. Texts that are null or hold no letter,
    and all texts if nothing was learned, get `und` and score 0. Ties go to the first language in order.
    Texts may have any length. Repeated rows each keep their row; an empty table gives an empty result.
    """
    model = shared.hold(df.sparkSession, model)
    memory: dict[str, np.ndarray] = {}

    def work(texts):
        found = []
        for text in texts:
            words = words_of(text) if model.value.languages and has_letter(text) else []
            found.append(model.value.score(words, memory) if words else (UNKNOWN, 0.0))
        return [x[0] for x in found], [x[1] for x in found]

    return shared.map_texts(df, id_col, text_col, "lang_pred string, score double", work)


def remainder(id_col, of: int):
    """crc32(id as text) mod `of`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(of))


def learned(documents: DataFrame) -> Model:
    """From a bounded sample of the rows whose remainder by 3 is not 1; rows without an id aren't learned."""
    return learn(bounded(documents.where(remainder("doc_id", 3) != 1)))


#: The pipeline rejects a document whose language has no more of the likelihood than this.
LEAST_SCORE = 0.5


def keep_identified(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose language is found with some certainty; others have no letter or no clear language.

    Null and empty texts go; repeated rows are kept or go together; an empty table stays empty.
    """
    model = shared.hold(documents.sparkSession, model)
    memory: dict[str, np.ndarray] = {}

    def test(texts):
        out = []
        for text in texts:
            words = words_of(text) if model.value.languages and has_letter(text) else []
            out.append(bool(words) and model.value.score(words, memory)[1] > LEAST_SCORE)
        return out

    return shared.filter_texts(documents, "text", test)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of them is held out from learning."""
    documents = shared.table(spark, sf_dir, "documents")
    found = predict(documents, learned(documents))
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
