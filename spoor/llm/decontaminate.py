"""Benchmark decontamination by token windows (operator 3)."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from functools import reduce
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WINDOW = 13
#: Items are broadcast in blocks of at most so many characters, however many there are.
BLOCK_CHARS = 16_000_000
_MIX = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Windows:
    """The normalised windows of some benchmark items, ready to be found in texts."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.items)}
        owners: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for name, text in items:
            words = [self.ids.setdefault(w, len(self.ids) + 1) for w in shared.words_of(text)]
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                owners[size][tuple(words[at : at + size])].add(number[name])
        self.by_size = []
        for size, found in sorted(owners.items()):
            rows = np.array(list(found), dtype=np.uint64).reshape(-1, size)
            hashes = self._hash(rows.T)
            order = np.argsort(hashes, kind="stable")
            self.by_size.append((size, hashes[order], rows[order], [sorted(x) for x in found.values()], order))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                out = (out ^ c) * np.uint64(_MIX)
                out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes], hit: np.ndarray) -> set[str]:
        """Mark the words inside occurrences in hit; the names of the items that occur."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        named: set[str] = set()
        for size, hashes, rows, owners, order in self.by_size:
            if len(ids) < size:
                break
            starts = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(starts):
                continue
            found = self._hash([ids[starts + k] for k in range(size)])
            at = np.searchsorted(hashes, found)
            likely = hashes[np.minimum(at, len(hashes) - 1)] == found
            for start, value, k in zip(starts[likely], found[likely], at[likely], strict=True):
                while k < len(hashes) and hashes[k] == value:
                    if np.array_equal(rows[k], ids[start : start + size]):  # a hash alone is no hit
                        hit[start : start + size] = True
                        named.update(self.items[i] for i in owners[order[k]])
                    k += 1
        return named


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """The items in lists of a bounded size, one after another."""
    slim = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    held, size = [], 0
    for row in slim.where("item is not null and text is not null").toLocalIterator():
        held.append((row.item, row.text))
        size += len(row.text)
        if size >= BLOCK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _finder(spark: SparkSession, items: list, window: int):
    """words -> (hit, names) for one block of items, whose windows a worker builds once for each task."""
    held, cache = shared.hold(spark, items), []

    def find(words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        if not cache:
            cache.append(Windows(held.value, window))
        hit = np.zeros(len(words), dtype=bool)
        return hit, cache[0].scan(words, hit)

    return find


def _found(df: DataFrame, text_col: str, blocks, window: int) -> DataFrame:
    """h (hash of a text), spans (of hit words) and items of every text that any block hits: one scan of the texts for each block."""
    spark, parts = df.sparkSession, []
    keyed = df.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    for items in blocks:
        find = _finder(spark, items, window)

        def work(texts, find=find):
            found = [find(shared.words_of(t)) for t in texts]
            return [np.flatnonzero(np.diff(np.concatenate(([0], h, [0])))).tolist() for h, _ in found], [sorted(n) for _, n in found]

        hits = shared.map_texts(keyed, "h", "text", "spans array<int>, items array<string>", work).where("size(items) > 0")
        parts.append(shared.cut(hits.dropDuplicates(["h"]), "block-hits"))
        shared.release()
    whole = reduce(DataFrame.unionByName, parts)
    return whole.groupBy("h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def scan(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Per row: its id, n_words, n_hit, items (ids of the items found, sorted as strings) and clean_text.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. A
    window is `window` consecutive words of an item, or all of a shorter item; a word inside any
    occurrence of a window is hit. clean_text is the text without the spans from the first to the
    last word of each run of hit words, null where nothing was hit. Null and empty texts have no
    words, texts may have any length; items with a null id or text take no part, and items repeated
    under one id count once. Repeated rows each keep their row; an empty table or benchmark gives an
    empty result or no hits. Items are broadcast in blocks of bounded size. One block is scanned and reported in
    one pass; of more, each has a pass of its own that keeps the texts it hits, by a 64-bit hash, and a last one puts them together.
    """
    blocks = _blocks(benchmark, item_col, item_text_col)
    some = list(islice(blocks, 2))
    returns = "n_words long, n_hit long, items array<string>, clean_text string"

    def report(texts, found):
        clean = [remove_spans(t, h) if h.any() else None for t, (h, _) in zip(texts, found, strict=True)]
        return [len(h) for h, _ in found], [int(h.sum()) for h, _ in found], [sorted(n) for _, n in found], clean

    if len(some) < 2:
        find = _finder(df.sparkSession, some[0] if some else [], window)
        return shared.map_texts(df, id_col, text_col, returns, lambda texts: report(texts, [find(shared.words_of(t)) for t in texts]))
    hits = _found(df, text_col, chain(some, blocks), window)
    both = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("h")).join(hits, "h", "left")
    both = both.select("_id", F.struct("_text", "spans", "items").alias("_row"))

    def joined(rows):
        found = []
        for r in rows:
            hit, spans = np.zeros(len(shared.words_of(r["_text"])), dtype=bool), r["spans"] or []
            for at, end in zip(spans[::2], spans[1::2], strict=True):
                hit[at:end] = True
            found.append((hit, r["items"] or []))
        return report([r["_text"] for r in rows], found)

    return shared.map_texts(both, "_id", "_row", returns, joined).withColumnRenamed("_id", id_col)


def remove_spans(text: str, hit: np.ndarray) -> str:
    """The text without its runs of hit words and what stands between the words of a run."""
    data, out, last, run = text.encode("utf-8", "replace"), [], 0, None
    for m, is_hit in zip(_WORD.finditer(data), hit, strict=True):
        if is_hit:
            run = (m.start() if run is None else run[0], m.end())
        elif run:
            out.append(data[last : run[0]])
            last, run = run[1], None
    if run:
        out.append(data[last : run[0]])
        last = run[1]
    return b"".join([*out, data[last:]]).decode("utf-8")


#: A document is contaminated if a twentieth of its words or more are hit.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that the rule of CONTAMINATED leaves, with all their columns and whole texts.

    Null and empty texts stay; repeated rows stay or go together. Blocks as in scan().
    """
    blocks = _blocks(benchmark, "item_id", "text")
    some = list(islice(blocks, 2))
    if len(some) == 2:
        (own,) = shared.free(df, "_h")
        found = scan(df.select(F.xxhash64(text_col).alias(own), text_col), benchmark, own, text_col)
        gone = shared.cut(found.where(CONTAMINATED).select(own).distinct(), "contaminated")
        return df.join(gone, F.xxhash64(text_col) == F.col(own), "left_anti")
    find = _finder(df.sparkSession, some[0] if some else [], WINDOW)

    def fine(texts):
        hits = [find(shared.words_of(t))[0] for t in texts]
        return [not (h.any() and 20 * int(h.sum()) >= len(h)) for h in hits]

    return shared.filter_texts(df, text_col, fine)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside benchmark windows, and which documents that contaminates."""
    found = scan(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT item, ws, least(len(ws), 13) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i
             FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
