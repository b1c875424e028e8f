"""SentencePiece encoding and decoding over a relational lattice (operator 10).

Frequent words are encoded once, in Spark: their substrings of bounded length are exploded and
joined with the piece table, the edges grouped by word, and each word's lattice folded by a
higher-order aggregate: Viterbi over score sums for unigram models, best-ranked merges over the
same edges for BPE models, whose ids Viterbi would not give. The rest is encoded where it stands.
"""

from __future__ import annotations

import heapq
import os
import re
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The tokenizer's file; the environment may name another.
MODEL_FILE = os.environ.get("SPOOR_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: At most so many frequent words are encoded ahead and broadcast, which bounds the table.
KEEP_WORDS = 50_000
#: Words beyond those that a worker remembers, at most; then it forgets all.
REMEMBERED = 200_000
#: Longer words have no place in a 64-bit mask of boundaries and are encoded where they stand.
LONGEST = 60
SPACE = "▁"
#: No piece crosses from a letter to anything else, nor has a space mark after another character:
#: where the piece table confirms it, texts may be cut there. Else only before space marks.
FINE = (rf"{SPACE}*[^\W\d_²³¹¼-¾⁰-₉]+|{SPACE}*(?:[^\w{SPACE}]|[\d_²³¹¼-¾⁰-₉])+|{SPACE}+", rf"{SPACE}*\p{{L}}+|{SPACE}*[^\p{{L}}{SPACE}]+|{SPACE}+")
COARSE = (rf"{SPACE}*[^{SPACE}]+|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """A piece table: texts, scores and kinds by id, and how a word's best path is found."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    unigram: bool
    prefix: bool
    ids: dict[str, int] = field(default_factory=dict)
    bytes_at: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (1, 4, 5)}
        self.bytes_at = [i for i, k in enumerate(self.kinds) if k == 6]
        self.unknown = self.kinds.index(2)
        self.score_of = {p: self.scores[i] for p, i in self.ids.items()}
        # What each id stands for; unknown and control pieces for nothing.
        self.plain = [b"" if k in (2, 3) else p.encode("utf-8") for p, k in zip(self.pieces, self.kinds, strict=True)]
        for b, i in enumerate(self.bytes_at):
            self.plain[i] = bytes([b])
        self.longest = max(map(len, self.ids), default=1)
        fine = all(re.fullmatch(FINE[0], p) and _same_class(p) for p in self.ids)
        self.cut, self.java_cut = FINE if fine else COARSE

    @classmethod
    def read(cls, path: str = MODEL_FILE, unigram: bool | None = None) -> Pieces:
        """From a model file. Only tables without normalisation rules and with all 256 byte pieces are taken."""
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        pieces, scores, kinds = [], [], []
        for number, value in top:
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode("utf-8"))
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), dtype="<f4")[0]))
                kinds.append(own.get(3, 1))
        trainer = dict(_fields(next((v for n, v in top if n == 2), b"")))
        rules = dict(_fields(next((v for n, v in top if n == 3), b"")))
        if rules.get(2) or rules.get(4, 1) or kinds.count(6) != 256:
            raise ValueError("the table normalises texts, or lacks byte pieces")
        return cls(pieces, scores, kinds, trainer.get(3, 1) == 1 if unigram is None else unigram, bool(rules.get(3, 1)))

    def marked(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def spelled(self, text: str) -> list[int]:
        """The byte pieces of a text that is no piece."""
        return [self.bytes_at[b] for b in text.encode("utf-8", "replace")]

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(self._viterbi(word) if self.unigram else self._merged(word))

    def _ids(self, parts) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            out += self.spelled(p) if i is None else [i]
        return out

    def _merged(self, word: str) -> list[int]:
        """Merge the adjacent pair whose joint piece scores best, the leftmost of equals, until none is a piece."""
        parts = list(word)
        if len(parts) <= 40:
            get, none = self.score_of.get, -np.inf
            joint = [get(a + b, none) for a, b in pairwise(parts)]  # only pairs beside a merge change
            while joint and (best := max(joint)) > none:
                at = joint.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del joint[at]
                if at:
                    joint[at - 1] = get(parts[at - 1] + parts[at], none)
                if at < len(joint):
                    joint[at] = get(parts[at] + parts[at + 1], none)
            return self._ids(parts)
        ids, scores = self.ids, self.scores
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-scores[k], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, text = heapq.heappop(heap)
            if parts[i] and parts[j] and after[i] == j and parts[i] + parts[j] == text:
                parts[i], parts[j], after[i] = text, "", after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                offer(before[i], i)
                offer(i, after[i])
        return self._ids(p for p in parts if p)

    def _viterbi(self, word: str) -> list[int]:
        """The path with the greatest sum of scores; a character that is no piece costs 10 more than the worst piece."""
        worst = min(self.scores[i] for i in self.ids.values()) - 10.0
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            found = []
            for start in range(max(0, end - self.longest), end):
                k = self.ids.get(word[start:end])
                if k is not None:
                    found.append((best[start][0] + self.scores[k], start))
                elif end - start == 1:
                    found.append((best[start][0] + worst, start))
            best.append(max(found, key=lambda x: (x[0], -x[1])))
        parts, end = [], len(word)
        while end:
            parts.append(word[best[end][1] : end])
            end = best[end][1]
        return self._ids(reversed(parts))

    def encode(self, text: str | None, known: dict[str, tuple[int, ...]], memory: dict[str, tuple[int, ...]]) -> list[int]:
        """The ids of a whole text. Words that aren't known are encoded here, and remembered."""
        if not text:
            return []
        words = re.findall(self.cut, self.marked(text))
        found = list(map(known.get, words))
        if None in found:
            if len(memory) > REMEMBERED:
                memory.clear()
            for i, f in enumerate(found):
                if f is None:
                    if (f := memory.get(words[i])) is None:
                        f = memory[words[i]] = self.word(words[i])
                    found[i] = f
        return list(chain.from_iterable(found))

    def decode(self, ids) -> str:
        """The text of some ids; unknown and control pieces give nothing, bytes that are no UTF-8 a replacement mark."""
        plain = b"".join(map(self.plain.__getitem__, ids))
        text = plain.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _same_class(piece: str) -> bool:
    """No step from a letter to another character, under either dialect's idea of a letter."""
    rest = piece.lstrip(SPACE)
    return len({c.isalpha() for c in rest}) <= 1 and SPACE not in rest


def count_words(df: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """word, n over all texts, cut where no piece can cross."""
    mark = F.lit(SPACE if pieces.prefix else "")
    text = F.concat(mark, F.replace(F.col(text_col), F.lit(" "), F.lit(SPACE)))
    words = df.where(f"length(`{text_col}`) > 0").select(F.explode(F.regexp_extract_all(text, F.lit(pieces.java_cut), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def frequent(counts: DataFrame, most: int = KEEP_WORDS) -> DataFrame:
    """The words of the counts that together number at most `most`: no word is kept while a more frequent one isn't."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, total = None, 0
    for row in by_count.toLocalIterator():
        total += row.words
        if total > most:
            break
        least = row.n
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, edges (start, end, id, score): every piece inside every word of up to 60 characters."""
    spark = words.sparkSession
    table = spark.createDataFrame([(p, i, pieces.scores[i]) for p, i in pieces.ids.items()], "piece string, id int, score double")
    starts = words.where(f"length(word) <= {LONGEST}").selectExpr("word", "explode(sequence(0, length(word) - 1)) as start")
    ends = starts.selectExpr("word", "start", f"explode(sequence(start + 1, least(start + {pieces.longest}, length(word)))) as end")
    parts = ends.selectExpr("word", "start", "end", "substring(word, start + 1, end - start) as piece")
    joined = parts.join(F.broadcast(table), "piece", "left").where("id is not null or end = start + 1")
    return joined.groupBy("word").agg(F.collect_list(F.struct("start", "end", "id", "score")).alias("edges"))


_SPAN = "(shiftleft(1L, e.end) - shiftleft(1L, e.start + 1))"
_MERGE = f"""aggregate(sequence(1, length(word)), shiftleft(1L, length(word) + 1) - 1L, (mask, step) ->
  coalesce(mask & ~get(transform(filter(longer, e -> (shiftright(mask, e.start) & 1L) = 1L
    and (shiftright(mask, e.end) & 1L) = 1L and bit_count(mask & {_SPAN}) = 1), e -> {_SPAN}), 0), mask))"""
_CUTS = "filter(sequence(0, length(word)), i -> (shiftright(mask, i) & 1L) = 1L)"
_VITERBI = """aggregate(sequence(1, length(word)), array(named_struct('score', 0D, 'back', 0)), (best, i) ->
  concat(best, array(array_max(transform(filter(steps, e -> e.end = i),
    e -> named_struct('score', best[e.start].score + coalesce(e.score, {worst}D), 'back', -e.start))))))"""
_BACK = """reverse(aggregate(sequence(1, length(word)), array(length(word)), (cuts, step) ->
  if(cuts[size(cuts) - 1] = 0, cuts, concat(cuts, array(-best[cuts[size(cuts) - 1]].back)))))"""


def fold(edges: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids: the best path through each word's lattice; characters that are no piece become byte pieces."""
    order = "array_sort(edges, (x, y) -> CASE WHEN coalesce(x.score, -1e300) > coalesce(y.score, -1e300) THEN -1 WHEN coalesce(x.score, -1e300) < coalesce(y.score, -1e300) THEN 1 ELSE x.start - y.start END)"
    rows = edges.selectExpr("word", f"{order} as steps")
    if pieces.unigram:
        worst = min(pieces.scores[i] for i in pieces.ids.values()) - 10.0
        rows = rows.selectExpr("word", "steps", _VITERBI.format(worst=repr(worst)) + " as best").selectExpr("word", "steps", f"{_BACK} as cuts")
    else:
        rows = rows.selectExpr("word", "steps", "filter(steps, e -> e.end > e.start + 1) as longer").selectExpr("word", "steps", f"{_MERGE} as mask").selectExpr("word", "steps", f"{_CUTS} as cuts")
    at = "get(filter(steps, e -> e.start = cuts[i] and e.end = cuts[i + 1]), 0).id"
    raw = "cast(substring(word, cuts[i] + 1, 1) as binary)"
    spelled = f"transform(sequence(1, length({raw})), k -> {pieces.bytes_at[0]} + cast(conv(hex(substring({raw}, k, 1)), 16, 10) as int))"
    return rows.selectExpr("word", f"flatten(transform(sequence(0, size(cuts) - 2), i -> if({at} is null, {spelled}, array({at})))) as ids")


def table_of(df: DataFrame, pieces: Pieces, text_col: str = "text", most: int = KEEP_WORDS) -> dict[str, tuple[int, ...]]:
    """The ids of the frequent words of df, by the lattice in Spark; at most `most` words."""
    counts = shared.cut(count_words(df, pieces, text_col), "piece-words")
    found = shared.cut(fold(lattice(frequent(counts, most), pieces), pieces), "piece-ids")
    known = {r.word: tuple(r.ids) for r in found.toLocalIterator()}
    shared.drop(counts, found)
    return known


def encode(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", most: int = KEEP_WORDS) -> DataFrame:
    """Per row: its id, ids (array of int), n_tokens and round_trip (decoding gives the text again).

    The ids are those of the model's own encoder. Null and empty texts have none; a text with
    space marks of its own can't be told from spaces, so its round_trip is false. Repeated rows
    and null ids each keep their row; an empty table gives an empty result.
    """
    spark = df.sparkSession
    held = shared.hold(spark, (pieces, table_of(df, pieces, text_col, most)))

    memory: dict[str, tuple[int, ...]] = {}

    def work(texts):
        own, known = held.value
        ids, sizes, same = [], [0], []
        for text in texts:
            got = own.encode(text, known, memory)
            ids.append(np.array(got, dtype=np.int32))
            sizes.append(sizes[-1] + len(got))
            same.append(own.decode(got) == (text or ""))
        flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), np.diff(sizes), same

    return shared.map_texts(df, id_col, text_col, "ids array<int>, n_tokens long, round_trip boolean", work, rows=128)


def decode(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and text, from ids; null ids give an empty text."""
    held = shared.hold(df.sparkSession, pieces)

    def work(rows):
        return ([held.value.decode(x or []) for x in rows],)

    return shared.map_texts(df, id_col, ids_col, "text string", work)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, their number, and whether they decode to its text."""
    found = encode(shared.table(spark, sf_dir, "documents"), Pieces.read())
    return found.select("doc_id", "n_tokens", "ids", "round_trip")
