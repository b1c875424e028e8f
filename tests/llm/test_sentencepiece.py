import random

import pytest
import sentencepiece as spm

from spoor.llm import sentencepiece as sp

SCHEMA = "doc_id long, text string, lang string, ids string, word string"
TEXTS = ["Hello  world\nfoo", "  a", "a ", "é日本x", "\tx", "ﬁ ﬀ Å", "a  b   c", "ab\n\n  c", None, "", " ", "<0x0A> <s>", "x²y 12345 __init__", "नमस्ते दुनिया", "z" * 300, "!?" * 100, "Mixed! CASE words, don't 'stop' (now) ... 3.14 €5"]


def frame(spark, texts):
    return spark.createDataFrame([(i if i % 7 else None, t, "x", "i", "w") for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def real():
    return spm.SentencePieceProcessor(model_file=sp.MODEL_FILE)


def best_sum(pieces, word):
    """The greatest sum of scores over all ways to cut a word, by trying them."""
    if not word:
        return 0.0
    worst, found = min(pieces.scores[i] for i in pieces.ids.values()) - 10, []
    for n in range(1, len(word) + 1):
        k = pieces.ids.get(word[:n])
        if k is not None or n == 1:
            found.append((worst if k is None else pieces.scores[k]) + best_sum(pieces, word[n:]))
    return max(found)


@pytest.mark.parametrize("most", [sp.KEEP_WORDS, 0])
def test_same_ids_as_the_library(spark, sf, real, most):
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + TEXTS
    pieces = sp.Pieces.read()
    assert pieces.cut == sp.FINE[0]
    got = sp.encode(frame(spark, rows), pieces, most=most).collect()
    assert sorted((r["ids"] for r in got), key=str) == sorted((real.encode(t or "") for t in rows), key=str)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    table = sp.decode(spark.createDataFrame([(i, real.encode(t or "")) for i, t in enumerate(rows)], "doc_id long, ids array<int>"), pieces)
    assert {r.doc_id: r.text for r in table.collect()} == {i: t or "" for i, t in enumerate(rows)}


def test_lattice_folds_are_the_library_s(spark, real):
    rnd = random.Random(4)
    words = {"".join(rnd.choice("aeinrstthelo dé!日") for _ in range(rnd.choice([1, 3, 6, 9, 24]))).replace(" ", sp.SPACE) for _ in range(300)}
    words |= {"▁the", "▁▁▁▁▁▁▁x", "▁understanding", "é", "अ"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for unigram in (False, True):
        pieces = sp.Pieces.read(unigram=unigram)
        got = {r.word: tuple(r.ids) for r in sp.fold(sp.lattice(df, pieces), pieces).collect()}
        worst = min(pieces.scores[i] for i in pieces.ids.values()) - 10
        for w in words:
            assert got[w] == pieces.word(w), w
            if unigram and len(w) <= 9:
                lone = sum(c not in pieces.ids for c in w)
                total = sum(pieces.scores[i] for i in got[w] if pieces.kinds[i] != 6) + worst * lone
                assert abs(total - best_sum(pieces, w)) < 1e-6, w
            if not unigram and w.startswith(sp.SPACE) and len(w) > 1:  # the library sets a mark before each text
                assert list(got[w]) == real.encode(w[1:]), w


def test_long_words_and_empty_table(spark, real):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdehinorst") for _ in range(20000))
    pieces = sp.Pieces.read()
    assert pieces.word(sp.SPACE + long) == tuple(real.encode(long))
    assert sp.encode(frame(spark, []), pieces).collect() == []
    assert pieces.decode([]) == "" and not sp.encode(frame(spark, ["a▁b"]), pieces).collect()[0].round_trip
    assert sp.Pieces(["<unk>", "a.b", *(f"<0x{i:02X}>" for i in range(256))], [0.0] * 258, [2, 1, *[6] * 256], False, True).cut == sp.COARSE[0]


def test_a_merge_looks_up_only_the_pairs_beside_it():
    pieces, calls = sp.Pieces.read(), []

    class Counted(dict):
        def get(self, *args):
            calls.append(args)
            return dict.get(self, *args)

    pieces.score_of = Counted(pieces.score_of)
    rnd = random.Random(6)
    for _ in range(300):
        word = "".join(rnd.choice("antiersoch\u00e9\u4e2d9") for _ in range(rnd.randrange(1, 41)))
        parts = list(word)
        while found := [(-pieces.scores[pieces.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in pieces.ids]:
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        calls.clear()
        assert pieces._merged(word) == pieces._ids(parts)
        assert len(calls) <= 3 * len(word)
        assert pieces.decode(pieces._ids(parts)) == word
