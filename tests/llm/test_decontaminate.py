import random
import re

from spoor.llm import decontaminate, shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, items string, n_hit int"


def brute(text, items, n=13):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    doc, hit, named = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(doc) - k + 1):
                if doc[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    named.add(str(name))
    return len(doc), len(hit), sorted(named)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 0, "c", 9) for i, t in rows], SCHEMA)


def test_matches_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["a", "b", "Cé", "d1", "ö"]
    make = lambda n: " ".join(rnd.choice(vocab) + rnd.choice(["", ",", "!", "\n"]) for _ in range(n))
    items = [(1, make(3)), (2, make(14)), (3, make(20)), (10, "a"), (11, None), (12, "..."), (3, make(15)), (None, "b")]
    docs = [(i, make(rnd.randrange(40))) for i in range(60)] + [(100, None), (101, ""), (102, "!!"), (None, make(30))]
    docs += [(200 + i, make(5) + " " + items[2][1].lower() + " " + make(5)) for i in range(5)] + [(1, docs[1][1])] * 2
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, n_words int")
    known = [(i, t) for i, t in items if i is not None]
    for block in (decontaminate.BLOCK_CHARS, 20):
        decontaminate.BLOCK_CHARS, old = block, decontaminate.BLOCK_CHARS
        got = decontaminate.scan(frame(spark, docs), bench).collect()
        kept = decontaminate.drop_contaminated(frame(spark, docs), bench).collect()
        decontaminate.BLOCK_CHARS = old
        want = sorted((str(i), *brute(t, known)) for i, t in docs)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
        fine = [(i, t) for i, t in docs if not ((b := brute(t, known))[1] > 0 and 20 * b[1] >= b[0])]
        assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, fine))


def test_spans_go_and_long_texts_stay_whole(spark):
    item = " ".join(f"q{i}" for i in range(15))
    long = " ".join(f"w{i}" for i in range(50000))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    df = frame(spark, [(1, f"{long}. {item.upper()}! {long}"), (2, "x " + item), (3, "none here")])
    got = {r.doc_id: r for r in decontaminate.scan(df, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (100015, 15, ["7"])
    assert got[1].clean_text == f"{long}. ! {long}"
    assert (got[2].clean_text, got[3].clean_text, got[3].n_hit) == ("x ", None, 0)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b")])
    assert [(r.n_words, r.n_hit) for r in decontaminate.scan(docs, bench).collect()] == [(2, 0)]
    assert decontaminate.scan(docs.limit(0), bench).collect() == []
    assert decontaminate.drop_contaminated(docs, bench).count() == 1
    assert shared.words_of("É-a_B9") == ["É".encode(), b"a", b"b9"]
