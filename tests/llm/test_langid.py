from spoor.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 0, "q", "p") for i, t, g in rows], SCHEMA)


def test_held_out_accuracy(spark, sf):
    got = {r.doc_id: r for r in langid.op5_langid(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert len(held) > 40
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_counts_match_brute_force(spark):
    docs = frame(spark, [(1, "The cat, the cat!", "en"), (2, "le chat", "fr"), (3, "x", None), (4, None, "fr"), (5, "", "de"), (6, "the", "en")])
    model = langid.learn(docs)
    assert model.languages == ["en", "fr"]
    import math

    assert abs(model.word_logs[model.words["the"]][0] - math.log(3 / 5)) < 1e-12
    assert abs(model.word_logs[model.words["the"]][1] - math.log(0.5 / 2)) < 1e-12
    k = model.grams[1]["t$"]
    assert abs(model.gram_logs[1][k][0] - math.log(2 / sum(n * (len(w) + 1) for w, n in (("the", 3), ("cat", 2))))) < 1e-12


def test_backoff_and_edge_rows(spark):
    docs = frame(spark, [(i, "strasse und haus gehen sehen", "de") for i in range(4)] + [(i + 10, "casa perro ñandú cantar", "es") for i in range(4)])
    model = langid.learn(docs)
    long = "haus " * 60000
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "stehen", None), (5, "ñandúes", "de"), (None, "perros", None), (6, long, None), (6, long, None), (7, "日本", None)]
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.predict(frame(spark, rows), model).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert {x for x in got if x[0] not in (1, 2, 3, 7)} == {(4, "de"), (5, "es"), (None, "es"), (6, "de")}
    assert len(got) == len(rows)
    kept = langid.keep_identified(frame(spark, rows), model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "5", "6", "6", "None"]


def test_nothing_to_learn(spark):
    empty = frame(spark, [])
    model = langid.learn(empty)
    assert langid.predict(empty, model).collect() == []
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, "word", None)]), model).collect()] == ["und"]


def plain(docs, text):
    """The prediction by the formula alone: dictionaries of counts, one language at a time."""
    import math
    import re
    from collections import Counter

    words = lambda t: re.findall(r"[a-z\x80-\U0010ffff]+", (t or "").lower())
    langs = sorted({g for _, t, g in docs if g is not None and words(t)})
    own = words(text)
    if not langs or not own:
        return "und", 0.0
    seen = {g: Counter(w for _, t, x in docs if x == g for w in words(t)) for g in langs}
    cut = lambda w, n: [x for x in (f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)) if x not in ("^", "$")] if n > 1 else list(w)
    grams = {(g, n): Counter(x for w, k in seen[g].items() for x in cut(w, n) * k) for g in langs for n in range(1, 5)}
    log = lambda counts, x: math.log((counts[x] or 0.5) / max(1, sum(counts.values())))
    total = dict.fromkeys(langs, 0.0)
    for w in own:
        if any(seen[g][w] for g in langs):
            for g in langs:
                total[g] += log(seen[g], w)
            continue
        for n in range(4, 0, -1):
            known = [x for x in cut(w, n) if any(grams[g, n][x] for g in langs)]
            if known:
                for g in langs:
                    total[g] += sum(log(grams[g, n], x) for x in known) / len(known)
                break
    odds = {g: math.exp((total[g] - max(total.values())) / len(own) * min(len(own), 24)) for g in langs}
    best = max(langs, key=lambda g: odds[g])
    return best, odds[best] / sum(odds.values())


def test_predictions_match_the_plain_formula(spark):
    import random

    rnd = random.Random(12)
    stems = {"de": ["haus", "straße", "und", "gehen", "ein"], "es": ["casa", "niño", "y", "cantar", "un"], "en": ["house", "street", "and", "sing", "a"]}
    make = lambda g: " ".join(rnd.choice(stems[g]) + rnd.choice(["", "", "n", "s", "ción", "ed"]) for _ in range(rnd.randrange(1, 40)))
    docs = [(i, make(g), g) for i, g in enumerate(rnd.choice(["de", "es", "en"]) for _ in range(60))]
    model = langid.learn(frame(spark, docs))
    rows = [(i, make(rnd.choice(["de", "es", "en"])) + rnd.choice(["", " xyz", " 日本", " singt!"]), None) for i in range(80)] + [(99, "?!", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(frame(spark, rows), model).collect()}
    for i, t, _ in rows:
        lang, score = plain(docs, t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, t


def test_a_large_language_gives_a_bounded_sample(spark):
    docs = frame(spark, [(i, "w", "en" if i % 10 else "de") for i in range(4000)])
    n = {r.lang: r["count"] for r in langid.bounded(docs, most=600).groupBy("lang").count().collect()}
    assert n["de"] == 400 and 450 < n["en"] < 750
