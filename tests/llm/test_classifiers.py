import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spoor.llm import labelled, quality, shared, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "s", 0, 5, "q") for i, t in rows], SCHEMA)


def accuracy(spark, sf, query, label):
    got = {r.doc_id: r for r in query(spark, sf).collect()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == n
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(got[d].predicted, y) for d, y in labels.items() if d in got and got[d].held_out]
    return sum(p == y for p, y in held) / len(held), len(held)


def test_held_out_quality(spark):
    share, n = accuracy(spark, "/root/testdata/sf0.01", quality.op8_quality, "quality")
    assert n > 60 and share > 0.93, share


def test_held_out_toxicity(spark):
    share, n = accuracy(spark, "/root/testdata/sf0.1", toxicity.op9_toxicity, "toxic")
    assert n > 600 and share > 0.93, share


def test_bradley_terry_finds_the_order():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, quality.FEATURES))
    s = 2 * x[:, 0] - x[:, 3]
    y = (s + rnd.normal(size=600) * 0.1 > 0).astype(int)
    ranker = quality.fit(x, y, 5000)
    assert ((ranker.score(x) >= quality.THRESHOLD) == y).mean() > 0.95
    order = np.argsort(ranker.raw(x))
    assert y[order[-100:]].mean() > 0.98 > 0.02 > y[order[:100]].mean()
    assert quality.fit(x, np.ones(600)).score(x).min() > 0.99
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x), 0.5)


def test_newton_steps_reach_what_plain_descent_reaches():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(120, quality.FEATURES))
    y = (x[:, 1] - x[:, 5] + rnd.normal(size=120) > 0).astype(int)
    ranker = quality.fit(x, y, 400, seed=3)
    z = np.clip((x - np.median(x, axis=0)) / x.std(axis=0), -5, 5)
    wide = np.concatenate([z, np.abs(z)], axis=1)
    rnd = np.random.default_rng(3)
    a, b = rnd.choice(np.flatnonzero(y == 1), 400), rnd.choice(np.flatnonzero(y == 0), 400)
    w = [0.0] * wide.shape[1]
    pairs = [[float(p - q) for p, q in zip(wide[i], wide[j], strict=True)] for i, j in zip(a, b, strict=True)]

    def loss(w):
        return sum(math.log1p(math.exp(-sum(p * q for p, q in zip(d, w, strict=True)))) for d in pairs) / 400 + 5e-4 * sum(q * q for q in w)

    d = np.array(pairs)
    for _ in range(6000):
        w = w - 0.5 * (-d.T @ (1 / (1 + np.exp(d @ w))) / 400 + 1e-3 * np.array(w))
    assert abs(loss(list(w)) - loss(list(ranker.weights))) < 1e-4
    assert np.corrcoef(wide @ w, ranker.raw(x))[0, 1] > 0.999
    assert (ranker.score(x) < quality.THRESHOLD).mean() == ranker.quantile
    for q in (0.25, 0.9):
        assert abs((quality.fit(x, y, 400, quantile=q).score(x) < quality.THRESHOLD).mean() - q) < 0.01


def test_model_matches_plain_counts(spark):
    docs = [("common words here", 0)] * 1 + [(f"common words here n{i}", 0) for i in range(60)] + [(f"Common idiot here idiot n{i}", 1) for i in range(40)] * 2
    rows = frame(spark, [(i, t) for i, (t, _) in enumerate(docs)]).drop("label")
    pairs = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs)], "doc_id long, label int")
    model = toxicity.learn(rows.join(pairs, "doc_id"))
    n = [Counter(), Counter()]
    for t, y in set(docs):
        n[y].update(set(t.lower().split()))
    total = [sum(x.values()) for x in n]
    for w in n[0] | n[1]:
        p = []
        for c in (0, 1):
            e = (n[0][w] + n[1][w]) * total[c] / sum(total)
            off = n[c][w] - e
            own = math.copysign(max(abs(off) - 3 * math.sqrt(e + 1), 0), off)
            p.append(max(e + own, 1e-3) / total[c])
        assert abs(model.logs.get(w.encode(), 0.0) - math.log(p[1] / p[0])) < 1e-8, w
    assert model.logs[b"idiot"] > 0 and b"n3" not in model.logs
    assert abs(model.ratio("an idiot") - model.logs[b"idiot"] / 2) < 1e-12


def test_a_label_s_sample_weighs_as_much_as_the_label(spark):
    rows = frame(spark, [(i, f"text {i}") for i in range(6000)]).drop("label")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(6000)], "doc_id long, toxic int")
    whole = {r.label: r["count"] for r in labelled.chosen(labels, "toxic").groupBy("label").count().collect()}
    assert {r.weight for r in labelled.chosen(labels, "toxic").collect()} == {1.0}
    for most in (300, 1000):
        got = {r.label: r for r in labelled.sample(rows, labels, "toxic", most).groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
        assert got[0].n < 1.3 * most < whole[0]
        assert all(abs(got[c].w - whole[c]) < 1e-6 * whole[c] for c in (0, 1))


def test_cuts_are_the_same_from_a_sample(spark):
    rnd = np.random.default_rng(3)
    y = np.repeat([0, 1], [20000, 2000])
    some = np.concatenate((np.arange(0, 20000, 10), np.arange(20000, 22000)))
    weights = np.where(y[some] == 0, 10.0, 1.0)
    ratios = rnd.normal(size=22000) + 2 * y
    cuts = []
    for at, w in ((np.arange(22000), None), (some, weights), (some, None)):
        model = toxicity.Model({})
        toxicity.calibrate(model, ratios[at], y[at], w)
        cuts.append((math.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD)) - model.offset) / model.slope)
    assert abs(cuts[0] - cuts[1]) < 0.35 < cuts[0] - cuts[2], cuts
    x = rnd.normal(size=(22000, quality.FEATURES))
    x[:, 0] += 2 * y
    found = [(quality.fit(x[at], y[at], 5000, weights=w).score(x) >= quality.THRESHOLD).mean() for at, w in ((np.arange(22000), None), (some, weights), (some, None))]
    assert abs(found[0] - found[1]) < 0.03 < found[2] - found[0], found
    many = toxicity.learn(spark.createDataFrame([(0, f"plain word n{i}") for i in range(600)] + [(1, f"plain fool n{i}") for i in range(60)], "label int, text string"))
    few = toxicity.learn(spark.createDataFrame([(0, f"plain word n{i}", 10.0) for i in range(60)] + [(1, f"plain fool n{i}", 1.0) for i in range(60)], "label int, text string, weight double"))
    same = toxicity.learn(spark.createDataFrame([(0, f"plain word n{i}") for i in range(60)] + [(1, f"plain fool n{i}") for i in range(60)], "label int, text string"))
    assert abs(few.logs[b"word"] - many.logs[b"word"]) < abs(same.logs[b"word"] - many.logs[b"word"])


def labelled_texts(spark, n, every):
    words = "the old mill stood by a river and nobody had lived there for years".split()
    rows = [(i, " ".join(words[(i * k) % 13] + ("!" if i % every == 0 and k % 2 else "") for k in range(3 + i % 40))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % every > 0)) for i in range(n)], "doc_id long, quality int")
    used = [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 != 2]
    x = np.array([quality.features(rows[i][1]) for i in used])
    return frame(spark, rows).drop("label"), labels, x, np.array([int(i % every > 0) for i in used])


def test_quality_learns_from_all_pairs_of_a_block(spark):
    documents, labels, x, y = labelled_texts(spark, 80, 4)
    ranker = quality.learn(documents, labels)
    wide = ranker._wide(x)
    d = (wide[y == 1][:, None, :] - wide[y == 0][None, :, :]).reshape(-1, wide.shape[1])
    assert np.allclose(quality._newton(wide.shape[1], lambda w: quality._slopes(d, w)), ranker.weights, atol=1e-7)
    met = labelled.met_by_cut(y[np.argsort(ranker.raw(x), kind="stable")], np.ones(len(y)))
    assert ((ranker.score(x) >= quality.THRESHOLD) == y).sum() == met.max()


def test_quality_leaves_no_labelled_row_out(spark):
    documents, labels, x, y = labelled_texts(spark, 24_000, 8)
    assert (y == 1).sum() > labelled.SAMPLE
    ranker = quality.learn(documents, labels)
    assert np.allclose(ranker.center, x.mean(axis=0)) and np.allclose(ranker.spread, np.maximum(x.std(axis=0), 1e-6))
    assert abs(ranker.quantile - (ranker.score(x) < quality.THRESHOLD).mean()) < 1e-3
    rows = spark.createDataFrame([(i, int(c), [float(i)] * quality.FEATURES) for i, c in enumerate(y)], "doc_id long, label int, x array<double>")
    blocks = quality._blocks(rows, {0: int((y == 0).sum()), 1: int((y == 1).sum())}).collect()
    good, bad = Counter(v[0] for b in blocks for v in b.good), Counter(v[0] for b in blocks for v in b.bad)
    assert set(good) == set(np.flatnonzero(y == 1)) and set(good.values()) == {1} and set(bad) == set(np.flatnonzero(y == 0))
    assert all(b.good and b.bad for b in blocks) and max(len(b.good) * len(b.bad) for b in blocks) < 16_000


def test_toxicity_leaves_no_labelled_row_out(spark):
    texts = [f"w{i % 977} v{i % 1009} plain" + " fool" * (i % 20 == 0 and i % 140 > 0 or i % 900 == 1) + " word" * (i % 5) for i in range(440_000)]
    rows = spark.range(len(texts)).selectExpr(
        "id as doc_id",
        "concat('w', id % 977, ' v', id % 1009, ' plain', if(id % 20 = 0 and id % 140 > 0 or id % 900 = 1, ' fool', ''), repeat(' word', cast(id % 5 as int))) as text",
    )
    labels = spark.range(len(texts)).selectExpr("id as doc_id", "int(id % 20 = 0) as toxic")
    part = [zlib.crc32(str(i).encode()) % 4 for i in range(len(texts))]
    counted = [i for i, p in enumerate(part) if p < 2]
    apart = [i for i, p in enumerate(part) if p == 3]
    assert sum(i % 20 > 0 for i in counted) > 200_000 and sum(i % 20 > 0 for i in apart) > labelled.SAMPLE
    n = [Counter(), Counter()]
    for i in counted:
        n[i % 20 == 0].update(set(texts[i].split()))
    total = [sum(x.values()) for x in n]
    logs = {}
    for w in n[0] | n[1]:
        p = []
        for c in (0, 1):
            e = (n[0][w] + n[1][w]) * total[c] / sum(total)
            p.append(max(e + math.copysign(max(abs(n[c][w] - e) - 3 * math.sqrt(e + 1), 0), n[c][w] - e), 1e-3) / total[c])
        logs[w.encode()] = math.log(p[1] / p[0])
    model = toxicity.fit(rows, labels)
    assert b"fool" in model.logs and all(abs(model.logs.get(w, 0.0) - x) < 1e-9 for w, x in logs.items())
    plain = toxicity.Model(model.logs)
    toxicity.calibrate(plain, np.array([model.ratio(texts[i]) for i in apart]), np.array([int(i % 20 == 0) for i in apart]))
    assert np.allclose((plain.slope, plain.offset), (model.slope, model.offset), rtol=1e-7)


def test_toxicity_s_cut_is_the_same_from_a_table(spark):
    rnd = np.random.default_rng(7)
    mixed = rnd.integers(-9, 9, 60) / 8
    cases = [(mixed, (mixed + rnd.normal(size=60) > 0).astype(int)), (mixed, (mixed < 0).astype(int)), (mixed, np.ones(60, int)), (mixed, np.zeros(60, int)), (np.zeros(5), np.array([0, 1, 1, 0, 1])), (np.zeros(0), np.zeros(0, int))]
    for ratios, y in cases:
        one, other = toxicity.Model({}), toxicity.Model({})
        toxicity.calibrate(one, ratios, y)
        toxicity.calibrate_all(other, spark.createDataFrame([(int(c), float(r)) for c, r in zip(y, ratios, strict=True)], "label int, ratio double"))
        assert np.allclose((one.slope, one.offset), (other.slope, other.offset), rtol=1e-7), (ratios, y)


def test_edge_rows(spark):
    long = "word " * 100000
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "idiot"), (4, "!!!")]
    df = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranker = quality.learn(df, none)
    assert sorted(r.score for r in quality.score(df, ranker).collect()) == [0.5] * 6
    assert toxicity.fit(df, none) is None
    assert [r.score for r in toxicity.score(df, None).collect()] == [0.0] * 6
    assert quality.score(df.limit(0), ranker).collect() == [] and toxicity.score(df.limit(0), None).collect() == []
    same = frame(spark, [(i, f"good clean text here {i}" if i % 2 else f"idiot fool trash {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    assert 40 <= labelled.sample(same, labels, "toxic", 50).count() <= 160
    model = toxicity.fit(same, labels)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [(1, "good clean text"), (2, "idiot trash"), (3, None)]), model).collect()}
    assert got[2] > 0.3 > got[1] and 0 <= got[3] <= 1
    assert shared.words_of(None) == []
