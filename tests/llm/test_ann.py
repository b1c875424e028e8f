import math

import numpy as np
from pyspark.sql import functions as F

from spoor.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v int, block int"


def brute(rows, every, k=5):
    vs = {i: np.array(v, dtype=float) for i, v in sorted(rows, key=str) if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)}
    unit = {i: v / math.sqrt((v * v).sum()) for i, v in vs.items()}
    out = {}
    for q in (i for i in vs if i % every == 0):
        near = sorted(((-float((unit[i] * unit[q]).sum()), i) for i in vs if i != q and len(vs[i]) == len(vs[q])))[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def compare(got, want):
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(by[r.query_id])
    assert set(by) == {q for q, x in want.items() if x}
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in by)
    for q in by:
        assert len(by[q]) == len(want[q])
        for (_, s), (_, t) in zip(by[q], want[q]):
            assert s <= t + 1e-9
    return hits / sum(len(x) for x in want.values())


def test_recall_on_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert compare(ann.op6_ann(spark, sf).collect(), brute(rows, 50)) > 0.99


def test_many_blocks_and_random_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 300)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(size=32).astype(np.float32)]) for i in range(2000)]
    df = spark.createDataFrame([(i, v, 0, "s", 1, 2) for i, v in rows], SCHEMA)
    assert compare(ann.search(df, F.col("vec_id") % 20 == 0).collect(), brute(rows, 20)) > 0.97


def test_estimates_lie_within_their_bounds():
    rnd = np.random.default_rng(5)
    for dim in (3, 64, 100):
        vs, qs = ann.unit(rnd.normal(size=(400, dim))), ann.unit(rnd.normal(size=(20, dim)))
        packed, factors = ann.codes(vs @ ann.rotation(dim))
        bits, step, low = ann.planes(qs @ ann.rotation(dim))
        words = np.ascontiguousarray(packed.T)
        off = []
        for i, q in enumerate(qs):
            found, bound = ann.estimates(words, factors, (bits[i], step[i], low[i]))
            off.append(np.abs(found - vs @ q) / bound)
        assert (np.array(off) <= 1).mean() > 0.995 and np.median(off) > 0.02, dim


def test_copies_of_a_query_and_of_its_neighbours(spark):
    rnd = np.random.default_rng(9)
    bases = [[float(x) for x in rnd.normal(size=8).astype(np.float32)] for _ in range(6)]
    rows = [(i, bases[0] if i % 3 == 0 else bases[i % 6]) for i in range(600)]
    df = spark.createDataFrame([(i, v, 0, "s", 1, 2) for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    want = brute(rows, 50)
    same = [(q, i) for q, x in want.items() for i, _ in x]
    assert [(q, v) for q, _, v in got] == sorted(same, key=lambda x: x[0]) or {(q, v) for q, _, v in got} == set(same)


def test_edge_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(0, one), (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0])]
    rows += [(i, one) for i in range(10, 40)] + [(50, [1.0, 1.0]), (60, [1e-30, 0.0, 0.0]), (70, [-1.0, -2.0, -3.0]), (None, one), (100, [3e38, 3e38, 3e38])]
    df = spark.createDataFrame([(i, v, 0, "s", 1, 2) for i, v in rows + rows[:1]], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
    assert [x for x in got if x[0] == 0] == [(0, i + 1, 10 + i) for i in range(5)]
    assert not [x for x in got if x[0] == 50]  # no other vector of two components
    assert [x[2] for x in got if x[0] == 100] == [0, 10, 11, 12, 13]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, one, 0, "s", 1, 2), (1, [1.0, 0.0, 0.0], 0, "s", 1, 2)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
