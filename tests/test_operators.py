import random

import pytest
from pyspark.sql import functions as F

from spoor.functions import scalars as S
from spoor.operators import calls, carry, documents, filters, indexes, numbering, positions, ranges, stats

FIRST = """
[meta]
version = 1
[scope]
default_exec = "skip"
[[scope.rules]]
selector = "file:glob:shop/**/*.py"
exec = "trace"
[[scope.rules]]
selector = "file:regex:.*_gen[.]py$"
exec = "skip"
[[scope.rules]]
selector = "arg:glob:card*"
exec = "skip"
"""
SECOND = '[meta]\nversion = 1\n[[scope.rules]]\nselector = "file:literal:shop/api/v2_gen.py"\nexec = "trace"\n'


def test_filters(spark):
    rules = filters.compile_filters(FIRST, SECOND)
    want = {"shop/cart/total.py": "trace", "shop/api/v1_gen.py": "skip", "shop/api/v2_gen.py": "trace", "tools/build.py": "skip", "shop/readme.md": "skip"}
    df = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: r.d for r in df.select("path", rules.classify(F.col("path")).alias("d")).collect()} == want
    assert rules.rule_count == 3 and len(rules.warnings) == 1
    for glob, text, want in (("*.py", "a.py", True), ("*.py", "a/b.py", False), ("**/x", "x", True), ("a?c", "a/c", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a.b", "axb", False), ("**", "a/b", True), ("[ab", "[ab", True)):
        hit = spark.range(1).select(F.lit(text).rlike(filters.glob_regex(glob)).alias("x")).first().x
        assert hit == want, (glob, text)
    for bad in ("nocolon", "weird:x", "file:", "file:regex:"):
        with pytest.raises(ValueError):
            filters.parse_selector(bad)
    assert filters.parse_selector("file:foo:bar").pattern == "foo:bar"
    with pytest.raises(ValueError):
        filters.compile_filters("[meta]\nversion = 99\n")
    got = spark.range(1).select(filters.normalize_path(F.lit("/tmp/ab12/x/y")).alias("a"), filters.normalize_path(F.lit("/w/z"), "/w").alias("b"), filters.is_permanent(F.lit("x.idx")).alias("c"), filters.is_uuid7(F.lit("018f3e2a-0000-7abc-8def-0123456789ab")).alias("d")).first()
    assert tuple(got) == ("<tmp>/x/y", "<workdir>/z", True, True)


def test_scalars(spark):
    rows = [(v,) for v in (0, 1, -1, 63, -64, 127, 128, 16383, 16384, 2**40, -(2**40), 2**62)]
    df = spark.createDataFrame(rows, "v long")
    for r in df.select("v", S.unzigzag(S.zigzag(F.col("v"))).alias("b"), S.varint(F.abs("v")).alias("h"), S.varint_size(F.abs("v")).alias("n"), S.unvarint(S.varint(F.abs("v"))).alias("u")).collect():
        assert r.b == r.v and r.u == abs(r.v) and len(r.h) == 2 * r.n
    names = ["meta.dat", "a", "zz/9-.x", "012345678901", "------------"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.base40(F.col("n")).alias("c"), S.unbase40(S.base40(F.col("n"))).alias("b")).collect()
    for r in got:
        assert r.b == r.n and int(r.c) == sum(S.BASE40.index(c) * 40**i for i, c in enumerate(r.n))
    one = spark.range(1)
    raw = S.pack_slot(F.lit(77), F.lit(3), F.lit(9), F.lit(200))
    assert tuple(one.select(*S.unpack_slot(raw)).first()) == (77, 3, 9, 200)
    assert one.select(S.native_event_name(F.lit(61)), S.native_event_name(F.lit(57)), S.os_event_name(F.lit(14)), S.os_event_name(F.lit(99)), S.split_name(F.lit(12)), S.split_name(F.lit(1234567))).first()[:] == ("evGfxDrawCall", "ev_unknown_57", "elkGetrandom", "elk_unknown_99", "000012.ct", "1234567.ct")
    text = "018f3e2a-1c00-7abc-8def-0123456789ab"
    assert one.select(S.uuid7_ms(F.lit(text)), S.uuid_text(S.uuid_bytes(F.lit(text)))).first()[:] == (int("018f3e2a1c00", 16), text)
    assert [r.k for r in spark.createDataFrame([(i,) for i in (0, 4, 11, 12, 200)], "i int").select(S.io_kind(F.col("i")).alias("k")).collect()] == ["stdout", "file", "error", "stderr", "stdout"]
    with pytest.raises(Exception):
        one.select(S.state(F.lit("odd"), ("ok",))).collect()


def test_positions_sort_each_chunk_once(spark):
    rnd = random.Random(5)
    rows, at, want = [], {"a": 0, "b": 0}, {}
    for i in range(600):
        for t in at:
            kind = rnd.choice(["absolute", "delta", "delta_column", "raise"] if i % 50 > 9 else ["delta", "raise"])
            v = rnd.randrange(2**62) if kind == "absolute" else rnd.randrange(-9, 10)
            at[t] = v if kind == "absolute" else at[t] + v * (kind != "raise")
            rows.append((t, i, i // 16, kind, v))
            want[t, i] = at[t]
    rnd.shuffle(rows)
    steps = spark.createDataFrame(rows, "trace_id string, step_id long, chunk_id long, kind string, v long")
    assert {(r.trace_id, r.step_id): r.position for r in positions.positions(steps, ("trace_id",)).collect()} == want
    plan = positions.within_chunks(steps, ("trace_id",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1, plan


def test_position_carry_over_chunks(spark):
    rows = [(0, 0, "absolute", 5), (1, 0, "delta", 4), (2, 1, "raise", 0), (3, 1, "delta", 5), (4, 2, "delta", 1), (5, 3, "catch", 0), (6, 3, "absolute", 2), (7, 3, "delta_column", 3)]
    steps = spark.createDataFrame(rows, "step_id long, chunk_id long, kind string, v long")
    assert [r.position for r in positions.positions(steps).orderBy("step_id").collect()] == [5, 9, 9, 14, 15, 15, 2, 5]
    assert [r.position for r in positions.position_point(steps).orderBy("step_id").collect()][2:5] == [0, 5, 1]
    assert positions.positions(steps.limit(0)).collect() == []


def test_encode_then_rebuild(spark):
    rnd = random.Random(3)
    want = {i: 500 + rnd.randrange(-90, 90) for i in range(300)}
    df = spark.createDataFrame(list(want.items()), "step_id long, position long")
    back = positions.positions(positions.encode_steps(df, 64))
    assert {r.step_id: r.position for r in back.collect()} == want


@pytest.mark.parametrize("width", [1, 7, 256])
def test_enclosing_call_equals_the_plain_join(spark, width):
    spans = [(0, 0, 99), (1, 2, 40), (2, 3, 3), (3, 5, 30), (4, 41, 98), (5, 60, 60), (6, 150, 160), (7, 5, 4)]
    table = spark.createDataFrame([(k, 0, a, b, 0) for k, a, b in spans], "call_key long, function_id long, entry_step long, exit_step long, depth int")
    steps = spark.range(0, 170).withColumnRenamed("id", "step_id")
    want = {s: max((k for k, a, b in spans if a <= s <= b), default=None) for s in range(170)}
    assert {r.step_id: r.call_key for r in calls.enclosing(steps, table, width).collect()} == want


def test_call_tree_and_errors(spark):
    sig = [(0, "enter", 1), (1, "enter", 2), (2, "return", None), (3, "enter", 3), (4, "enter", 4), (5, "return", None), (9, "return", None), (12, "enter", 5)]
    df = spark.createDataFrame(sig, "seq long, kind string, function_id long")
    got = sorted(tuple(r) for r in calls.call_tree(df, width=4).select("call_key", "function_id", "enter_seq", "exit_seq", "depth", "parent_call_key").collect())
    assert got == [(0, 1, 0, 12, 0, -1), (1, 2, 1, 2, 1, 0), (2, 3, 3, 9, 1, 0), (3, 4, 4, 5, 2, 2), (4, 5, 12, 12, 1, 0)]
    tree = calls.call_tree(df)
    assert {r.parent_call_key: r.children for r in calls.children(tree).collect()} == {0: [1, 2, 4], 2: [3]}
    assert sorted((r.parent_call_key, r.chunk_no, r.children) for r in calls.children(tree, 2).collect()) == [(0, 0, [1]), (0, 1, [2]), (0, 2, [4]), (2, 1, [3])]
    with pytest.raises(Exception):
        calls.call_tree(spark.createDataFrame([(0, "return", 1), (1, "enter", 2)], "seq long, kind string, function_id long")).collect()


def test_step_map_in_chunks(spark):
    rnd = random.Random(6)
    rows = [(rnd.randrange(3), rnd.randrange(4), s) for s in rnd.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "path_id long, line long, step_id long")
    want = {}
    for p, line, s in sorted(rows, key=lambda r: r[2]):
        want.setdefault((p, line, s // 300), []).append(s)
    got = indexes.step_map(df, 300).collect()
    assert {(r.path_id, r.line, r.chunk_no): r.step_ids for r in got} == want
    assert all((r.step_count, r.first_step_id, r.last_step_id) == (len(r.step_ids), r.step_ids[0], r.step_ids[-1]) for r in got)
    assert indexes.step_map(df.limit(0)).collect() == []


def test_indexes(spark, tmp_path):
    hits = spark.createDataFrame([(1, [1, 2], 2)], "gli long, step_ids array<long>, n long")
    with pytest.raises(Exception):
        indexes.lookup_hits(hits, spark.createDataFrame([(9,)], "gli long")).collect()
    keys = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "key long, payload string")
    indexes.bulk_load(keys, "key", str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 3
    with pytest.raises(Exception):
        indexes.bulk_load(keys.union(keys), "key", str(tmp_path / "k2"))


def test_numbers_ranges_and_carry(spark):
    df = spark.createDataFrame([(x,) for x in (900000, 5, 70000, -3)], "o long")
    assert {r.o: r.n for r in numbering.dense(df, "o", "n").collect()} == {-3: 0, 5: 1, 70000: 2, 900000: 3}
    bases = spark.createDataFrame([(b,) for b in (10, 20, 5000)], "base long")
    points = spark.createDataFrame([(p,) for p in (9, 10, 19, 20, 4999, 5000, 99999)], "p long")
    got = {r.p: r.base for r in ranges.as_of(points, bases, "p", "base", 16).collect()}
    assert got == {10: 10, 19: 10, 20: 20, 4999: 20, 5000: 5000, 99999: 5000}
    sig = spark.createDataFrame([(0, None), (1, None), (2, 7), (30, None), (90, 8), (91, None)], "seq long, step_id long")
    assert {r.seq: r.target for r in carry.carry_forward(sig, 10).collect()} == {0: 7, 1: 7, 2: 7, 30: 8, 90: 8, 91: None}
    sizes = spark.createDataFrame([(x,) for x in (0, 1, 2, 3)], "x long")
    assert stats.index_percentiles(sizes, "x").first().median == 2
    assert stats.hit_rate(spark.createDataFrame([], "hit boolean")).first()[0] == 0


def test_document_puts_late_entries_last(spark):
    steps = spark.createDataFrame([(0, "absolute"), (1, "delta_column")], "step_id long, kind string")
    table = spark.createDataFrame([(0, 1, 0, 1), (1, 2, 9, 9)], "call_key long, function_id long, entry_step long, exit_step long")
    ios = spark.createDataFrame([(0, 0, "stdout")], "io_index long, step_id long, kind string")
    rows = [(r.step_id, r.kind, r.ordinal) for r in documents.document(steps, table, ios).orderBy(*documents.ORDER).collect()]
    assert rows == [(0, "call_entry", 0), (0, "step", 0), (0, "io", 0), (1, "call_exit", 0), (9, "call_entry", 1)]
