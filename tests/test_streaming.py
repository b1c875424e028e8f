from spoor.streaming import follow

SCHEMA = "thread_id long, seq long, kind string, name string"


def test_follow_gives_each_row_once(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    sink = lambda df, n: seen.extend(r.step_id for r in df.collect())
    for part in (range(0, 5), range(5, 8)):
        spark.createDataFrame([(i,) for i in part], "step_id long").coalesce(1).write.mode("append").parquet(source)
        follow.run(follow.follow(spark, source, "step_id long"), sink, str(tmp_path / "ck"), once=True).awaitTermination(60)
        assert sorted(seen) == list(range(part.stop))


def test_pending_steps_keep_state_over_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 0, "step", None), (1, 1, "value", "a"), (2, 2, "step", None)], [(1, 3, "value", "b"), (1, 4, "step", None), (2, 5, "step", None)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        follow.append(follow.pending_steps(follow.follow(spark, source, SCHEMA)), out, str(tmp_path / "ck")).awaitTermination(90)
    got = {(r.thread_id, r.step_seq): list(r.names) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0): ["a", "b"], (2, 2): []}


def test_drain(spark):
    calls = spark.createDataFrame([(0, 5), (1, None)], "call_key long, exit_step long")
    steps = spark.createDataFrame([(7,), (9,)], "step_id long")
    assert {r.call_key: r.exit_step for r in follow.drain(calls, steps).collect()} == {0: 5, 1: 9}
