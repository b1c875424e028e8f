import random
import struct
import tracemalloc

import pyarrow as pa
import pytest

from spoor.sources import container, manifests, native, values


def write(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)


def test_container_round_trip(spark, tmp_path):
    rnd = random.Random(1)
    big = rnd.randbytes(64 * 7 * 7 * 3 + 5)  # three levels of maps in blocks of 64 bytes
    rows = [("absolute", 100001, b""), ("delta", -3, b""), ("raise", 7, b"boom"), ("delta", 63, b""), ("thread_switch", 300, b""), ("delta_column", -64, b"")]
    thread = struct.pack("<HIIQQ", 20, 3, 5, 9, 11) + b"hi\n" + struct.pack("<HIIQQ", 57, 0, 6, 10, 12)
    files = {"steps.raw": container.encode_steps(rows), "big.dat": big, "t0.dat": thread, "empty": b""}
    write(tmp_path, "a.ct", container.build(files, block_size=64 * 4, max_entries=6))
    write(tmp_path, "small.ct", container.build({"big.dat": big}, block_size=64, max_entries=1))
    write(tmp_path, "junk.ct", b"no container at all, only text")
    assert container.read_file((tmp_path / "small.ct").read_bytes(), "big.dat") == big
    opened = container.open_files(spark, str(tmp_path))
    heads = {r.path.rsplit("/", 1)[1]: r for r in container.headers(opened).collect()}
    assert heads["a.ct"].is_readable and heads["a.ct"].block_size == 256 and heads["a.ct"].encryption == "none"
    assert not heads["junk.ct"].is_container
    third = bytearray((tmp_path / "a.ct").read_bytes())
    third[5:8] = 3, 1, 1
    old = spark.createDataFrame([("x.ct", third)], "path string, content binary")
    assert container.headers(old).select("compression", "encryption", "max_shards").first()[:] == ("zstd", "aes256gcm", 1)
    good = opened.where("path like '%a.ct'")
    assert {(r.name, r["size"]) for r in container.directory(good).collect()} == {(n, len(d)) for n, d in files.items()}
    assert [bytes(r.content) for r in container.streams(good, "big.dat").collect()] == [big]
    got = container.steps(good).orderBy("step_id").collect()
    assert [(r.kind, r.v, bytes(r.message)) for r in got] == rows
    events = container.thread_events(good, 4, "t0.dat").orderBy("stream_offset").collect()
    assert [(r.event_type, r.ct_tid, r.geid, r.tick, bytes(r.payload), r.stream_offset) for r in events] == [(20, 5, 9, 11, b"hi\n", 0), (57, 6, 10, 12, b"", 29)]
    assert container.fixed_records(good, "t0.dat", 5).count() == len(thread) // 5
    assert [r["index"] for r in container.split_traces(spark, str(tmp_path)).orderBy("index").collect()] == [0, 1, 2]


def test_variable_records(spark, tmp_path):
    offsets = struct.pack("<3Q", 0, 4, 4)
    write(tmp_path, "v.ct", container.build({"n.dat": b"mainhelper", "n.off": offsets}))
    rows = container.variable_records(container.open_files(spark, str(tmp_path)), "n").orderBy("index").collect()
    assert [bytes(r.record) for r in rows if r.record] == [b"main", b"helper"]


def test_contents_become_python_values_one_at_a_time():
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(40)]), pa.array([bytes(1 << 20)] * 40)], names=["path", "content"])
    tracemalloc.start()
    assert sum(len(content) for _, content in container.rows_of([batch])) == 40 << 20
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20, peak


def test_long_thread_streams_come_in_parts(spark):
    one = b"".join(struct.pack("<HIIQQ", 1, 2, 7, i, i) + b"ab" for i in range(25_000))
    files = spark.createDataFrame([("a", container.build({"t7": one})), ("b", container.build({"x": b"1"}))], "path string, content binary")
    rows = native.thread_events(files)
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 25_000
    assert {r.geid for r in rows.collect()} == set(range(25_000))


def test_variable_records_read_each_container_once(spark):
    texts = {f"c{k}": [b"x" * ((i * k) % 5) for i in range(30)] for k in range(1, 4)}
    built = []
    for path, parts in texts.items():
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        built.append((path, container.build({"n.dat": b"".join(parts), "n.off": struct.pack("<30Q", *starts) + b"odd"})))
    built += [("no.off", container.build({"n.dat": b"abc"})), ("no.dat", container.build({"n.off": bytes(8)}))]
    rows = container.variable_records(spark.createDataFrame(built, "path string, content binary"), "n")
    assert {(r.path, r["index"], bytes(r.record)) for r in rows.collect()} == {(p, i, x) for p, parts in texts.items() for i, x in enumerate(parts) if x}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_manifest_and_values(spark):
    text = '{"trace_id":"t","segments":[{"index":0,"shards":[{"index":0,"block_start":0,"block_end":9,"replicas":[{"replica_no":2,"uri":"b"},{"replica_no":1,"uri":"a"}]}]}]}'
    rows = manifests.parse(spark.createDataFrame([(text,)], "value string"))
    wanted = spark.createDataFrame([(0, 5), (0, 99)], "segment int, block_id long")
    assert [(r.block_id, [x.uri for x in r.replicas]) for r in manifests.locate(rows, wanted).collect()] == [(5, ["a", "b"])]
    with pytest.raises(Exception):
        manifests.parse(spark.createDataFrame([("{oops",)], "value string")).collect()
    df = values.parse(spark.createDataFrame([('{"kind":"Int","i":5,"type_id":7}',), ("",), ("{bad",), ('{"kind":"Cell"}',)], "value string"))
    got = df.select(values.kind(df.value).alias("k"), values.type_id(df.value).alias("t")).collect()
    assert [tuple(r) for r in got] == [("Int", 7), ("Empty", 0), ("Undecodable", 0), ("Cell", 0)]
