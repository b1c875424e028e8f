import random

import pytest
from pyspark.sql import functions as F

from spoor.sources import cbor, container, frames, metadata, records


def test_frames_of_any_size_and_format(spark):
    rnd = random.Random(2)
    parts = [rnd.randbytes(n) for n in (0, 1, 700, 30_000, 5)]
    for head in (False, True):
        rows = [("a", frames.seekable(parts, head)), ("none", frames.seekable([], head))]
        files = spark.createDataFrame(rows, "path string, content binary")
        table = {r.frame: (r["size"], r["at"]) for r in frames.seek_table(files, head).collect()}
        assert table == {i: (len(p), sum(map(len, parts[:i]))) for i, p in enumerate(parts)}
        assert {r.frame: bytes(r.data) for r in frames.frames(files, head).collect()} == dict(enumerate(parts))
        assert {r.frame for r in frames.frames(files, head, 690, 702).collect()} == {2, 3}
    with pytest.raises(Exception):
        frames.seek_table(spark.createDataFrame([("x", b"no table of frames here")], "path string, content binary")).collect()


def test_empty_streams(spark):
    data, index = frames.table_of([], 8)
    files = spark.createDataFrame([("a", container.build({"steps.dat": b"", "t.dat": data, "t.idx": index}))], "path string, content binary")
    assert frames.chunks(files, "steps.dat").collect() == [] and frames.chunked_records(files, "t", 8).collect() == []


def test_cbor_of_the_standard_s_examples(spark):
    # Examples of RFC 8949.
    examples = {"00": 0, "1818": 24, "1903e8": 1000, "1b000000e8d4a51000": 10**12, "20": -1, "3863": -100, "fb3ff199999999999a": 1.1, "f4": False, "f5": True, "f6": None, "4401020304": b"\1\2\3\4", "6449455446": "IETF", "83010203": [1, 2, 3], "a26161016162820203": {"a": 1, "b": [2, 3]}, "c11a514b67b0": 1363896240}
    for text, value in examples.items():
        assert cbor.loads(bytes.fromhex(text)) == value
        if text[0] != "c":
            assert cbor.dumps(value).hex() == text
    record = {"kind": "Struct", "field_values": [{"kind": "BigInt", "b": b"\1\xff", "negative": True}, {"kind": "Bool", "b": False}], "field_names": ["x", "y"]}
    df = spark.createDataFrame([(1, cbor.dumps(record)), (2, b""), (3, b"\xa1\x01"), (4, None)], "i int, data binary")
    got = {r.i: r.j for r in df.select("i", cbor.to_json(F.col("data")).alias("j")).collect()}
    big, flag = '{"kind":"BigInt","b":"Af8=","b_hex":"01ff","negative":true}', '{"kind":"Bool","b":false,"text":"false"}'
    assert got == {1: f'{{"kind":"Struct","field_values":[{big},{flag}],"fields":[["x",{big}],["y",{flag}]]}}', 2: '{"kind":"Empty"}', 3: '{"kind":"Undecodable","hex":"a101"}', 4: None}


def test_records_keep_every_field(spark):
    call = {"function_id": 300, "parent_call_key": -1, "entry_step": 0, "exit_step": 2**40, "depth": 2, "args": [(1, b""), (200, b"\xf6")], "return_value": b"\x01", "exception": b"oops", "children": [5, 6, 700]}
    calls = [call, call | {"return_value": records.VOID, "args": [], "children": [], "parent_call_key": 9}]
    dat, idx = records.stream_of([records.encode_call(c) for c in calls], 1)
    values = [[], [(3, b"\x00"), (4, b"")], []]
    vdat, vidx = records.stream_of([records.encode_values(v) for v in values], 2)
    edat, eidx = records.stream_of([records.encode_io(12, 7, b"meta", b"hello"), records.encode_io(4, 8, b"", b"")], 64)
    files = {"calls.dat": dat, "calls.idx": idx, "values.dat": vdat, "values.idx": vidx, "events.dat": edat, "events.idx": eidx}
    opened = spark.createDataFrame([("a", container.build(files)), ("b", container.build({"other": b"x"}))], "path string, content binary")
    got = records.calls(opened).orderBy("call_key").collect()
    assert [(r.call_key, r.function_id, r.parent_call_key, r.entry_step, r.exit_step, r.depth, r.return_value, bytes(r.exception), r.children) for r in got] == [(0, 300, -1, 0, 2**40, 2, b"\x01", b"oops", [5, 6, 700]), (1, 300, 9, 0, 2**40, 2, None, b"oops", [])]
    assert [(r.call_key, r.ordinal, r.varname_id, bytes(r.value)) for r in records.arguments(records.calls(opened)).orderBy("ordinal").collect()] == [(0, 0, 1, b""), (0, 1, 200, b"\xf6")]
    assert [(r.step_id, r.ordinal, r.varname_id, bytes(r.value)) for r in records.step_values(opened).orderBy("ordinal").collect()] == [(1, 0, 3, b"\x00"), (1, 1, 4, b"")]
    assert [(r.io_index, r.kind, r.step_id, bytes(r.metadata), bytes(r.data)) for r in records.io_events(opened).orderBy("io_index").collect()] == [(0, "stderr", 7, b"meta", b"hello"), (1, "file", 8, b"", b"")]
    with pytest.raises(ValueError):
        records.decode_io(records.encode_io(0, 1, b"", b"") + b"x")


def test_metadata(spark):
    data = metadata.build("018f3e2a-1c00-7abc-8def-0123456789ab", "prög", ["a", ""], "/w", "r", ["/x"] * 200, 1 << 4 | 1 << 12)
    bad = bytearray(data)
    bad[7] |= 0x80
    rows = [("a", container.build({"meta.dat": data}))]
    got = metadata.read(spark.createDataFrame(rows, "path string, content binary")).first()
    assert (got.program, got.args, len(got.paths), got.features) == ("prög", ["a", ""], 200, ["column_aware_steps", "interning_tables"])
    with pytest.raises(Exception):
        metadata.read(spark.createDataFrame([("a", container.build({"meta.dat": bytes(bad)}))], "path string, content binary")).collect()
