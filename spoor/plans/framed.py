"""Registered queries over compressed streams and CBOR values."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import cbor, container, frames, metadata, native, records
from . import projections as T
from .queries import MOVING
from .registry import query

#: Bytes of a frame, steps of a chunk of the step stream and records of a chunk of a table in these queries.
FRAME, STEPS, RECORDS = 1000, 512, 256


def _props(spark, sf, head=False):
    """path, content: the properties of each 4,096 events as a text, in frames."""

    def build(key, rows):
        text = "".join(f"{x}\n" for x in rows.column("props").to_pylist()).encode()
        packed = frames.seekable([text[i : i + FRAME] for i in range(0, len(text), FRAME)], head)
        return pa.table({"path": [f"props-{key[0].as_py()}"], "content": pa.array([packed], pa.binary())})

    rows = T.table(spark, sf, "events").selectExpr(f"event_id div {T.CHUNK} as chunk_id", "event_id", "props")
    return rows.groupBy("chunk_id").applyInArrow(lambda key, t: build(key, t.sort_by("event_id")), "path string, content binary")


_TEXTS = f"""texts AS (SELECT 'props-' || (event_id // {T.CHUNK}) AS path, string_agg(props || chr(10), '' ORDER BY event_id) AS text FROM events GROUP BY 1),
parts AS (SELECT path, f AS frame, f * {FRAME} AS "at", substr(text, f * {FRAME} + 1, {FRAME}) AS data
  FROM (SELECT path, text, unnest(range(0, (length(text) + {FRAME - 1}) // {FRAME})) AS f FROM texts))"""


@query('SELECT path, CAST(frame AS INTEGER) AS frame, strlen(data) AS size, "at" FROM parts', _TEXTS)
def seek_table(spark, sf):
    """Sizes and offsets of frames from the table behind them (A)."""
    return frames.seek_table(_props(spark, sf)).select("path", "frame", "size", "at")


@query('SELECT path, CAST(frame AS INTEGER) AS frame, "at", data FROM parts', _TEXTS)
def frame_texts(spark, sf):
    """Every frame decompressed, of files whose table comes first (A)."""
    found = frames.frames(_props(spark, sf, True), True)
    return found.select("path", "frame", "at", F.col("data").cast("string").alias("data"))


@query('SELECT path, CAST(frame AS INTEGER) AS frame, data FROM parts WHERE "at" + strlen(data) > 5500 AND "at" < 9000', _TEXTS)
def frame_range(spark, sf):
    """The frames that hold a range of bytes (A)."""
    return frames.frames(_props(spark, sf), low=5500, high=9000).select("path", "frame", F.col("data").cast("string").alias("data"))


def _streams(spark, sf):
    """path, content: containers of 4,096 steps with a chunked step stream and a chunked table of thread numbers."""

    def build(key, rows):
        steps = [(r["kind"], r["v"], b"") for r in rows.select(["kind", "v"]).to_pylist()]
        parts = [(len(steps[i : i + STEPS]), i, container.encode_steps(steps[i : i + STEPS])) for i in range(0, len(steps), STEPS)]
        data, index = frames.table_of([r.to_bytes(8, "little") for r in rows.column("thread_id").to_pylist()], RECORDS)
        files = {"steps.dat": frames.chunked(parts), "threads.dat": data, "threads.idx": index}
        return pa.table({"path": [f"chunk-{key[0].as_py():09d}.ct"], "content": pa.array([container.build(files)], pa.binary())})

    moved = T.steps(spark, sf).selectExpr("chunk_id", "step_id", f"if({MOVING}, kind, 'thread_switch') as kind", f"if({MOVING}, v, thread_id) as v", "thread_id")
    return moved.groupBy("chunk_id").applyInArrow(lambda key, t: build(key, t.sort_by("step_id")), "path string, content binary")


_PATH = "printf('chunk-%09d.ct', chunk_id) AS path"


@query(f"SELECT {_PATH}, (step_id % {T.CHUNK}) // {STEPS} AS chunk, count(*) AS event_count, min(step_id % {T.CHUNK}) AS first FROM steps GROUP BY 1, 2", T.STEPS)
def chunk_headers(spark, sf):
    """Headers of the chunks of a step stream (A)."""
    return frames.chunks(_streams(spark, sf), "steps.dat").select("path", "chunk", "event_count", "first")


@query(f"SELECT {_PATH}, step_id % {T.CHUNK} AS step_id, CASE WHEN {MOVING} THEN kind ELSE 'thread_switch' END AS kind, CASE WHEN {MOVING} THEN v ELSE thread_id END AS v FROM steps", T.STEPS)
def chunked_steps(spark, sf):
    """Steps of compressed chunks, each chunk decoded on its own (A)."""
    return frames.chunked_steps(_streams(spark, sf))


@query(f"SELECT {_PATH}, step_id % {T.CHUNK} AS index, thread_id FROM steps", T.STEPS)
def chunked_records(spark, sf):
    """Records of a table in compressed chunks (A)."""
    rows = frames.chunked_records(_streams(spark, sf), "threads", 8)
    return rows.select("path", "index", container.number(F.col("record"), 0, 8).cast("long").alias("thread_id"))


#: Records of a chunk of calls, values and I/O events in these queries.
CALLS, VALUES, IOS = 64, 128, 32


def _records(spark, sf):
    """path, content: containers of the calls and I/O events that begin in each 4,096 steps, the values of these steps, and metadata."""

    def build(key, rows):
        number = key[0].as_py()
        of = {kind: [r for r in rows.to_pylist() if r["what"] == kind] for kind in ("call", "io", "value")}
        calls = [
            records.encode_call({"function_id": r["a"], "parent_call_key": r["b"], "entry_step": r["at"], "exit_step": r["c"], "depth": r["b"] % 3 if r["b"] > 0 else 0,
                                 "args": [(r["a"] % 5, cbor.dumps({"kind": "Int", "i": r["at"]}))], "return_value": records.VOID, "exception": b"", "children": [r["n"], r["n"] + 1]})
            for r in of["call"]
        ]
        ios = [records.encode_io(r["a"], r["at"], b"", r["text"].encode()) for r in of["io"]]
        steps: dict[int, list] = {}
        for r in of["value"]:
            steps.setdefault(r["at"] % T.CHUNK, []).append((r["a"], cbor.dumps({"kind": "Int", "i": r["b"], "type_id": 7})))
        values = [records.encode_values(steps.get(i, [])) for i in range(max(steps, default=-1) + 1)]
        meta = metadata.build(f"018f3e2a-1c00-7abc-8def-{number:012d}", "demo", ["-x", str(number)], "/src", "spoor", ["/src/a.py", "/src/b.py"], 1 << 10)
        files = {"meta.dat": meta}
        for base, stream, per in (("calls", calls, CALLS), ("events", ios, IOS), ("values", values, VALUES)):
            files[f"{base}.dat"], files[f"{base}.idx"] = records.stream_of(stream, per)
        return pa.table({"path": [f"trace-{number:09d}.ct"], "content": pa.array([container.build(files)], pa.binary())})

    none = "cast(null as string) as text"
    calls = T.calls(spark, sf).selectExpr("'call' as what", "entry_step as at", "call_key as n", "function_id as a", "call_key - 1 as b", "exit_step as c", none)
    ios = T.io_events(spark, sf).selectExpr("'io' as what", "step_id as at", "io_index as n", "if(kind = 'error', 11L, 0L) as a", "0L as b", "0L as c", "data as text")
    values = T.values(spark, sf).where("ordinal = 1 and step_id % 3 > 0").selectExpr("'value' as what", "step_id as at", "step_id as n", "4L as a", "cast(value as bigint) as b", "0L as c", none)
    rows = calls.unionByName(ios).unionByName(values).withColumn("chunk_id", F.expr(f"at div {T.CHUNK}"))
    return rows.groupBy("chunk_id").applyInArrow(lambda key, t: build(key, t.sort_by("n")), "path string, content binary")


_TRACE = f"printf('trace-%09d.ct', {{0}} // {T.CHUNK}) AS path"
_NUMBERED = f"CAST(row_number() OVER (PARTITION BY {{0}} // {T.CHUNK} ORDER BY {{1}}) - 1 AS BIGINT)"


@query(
    f"""SELECT {_TRACE.format('entry_step')}, {_NUMBERED.format('entry_step', 'call_key')} AS call_key, function_id, call_key - 1 AS parent_call_key, entry_step, exit_step,
    CAST(CASE WHEN call_key > 1 THEN (call_key - 1) % 3 ELSE 0 END AS INTEGER) AS depth, call_key || ',' || (call_key + 1) AS children, true AS returned_nothing FROM calls""",
    T.CALLS,
)
def call_records(spark, sf):
    """Calls of a compressed stream with an index (A)."""
    rows = records.calls(_records(spark, sf))
    return rows.select("path", "call_key", "function_id", "parent_call_key", "entry_step", "exit_step", "depth", F.array_join("children", ",").alias("children"), F.col("return_value").isNull().alias("returned_nothing"))


@query(
    f"""SELECT {_TRACE.format('entry_step')}, {_NUMBERED.format('entry_step', 'call_key')} AS call_key, 0 AS ordinal, function_id % 5 AS varname_id,
    CAST(json_object('kind', 'Int', 'i', entry_step) AS VARCHAR) AS value FROM calls""",
    T.CALLS,
)
def call_arguments(spark, sf):
    """Arguments of calls, their values shown as JSON."""
    rows = records.arguments(records.calls(_records(spark, sf)))
    return rows.withColumn("value", cbor.to_json(F.col("value")))


@query(f"SELECT {_TRACE.format('step_id')}, {_NUMBERED.format('step_id', 'io_index')} AS io_index, kind, step_id, data FROM ios", T.IO)
def io_records(spark, sf):
    """I/O events of a compressed stream with an index (A)."""
    return records.io_events(_records(spark, sf)).select("path", "io_index", "kind", "step_id", F.col("data").cast("string").alias("data"))


@query(f"SELECT {_TRACE.format('step_id')}, step_id % {T.CHUNK} AS step_id, 0 AS ordinal, 4 AS varname_id, CAST(value AS BIGINT) AS i, 7 AS type_id FROM vals WHERE ordinal = 1 AND step_id % 3 > 0", T.VALUES)
def value_records(spark, sf):
    """Values of steps from a compressed stream, some steps having none (A)."""
    rows = records.step_values(_records(spark, sf)).withColumn("v", F.parse_json(cbor.to_json(F.col("value"))))
    return rows.select("path", "step_id", "ordinal", F.col("varname_id").cast("int").alias("varname_id"), F.variant_get("v", "$.i", "bigint").alias("i"), F.variant_get("v", "$.type_id", "int").alias("type_id"))


@query(f"SELECT {_TRACE.format('c * ' + str(T.CHUNK))}, '018f3e2a-1c00-7abc-8def-' || printf('%012d', c) AS recording_id, 'demo' AS program, '-x ' || c AS args, '/src/a.py,/src/b.py' AS paths, 1024 AS flags, 'value_stream' AS features FROM (SELECT DISTINCT event_id // {T.CHUNK} AS c FROM events)")
def trace_metadata(spark, sf):
    """Metadata of each container (A)."""
    rows = metadata.read(_records(spark, sf))
    return rows.select("path", "recording_id", "program", F.array_join("args", " ").alias("args"), F.array_join("paths", ",").alias("paths"), "flags", F.array_join("features", ",").alias("features"))


_VALUE = """CASE event_type WHEN 'click' THEN json_object('kind', 'Int', 'i', event_id - 500, 'type_id', 1)
  WHEN 'view' THEN json_object('kind', 'Float', 'f', value, 'type_id', 2)
  WHEN 'purchase' THEN json_object('kind', 'Sequence', 'elements', json_array(json_object('kind', 'String', 'text', props, 'type_id', 3), json_object('kind', 'None', 'type_id', 4)), 'is_slice', event_id % 2 = 0, 'type_id', 5)
  WHEN 'signup' THEN json_object('kind', 'Cell', 'place', event_id * 100000)
  ELSE json_object('kind', 'Reference', 'dereferenced', NULL, 'address', user_id, 'mutable', true, 'type_id', 6) END"""


@query(f"SELECT event_id, CAST({_VALUE} AS VARCHAR) AS json FROM events")
def cbor_values(spark, sf):
    """Values of many kinds written as CBOR and shown as JSON again (J)."""
    inner = F.array(F.to_json(F.struct(F.lit("String").alias("kind"), F.col("props").alias("text"), F.lit(3).alias("type_id"))), F.lit('{"kind":"None","type_id":4}'))
    shapes = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("Int").alias("kind"), F.expr("event_id - 500").alias("i"), F.lit(1).alias("type_id"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("Float").alias("kind"), F.col("value").alias("f"), F.lit(2).alias("type_id"))))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"kind":"Sequence","elements":['), F.array_join(inner, ","), F.lit('],"is_slice":'), F.expr("event_id % 2 = 0").cast("string"), F.lit(',"type_id":5}')))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("Cell").alias("kind"), F.expr("event_id * 100000").alias("place"))))
        .otherwise(F.concat(F.lit('{"kind":"Reference","dereferenced":null,"address":'), F.col("user_id").cast("string"), F.lit(',"mutable":true,"type_id":6}')))
    )
    written = T.table(spark, sf, "events").select("event_id", cbor.from_json(shapes).alias("data"))
    return written.select("event_id", cbor.to_json(F.col("data")).alias("json"))


def _bundles(spark, sf):
    """path, content: a native bundle of each 4,096 events, one stream for every thread and purchases and errors in the OS log; names of functions beside them."""

    def build(key, rows):
        threads: dict[int, bytes] = {}
        log = []
        for r in rows.to_pylist():
            tid, text = r["user_id"] % 8, r["props"].encode()
            threads[tid] = threads.get(tid, b"") + struct.pack("<HIIQQ", r["event_id"] % 100, len(text), tid, r["event_id"], r["event_id"] * 3) + text
            if r["event_type"] in ("purchase", "error"):
                log.append((r["event_id"], r["event_id"] * 3, tid, r["event_id"] % 17, r["event_id"] % 5 - 1, -r["event_id"], r["event_type"].encode(), text))
        dat, idx = native.log_of([log[i : i + 100] for i in range(0, len(log), 100)])
        texts = [r.encode() for r in rows.column("event_type").to_pylist()]
        offsets = b"".join(struct.pack("<Q", sum(map(len, texts[:i]))) for i in range(len(texts[:50])))
        files = {f"t{tid}": data for tid, data in threads.items()} | {"event_log.dat": dat, "event_log.idx": idx, "meta.json": b'{"recordingMode":"full"}', "f.dat": b"".join(texts[:50]), "f.off": offsets}
        return pa.table({"path": [f"native-{key[0].as_py():09d}.ct"], "content": pa.array([container.build(files)], pa.binary())})

    rows = T.table(spark, sf, "events").selectExpr(f"event_id div {T.CHUNK} as chunk_id", "event_id", "user_id", "event_type", "props")
    return rows.groupBy("chunk_id").applyInArrow(lambda key, t: build(key, t.sort_by("event_id")), "path string, content binary")


_BUNDLE = f"printf('native-%09d.ct', event_id // {T.CHUNK}) AS path"


@query(f"SELECT {_BUNDLE}, user_id % 8 AS thread_id, CAST(event_id % 100 AS INTEGER) AS event_type, event_id AS geid, event_id * 3 AS tick, props AS payload FROM events")
def bundle_threads(spark, sf):
    """Events of every thread's stream of native bundles (A)."""
    rows = native.thread_events(_bundles(spark, sf))
    return rows.select("path", "thread_id", "event_type", "geid", "tick", F.col("payload").cast("string").alias("payload"))


_OS_NAMES = ", ".join(f"'elk{x}'" for x in S.OS_EVENTS)


@query(
    f"""SELECT path, CAST(k // 100 AS BIGINT) AS chunk, CAST(k % 100 AS BIGINT) AS entry, event_id AS geid, user_id % 8 AS tid, coalesce([{_OS_NAMES}][CAST(event_id % 17 AS INTEGER) + 1], 'elk_unknown_' || event_id % 17) AS kind,
    CAST(event_id % 5 - 1 AS INTEGER) AS fd, -event_id AS return_value, event_type AS metadata, props AS content
    FROM (SELECT *, {_BUNDLE}, row_number() OVER (PARTITION BY event_id // {T.CHUNK} ORDER BY event_id) - 1 AS k FROM events WHERE event_type IN ('purchase', 'error'))"""
)
def bundle_os_events(spark, sf):
    """The log of OS events of native bundles (A)."""
    rows = native.os_events(_bundles(spark, sf)).withColumn("kind", S.os_event_name(F.col("kind")))
    return rows.select("path", "chunk", "entry", "geid", "tid", "kind", "fd", "return_value", F.col("metadata").cast("string").alias("metadata"), F.col("content").cast("string").alias("content"))


@query(f"SELECT DISTINCT printf('native-%09d.ct', event_id // {T.CHUNK}) AS path, 'native' AS kind FROM events UNION ALL SELECT DISTINCT printf('chunk-%09d.ct', event_id // {T.CHUNK}), 'streams' FROM events UNION ALL SELECT 'text', 'none'")
def container_kinds(spark, sf):
    """What each file is: a native bundle, a container of streams, or none (A)."""
    text = spark.createDataFrame([("text", b"plain text, longer than any header")], "path string, content binary")
    return native.kinds(_bundles(spark, sf).unionByName(_streams(spark, sf)).unionByName(text))


@query(f"SELECT printf('native-%09d.ct', event_id // {T.CHUNK}) AS path, event_id % {T.CHUNK} AS index, event_type AS record FROM events WHERE event_id % {T.CHUNK} < 50")
def container_names(spark, sf):
    """Records of different lengths, cut by their offsets (A)."""
    return container.variable_records(_bundles(spark, sf), "f").select("path", "index", F.col("record").cast("string").alias("record"))
