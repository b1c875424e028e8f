"""Registered queries over scalar codecs, containers, manifests, values and reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters, ranges, stats
from ..operators import positions as P
from ..sources import container, manifests, values
from . import projections as T
from .queries import MOVING
from .registry import query


def _events(spark, sf):
    return T.table(spark, sf, "events")


_SEVEN = " || ".join(f"CASE WHEN u >= {128**i if i else 0} THEN printf('%02X', ((u >> {7 * i}) & 127) + CASE WHEN u >= {128 ** (i + 1)} THEN 128 ELSE 0 END) ELSE '' END" for i in range(5))


@query(f"SELECT event_id, {_SEVEN} AS bytes, u AS back FROM (SELECT event_id, event_id * 1009 AS u FROM events)")
def varint_bytes(spark, sf):
    """LEB128 bytes of numbers, and the numbers of the bytes (J)."""
    u = F.expr("event_id * 1009")
    return _events(spark, sf).select("event_id", S.varint(u).alias("bytes"), S.unvarint(S.varint(u)).alias("back"))


_ALPHABET = S.BASE40[1:]
_CODE = " + ".join(f"CASE WHEN length(name) > {i} THEN CAST(strpos('{_ALPHABET}', substr(name, {i + 1}, 1)) AS HUGEINT) * {40**i} ELSE 0 END" for i in range(12))


@query(f"SELECT doc_id, CAST({_CODE} AS VARCHAR) AS code, name AS back FROM (SELECT doc_id, 'f' || doc_id || '.dat' AS name FROM documents)")
def base40_names(spark, sf):
    """File names as base-40 numbers, and back (J)."""
    code = S.base40(F.expr("concat('f', doc_id, '.dat')"))
    return T.table(spark, sf, "documents").select("doc_id", code.cast("string").alias("code"), S.unbase40(code).alias("back"))


_UUID = "printf('%08x', event_id) || '-' || printf('%04x', user_id % 65536) || '-' || CASE WHEN event_id % 5 = 0 THEN '4' ELSE '7' END || printf('%03x', event_id % 4096) || '-8' || printf('%03x', user_id % 4096) || '-' || printf('%012x', event_id)"


@query(f"SELECT event_id, u AS text, event_id % 5 <> 0 AS valid, event_id * 65536 + user_id % 65536 AS ms FROM (SELECT *, {_UUID} AS u FROM events)")
def recording_ids(spark, sf):
    """UUIDv7 texts: whether they are valid, their milliseconds, and the text of their bytes (J, D)."""
    text = F.format_string("%08x-%04x-%s%03x-8%03x-%012x", "event_id", F.expr("user_id % 65536"), F.expr("if(event_id % 5 = 0, '4', '7')"), F.expr("event_id % 4096"), F.expr("user_id % 4096"), "event_id")
    return _events(spark, sf).withColumn("u", text).select("event_id", S.uuid_text(S.uuid_bytes(F.col("u"))).alias("text"), filters.is_uuid7(F.col("u")).alias("valid"), S.uuid7_ms(F.col("u")).alias("ms"))


@query("SELECT event_id, CAST(json_object('len', strlen(props), 'b64', base64(encode(props)), 'text', props) AS VARCHAR) AS json FROM events")
def payloads(spark, sf):
    """JSON of payloads with their text where it is printable (J)."""
    return _events(spark, sf).select("event_id", S.payload_json(F.col("props"), filters.is_printable(F.col("props"))).alias("json"))


_OS = ", ".join(f"'elk{x}'" for x in S.OS_EVENTS)


@query(
    f"""SELECT event_id, k AS io_kind, CASE k WHEN 'stdout' THEN 0 WHEN 'stderr' THEN 12 WHEN 'file' THEN 4 ELSE 11 END AS ordinal,
    coalesce([{_OS}][CAST(event_id % 17 AS INTEGER) + 1], 'elk_unknown_' || event_id % 17) AS os_event FROM (SELECT event_id,
    CASE WHEN event_id % 16 BETWEEN 3 AND 10 THEN 'file' WHEN event_id % 16 = 11 THEN 'error' WHEN event_id % 16 IN (12, 13) THEN 'stderr' ELSE 'stdout' END AS k FROM events)"""
)
def event_names(spark, sf):
    """Kinds of I/O events by ordinal and back, and names of OS events (J)."""
    kind = S.io_kind(F.expr("event_id % 16"))
    return _events(spark, sf).select("event_id", kind.alias("io_kind"), S.io_ordinal(kind).alias("ordinal"), S.os_event_name(F.expr("event_id % 17")).alias("os_event"))


@query("SELECT *, block * 32768 + cls * 4096 + slot * (1 << (cls + 5)) + used AS raw FROM (SELECT o_orderkey, o_orderkey AS block, CAST(o_custkey % 7 AS INTEGER) AS cls, o_orderkey % (128 >> CAST(o_custkey % 7 AS INTEGER)) AS slot, o_custkey % (1 << CAST(o_custkey % 7 + 5 AS INTEGER)) AS used FROM orders)")
def slot_descriptors(spark, sf):
    """Slots of pools packed into one number, and taken apart again (J)."""
    rows = T.table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_custkey % 7 as int) as c", "o_custkey").selectExpr("*", "o_orderkey % shiftright(128, c) as s", "o_custkey % shiftleft(1, c + 5) as u")
    rows = rows.select("o_orderkey", S.pack_slot(F.col("o_orderkey"), F.col("c"), F.col("s"), F.col("u")).alias("raw"))
    parts = S.unpack_slot(F.col("raw"))
    return rows.select("o_orderkey", "raw", *[p.alias(n) for p, n in zip(parts, ("block", "cls", "slot", "used"), strict=True)])


@query("""SELECT doc_id, CASE WHEN doc_id * 3001 < 1000000 THEN lpad(CAST(doc_id * 3001 AS VARCHAR), 6, '0') ELSE CAST(doc_id * 3001 AS VARCHAR) END || '.ct' AS split,
    name, doc_id % 6 > 0 AS permanent, doc_id % 6 = 0 AS evictable FROM (SELECT doc_id, ['f.dat', 'f.off', 'f.idx', 'meta.dat', 'f.tc', 'f.ns'][CAST(doc_id % 6 AS INTEGER) + 1] AS name FROM documents)""")  # fmt: skip
def file_names(spark, sf):
    """Names of the parts of a split trace, and which files a cache keeps for good (J, D)."""
    names = F.array(*[F.lit(x) for x in ("f.dat", "f.off", "f.idx", "meta.dat", "f.tc", "f.ns")])
    rows = T.table(spark, sf, "documents").withColumn("name", F.get(names, F.expr("cast(doc_id % 6 as int)")))
    return rows.select("doc_id", S.split_name(F.expr("doc_id * 3001")).alias("split"), "name", filters.is_permanent(F.col("name")).alias("permanent"), filters.is_evictable(F.col("name")).alias("evictable"))


@query("SELECT event_id, event_type AS upload, printf('%x', event_id * 37) AS hexed, event_id * 37 // 4096 AS frame, event_id * 37 % 4096 AS within FROM events")
def states_and_frames(spark, sf):
    """Known states as they are, numbers in hex, and the frame of a byte offset (J, H)."""
    frame, within = ranges.frame_at(F.expr("event_id * 37"), 4096)
    known = ("click", "view", "purchase", "signup", "error")
    digits = F.regexp_replace(S.to_hex(F.expr("event_id * 37")), "^0+(?=.)", "")
    return _events(spark, sf).select("event_id", S.state(F.col("event_type"), known).alias("upload"), digits.alias("hexed"), frame.alias("frame"), within.alias("within"))


@query("SELECT o_orderkey AS key, o_custkey AS payload FROM orders WHERE o_orderkey BETWEEN 1000 AND 30000")
def key_scan(spark, sf):
    """Rows of a range of keys in order (H)."""
    return ranges.scan(T.table(spark, sf, "orders").selectExpr("o_orderkey as key", "o_custkey as payload"), "key", 1000, 30000)


@query("SELECT o_orderkey AS page, o_orderkey % 1000 AS freed_commit, o_orderkey % 1000 <= 400 AS reclaimed FROM orders")
def reclaimed_pages(spark, sf):
    """Freed pages that no reader can see any more, and those that wait (I-5)."""
    done, wait = stats.reclaimable(T.table(spark, sf, "orders").selectExpr("o_orderkey as page", "o_orderkey % 1000 as freed_commit"), 400)
    return done.withColumn("reclaimed", F.lit(True)).unionByName(wait.withColumn("reclaimed", F.lit(False)))


@query("SELECT CAST(json_object('program', 'demo', 'steps_raw', count(*), 'steps_logical', count(*), 'values', count(*), 'calls', (SELECT count(*) FROM calls), 'io_events', (SELECT count(*) FROM ios)) AS VARCHAR) AS json FROM steps", T.STEPS, T.CALLS, T.IO)
def trace_meta(spark, sf):
    """The counts of a trace as one line of JSON (F-13)."""
    return stats.meta_json(stats.summary(T.steps(spark, sf), T.calls(spark, sf), T.io_events(spark, sf)), "demo")


_SPACE = "SELECT doc_id AS name, strlen(text) AS bytes, CAST(ceil(strlen(text) / 4096.0) AS BIGINT) AS blocks FROM documents WHERE text IS NOT NULL"


@query(f"SELECT CAST(json_object('name', name, 'bytes', bytes, 'blocks', blocks, 'allocated', blocks * 4096, 'utilization', CASE WHEN blocks > 0 THEN floor(bytes / (blocks * 4096) * 100) / 100 ELSE 0.0 END) AS VARCHAR) AS json FROM ({_SPACE})")
def space_report(spark, sf):
    """The space of each file as JSON, utilization cut to hundredths (F-19)."""
    files = T.table(spark, sf, "documents").where("text is not null").selectExpr("doc_id as name", "cast(octet_length(text) as bigint) as bytes")
    return stats.report(stats.file_space(files).withColumn("utilization", F.floor(F.col("utilization") * 100) / 100))[0]


@query(f"SELECT name || ' ' || bytes || ' bytes ' || blocks || ' blocks ' || printf('%.1f', CASE WHEN blocks > 0 THEN floor(bytes / (blocks * 4096) * 100) ELSE 0.0 END) || '%' AS line FROM ({_SPACE})")
def space_text(spark, sf):
    """The space of each file as a line of text, utilization cut to whole percents (F-20)."""
    files = T.table(spark, sf, "documents").where("text is not null").selectExpr("doc_id as name", "cast(octet_length(text) as bigint) as bytes")
    return stats.report(stats.file_space(files).withColumn("utilization", F.floor(F.col("utilization") * 100) / 100))[1]


@query("SELECT event_id, CAST(json_object('k', CAST(json_extract(props, '$.k') AS BIGINT)) AS VARCHAR) AS json, CAST(0 AS BIGINT) AS type_id, CAST(NULL AS VARCHAR) AS kind FROM events")
def value_json(spark, sf):
    """Dynamic values as JSON, with their top-level type and kind (J)."""
    rows = values.parse(_events(spark, sf).select("event_id", F.col("props").alias("value")))
    return rows.select("event_id", values.to_json(F.col("value")).alias("json"), values.type_id(F.col("value")).alias("type_id"), values.kind(F.col("value")).alias("kind"))


_SPANS = """spans AS (SELECT CAST(o_orderkey % 50 AS INTEGER) AS segment, o_orderkey * 8 AS first, o_orderkey * 8 + 11 AS last, CAST(o_orderkey % 3 AS INTEGER) AS replica_no,
  's3://bucket/' || o_orderkey AS uri FROM orders)"""


@query("SELECT CAST(event_id % 50 AS INTEGER) AS segment, event_id AS block_id, string_agg(uri, ',' ORDER BY replica_no, uri) AS uris FROM events JOIN spans ON segment = event_id % 50 AND event_id BETWEEN first AND last GROUP BY 1, 2", _SPANS)
def manifest_locate(spark, sf):
    """Replicas of wanted blocks, from manifests in JSON (E-4)."""
    spans = T.table(spark, sf, "orders").selectExpr(
        "'t' as trace_id",
        "array(named_struct('index', cast(o_orderkey % 50 as int), 'shards', array(named_struct('index', 0, 'block_start', o_orderkey * 8, 'block_end', o_orderkey * 8 + 11, "
        "'replicas', array(named_struct('replica_no', cast(o_orderkey % 3 as int), 'uri', concat('s3://bucket/', o_orderkey))))))) as segments",
    )
    manifest = manifests.parse(spans.select(F.to_json(F.struct("trace_id", "segments")).alias("value")))
    wanted = _events(spark, sf).selectExpr("cast(event_id % 50 as int) as segment", "event_id as block_id")
    found = manifests.locate(manifest, wanted)
    return found.select("segment", "block_id", F.array_join(F.transform("replicas", lambda r: r["uri"]), ",").alias("uris"))


def _containers(spark, sf):
    """path, content: a container of the steps of each chunk, with a file of its thread numbers beside them."""
    def build(key, rows):
        steps = [(r["kind"], r["v"], b"") for r in rows.select(["kind", "v"]).to_pylist()]
        threads = b"".join(r.to_bytes(8, "little") for r in rows.column("thread_id").to_pylist())
        files = {"steps.raw": container.encode_steps(steps), "threads.dat": threads}
        path = f"chunk-{key[0].as_py():09d}.ct"
        return pa.table({"path": [path], "content": pa.array([container.build(files)], pa.binary())})

    moved = T.steps(spark, sf).selectExpr("chunk_id", "step_id", f"if({MOVING}, kind, 'thread_switch') as kind", f"if({MOVING}, v, thread_id) as v", "thread_id")
    return moved.groupBy("chunk_id").applyInArrow(lambda key, t: build(key, t.sort_by("step_id")), "path string, content binary")


@query(f"SELECT printf('chunk-%09d.ct', chunk_id) AS path, step_id - chunk_id * {T.CHUNK} AS step_id, CASE WHEN {MOVING} THEN kind ELSE 'thread_switch' END AS kind, CASE WHEN {MOVING} THEN v ELSE thread_id END AS v FROM steps", T.STEPS)
def container_steps(spark, sf):
    """Steps written to containers, one a chunk, and read back from their block maps (A, G-6w)."""
    return container.steps(_containers(spark, sf)).select("path", "step_id", "kind", "v")


@query(f"SELECT printf('chunk-%09d.ct', chunk_id) AS path, 'threads.dat' AS name, count(*) * 8 AS size, CAST(4 AS INTEGER) AS version, true AS is_readable FROM steps GROUP BY chunk_id", T.STEPS)
def container_directory(spark, sf):
    """Headers and named files of containers (A)."""
    files = _containers(spark, sf)
    heads = container.headers(files).select("path", "version", "is_readable")
    return container.directory(files).where("name = 'threads.dat'").join(heads, "path").select("path", "name", "size", "version", "is_readable")


@query(f"SELECT printf('chunk-%09d.ct', chunk_id) AS path, step_id - chunk_id * {T.CHUNK} AS index, thread_id FROM steps", T.STEPS)
def container_records(spark, sf):
    """Records of one size from a named file of each container (A)."""
    rows = container.fixed_records(_containers(spark, sf), "threads.dat", 8)
    return rows.select("path", "index", container.number(F.col("record"), 0, 8).cast("long").alias("thread_id"))


@query(f"SELECT path_id, line, count(*) AS n FROM (SELECT step_id, CAST((position - position % {T.STRIDE}) / {T.STRIDE} AS BIGINT) AS path_id, position % {T.STRIDE} AS line FROM positions WHERE {MOVING}) GROUP BY 1, 2", T.STEPS, T.POSITIONS)
def trace_from_containers(spark, sf):
    """Hits of each line from steps read back from containers: the whole way from files to an index."""
    read = container.steps(_containers(spark, sf)).selectExpr(f"cast(substring(path, 7, 9) as bigint) * {T.CHUNK} + step_id as step_id", "cast(substring(path, 7, 9) as bigint) as chunk_id", "kind", "v")
    path, line = P.resolve(F.col("position"))
    found = P.positions(read).where(MOVING).select(path.alias("path_id"), line.alias("line"))
    return found.groupBy("path_id", "line").agg(F.count("*").alias("n"))
