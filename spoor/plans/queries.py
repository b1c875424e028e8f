"""The registered trace queries, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calls as C
from ..operators import carry, documents, filters, indexes, ranges, stats
from ..operators import positions as P
from ..operators.numbering import interned
from . import projections as T
from .registry import query

MOVING = "kind IN ('absolute', 'delta')"
LOCATED = f"""located AS (SELECT step_id, CAST((position - position % {T.STRIDE}) / {T.STRIDE} AS BIGINT) AS path_id,
  position % {T.STRIDE} AS line, position, kind FROM positions)"""


def located(spark, sf):
    """Moving steps with their path and line."""
    path, line = P.resolve(F.col("position"))
    return P.positions(T.steps(spark, sf)).where("kind in ('absolute', 'delta')").select("step_id", "position", path.alias("path_id"), line.alias("line"))


@query(
    f"""SELECT path_id, line, count(*) AS hits, min(step_id) AS first_step, max(step_id) AS last_step, count(call_key) AS hits_in_calls,
    max(call_key) AS last_call_key FROM (SELECT l.step_id, l.path_id, l.line, max(c.call_key) AS call_key FROM located l
    LEFT JOIN calls c ON c.entry_step <= l.step_id AND c.exit_step >= l.step_id WHERE {MOVING} GROUP BY ALL) GROUP BY ALL""",
    T.STEPS, T.CALLS, T.POSITIONS, LOCATED,
)
def line_profile(spark, sf):
    """Per source line: its hits, first and last step, hits inside calls and the last call (R1, E-2, R2, F-4)."""
    met = C.enclosing(located(spark, sf), T.calls(spark, sf), keep=("path_id", "line"))
    return met.groupBy("path_id", "line").agg(
        F.count("*").alias("hits"), F.min("step_id").alias("first_step"), F.max("step_id").alias("last_step"),
        F.count("call_key").alias("hits_in_calls"), F.max("call_key").alias("last_call_key"),
    )


@query(
    f"""SELECT path_id, line, arg_min(p_name, (-n, function_id)) AS top_function FROM (
    SELECT path_id, line, function_id, count(*) AS n, any_value(p_name) AS p_name FROM (
      SELECT l.step_id, l.path_id, l.line, max(c.call_key) AS k FROM located l JOIN calls c ON c.entry_step <= l.step_id AND c.exit_step >= l.step_id
      WHERE {MOVING} GROUP BY ALL) m JOIN calls ON k = call_key JOIN part ON p_partkey = function_id GROUP BY ALL) GROUP BY ALL""",
    T.STEPS, T.CALLS, T.POSITIONS, LOCATED,
)
def line_top_function(spark, sf):
    """Per source line the function that most often encloses it; names from part."""
    calls = T.calls(spark, sf)
    inside = C.enclosing(located(spark, sf), calls, keep=("path_id", "line")).where("call_key is not null")
    met = inside.join(calls.select("call_key", "function_id"), "call_key")
    counts = met.groupBy("path_id", "line", "function_id").agg(F.count("*").alias("n"))
    top = counts.groupBy("path_id", "line").agg(F.max_by("function_id", F.struct("n", -F.col("function_id"))).alias("function_id"))
    names = T.table(spark, sf, "part").select(F.col("p_partkey").alias("function_id"), F.col("p_name").alias("top_function"))
    return top.join(names, "function_id").select("path_id", "line", "top_function")


@query("SELECT * FROM positions", T.STEPS, T.POSITIONS)
def step_positions(spark, sf):
    """The absolute position of every step (G-1)."""
    return P.positions(T.steps(spark, sf))


@query(
    """SELECT step_id, kind, CAST(sum(v) OVER (PARTITION BY chunk_id, seg ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS position
    FROM (SELECT *, sum(CASE WHEN kind = 'absolute' THEN 1 ELSE 0 END) OVER (PARTITION BY chunk_id ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM steps)""",
    T.STEPS,
)
def step_position_points(spark, sf):
    """Positions as point reads see them, restarting in each chunk (G-2)."""
    return P.position_point(T.steps(spark, sf))


@query(f"SELECT step_id, path_id, line FROM located WHERE {MOVING} AND step_id BETWEEN 500 AND 599", T.STEPS, T.POSITIONS, LOCATED)
def step_location_range(spark, sf):
    """Locations of a range of steps."""
    return ranges.page(located(spark, sf), "step_id", 500, 100).select("step_id", "path_id", "line")


@query("SELECT s.step_id, max(call_key) AS call_key FROM steps s LEFT JOIN calls c ON entry_step <= step_id AND exit_step >= step_id GROUP BY ALL", T.STEPS, T.CALLS)
def call_for_step(spark, sf):
    """The innermost call of every step, null outside (E-1)."""
    return C.enclosing(T.steps(spark, sf), T.calls(spark, sf))


@query("SELECT * FROM calls WHERE call_key BETWEEN 100 AND 129", T.CALLS)
def call_page(spark, sf):
    """A page of 30 calls (H)."""
    return ranges.page(T.calls(spark, sf), "call_key", 100, 30)


@query("SELECT * FROM calls", T.CALLS)
def all_calls(spark, sf):
    """Every call (C)."""
    return T.calls(spark, sf)


FRAMES = """frames AS (SELECT c.call_key, c.function_id, c.entry_step * 8 + c.depth AS enter_seq, c.exit_step * 8 + 7 - c.depth AS exit_seq,
  CAST(count(p.call_key) AS INTEGER) AS depth, coalesce(max(p.call_key), -1) AS parent_call_key
  FROM calls c LEFT JOIN calls p ON p.depth < c.depth AND p.entry_step <= c.entry_step AND p.exit_step >= c.exit_step GROUP BY ALL)"""


@query("SELECT * FROM frames", T.CALLS, FRAMES)
def call_tree(spark, sf):
    """Keys, depths and parents rebuilt from the enter and return signals of every call (R5)."""
    return C.call_tree(C.signals(T.calls(spark, sf)))


@query("SELECT parent_call_key, call_key // 4096 AS chunk_no, string_agg(CAST(call_key AS VARCHAR), ',' ORDER BY call_key) AS children FROM frames WHERE parent_call_key >= 0 GROUP BY 1, 2", T.CALLS, FRAMES)
def call_children(spark, sf):
    """The calls inside each call, in order and in chunks of keys."""
    tree = C.children(C.call_tree(C.signals(T.calls(spark, sf))), 4096)
    return tree.withColumn("children", F.array_join("children", ","))


HITS = "SELECT position AS gli, step_id // 65536 AS chunk_no, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) AS step_ids, count(*) AS n FROM positions WHERE kind IN ('absolute', 'delta') GROUP BY 1, 2"


@query(HITS, T.STEPS, T.POSITIONS)
def line_hits(spark, sf):
    """The step ids of each line, in chunks of the trace (F-1)."""
    return indexes.line_hits(P.positions(T.steps(spark, sf))).withColumn("step_ids", F.array_join("step_ids", ","))


@query("SELECT g AS gli, count(step_id) AS n FROM (SELECT DISTINCT position + 1 AS g FROM positions) LEFT JOIN positions ON position = g AND kind IN ('absolute', 'delta') GROUP BY 1", T.STEPS, T.POSITIONS)
def line_hit_counts(spark, sf):
    """Hits of asked lines, here those after every line there is, 0 where none (F-2)."""
    positions = P.positions(T.steps(spark, sf))
    wanted = positions.select((F.col("position") + 1).alias("gli")).distinct()
    return indexes.hit_counts(indexes.line_hits(positions), wanted)


@query(f"SELECT * FROM ({HITS}) WHERE gli % 2 = 1", T.STEPS, T.POSITIONS)
def line_lookup(spark, sf):
    """The step ids of asked lines, here the odd ones that were reached; others would raise an error (E-9)."""
    hits = indexes.line_hits(P.positions(T.steps(spark, sf)))
    wanted = hits.where("gli % 2 = 1").select("gli").distinct()
    return indexes.lookup_hits(hits, wanted).withColumn("step_ids", F.array_join("step_ids", ","))


@query("SELECT count(DISTINCT position) AS lines FROM positions WHERE kind IN ('absolute', 'delta')", T.STEPS, T.POSITIONS)
def line_count(spark, sf):
    """Distinct lines hit (F-3)."""
    return P.positions(T.steps(spark, sf)).where("kind in ('absolute', 'delta')").agg(F.countDistinct("position").alias("lines"))


@query(f"SELECT path_id, line, step_id // 65536 AS chunk_no, count(*) AS step_count, min(step_id) AS first_step_id, max(step_id) AS last_step_id, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) AS steps FROM located WHERE {MOVING} GROUP BY ALL", T.STEPS, T.POSITIONS, LOCATED)
def step_map(spark, sf):
    """The breakpoint index: steps of each path and line, in chunks of the trace (F-4)."""
    return indexes.step_map(located(spark, sf)).withColumn("steps", F.array_join("step_ids", ",")).drop("step_ids")


@query(f"SELECT count(*) AS entries FROM (SELECT DISTINCT path_id, line FROM located WHERE {MOVING})", T.STEPS, T.POSITIONS, LOCATED)
def step_map_entries(spark, sf):
    """Distinct keys of the breakpoint index (F-5)."""
    return located(spark, sf).agg(F.countDistinct("path_id", "line").alias("entries"))


@query('SELECT count(*) AS steps_raw, count(*) FILTER (kind <> \'delta_column\') AS steps_logical, count(*) AS "values", (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM ios) AS io_events FROM steps', T.STEPS, T.CALLS, T.IO)
def trace_summary(spark, sf):
    """Counts of a trace in one row (F-6 to F-12)."""
    return stats.summary(T.steps(spark, sf), T.calls(spark, sf), T.io_events(spark, sf))


@query("SELECT CASE WHEN kind IN ('absolute', 'delta') THEN kind ELSE 'other' END AS kind, count(*) AS n FROM steps GROUP BY 1", T.STEPS)
def events_by_kind(spark, sf):
    """Events by kind with an `other` (F-11)."""
    return stats.events_by_kind(T.steps(spark, sf), ("absolute", "delta"))


@query("SELECT * FROM vals WHERE step_id = 442", T.VALUES)
def step_values(spark, sf):
    """The values of one step by ordinal (C)."""
    return T.values(spark, sf).where("step_id = 442").orderBy("ordinal")


@query("SELECT varname, CAST(row_number() OVER (ORDER BY f, varname) - 1 AS BIGINT) AS id FROM (SELECT varname, min(step_id * 2 + ordinal) AS f FROM vals GROUP BY 1)", T.VALUES)
def varname_ids(spark, sf):
    """Variable names numbered by first appearance (J-1)."""
    return interned(T.values(spark, sf).withColumn("at", F.expr("step_id * 2 + ordinal")), "varname", "at")


@query("SELECT * FROM ios WHERE io_index BETWEEN 100 AND 149", T.IO)
def io_page(spark, sf):
    """A page of 50 I/O events (H)."""
    return ranges.page(T.io_events(spark, sf), "io_index", 100, 50)


LINE_TABLE = """bases AS (SELECT path_id, line, len, fb + sum(len) OVER (PARTITION BY path_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len AS base FROM (
  SELECT path_id, unnest(line_lengths) AS len, unnest(range(1, len(line_lengths) + 1)) AS line,
    sum(total) OVER (ORDER BY path_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total AS fb
  FROM (SELECT *, list_sum(line_lengths) AS total FROM paths)))"""
DECODED = """decoded AS (SELECT e.event_id AS step_id, e.event_id * 37 AS position, b.path_id, CAST(b.line AS INTEGER) AS line, CAST(e.event_id * 37 - base + 1 AS INTEGER) AS "column"
  FROM events e JOIN bases b ON e.event_id * 37 >= base AND e.event_id * 37 < base + len)"""


@query("SELECT path_id, CAST(line AS INTEGER) AS line, CAST(len AS BIGINT) AS len, CAST(base AS BIGINT) AS base FROM bases", T.PATHS, LINE_TABLE)
def line_bases(spark, sf):
    """Where each line begins in the position space (G-3, G-3b)."""
    return P.line_bases(T.line_lengths(spark, sf))


@query("SELECT * FROM decoded", T.PATHS, LINE_TABLE, DECODED)
def decode_positions(spark, sf):
    """Positions in the space of bytes as path, line and column; those beyond every file have no row (E-3)."""
    points = T.table(spark, sf, "events").selectExpr("event_id as step_id", "event_id * 37 as position")
    return P.decode(points, T.line_lengths(spark, sf))


@query(
    f"""SELECT e.event_id AS step_id, e.event_id * 37 AS position, coalesce(d.path_id, e.event_id * 37 // {T.STRIDE}) AS path_id,
    coalesce(CAST(d.line AS BIGINT), e.event_id * 37 % {T.STRIDE}) AS line, coalesce(d."column", 1) AS "column" FROM events e LEFT JOIN decoded d ON d.step_id = e.event_id""",
    T.PATHS, LINE_TABLE, DECODED,
)
def step_locations(spark, sf):
    """Path, line and column of positions, by line tables or else by the stride (E-7)."""
    points = T.table(spark, sf, "events").selectExpr("event_id as step_id", "event_id * 37 as position")
    return P.locations(points, T.line_lengths(spark, sf))


@query("SELECT path_id, line_lengths[CAST(path_id % 7 AS INTEGER) + 1] AS own, CAST(len(line_lengths) AS INTEGER) AS lines FROM paths", T.PATHS)
def line_length_reads(spark, sf):
    """The length of one line of each file, null beyond its last, and the number of lines."""
    return T.line_lengths(spark, sf).select("path_id", S.line_length(F.col("line_lengths"), (F.col("path_id") % 7).cast("int")).cast("long").alias("own"), F.size("line_lengths").alias("lines"))


@query("SELECT path_id, view_idx // 65536 AS chunk_no, count(*) AS n, string_agg(CAST(view_idx AS VARCHAR), ',' ORDER BY view_idx) AS views FROM views GROUP BY 1, 2", T.VIEWS)
def views_of_paths(spark, sf):
    """Source views of each path, in chunks of their numbers (E-8)."""
    views = indexes.views_of_paths(T.source_views(spark, sf))
    return views.select("path_id", "chunk_no", F.size("view_idxs").cast("long").alias("n"), F.array_join("view_idxs", ",").alias("views"))


@query("SELECT view_idx, path_id, view_kind, view_name FROM views WHERE path_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')", T.VIEWS)
def views_without_path(spark, sf):
    """Source views whose path isn't registered, here all but English documents: the check of a writer."""
    paths = T.table(spark, sf, "documents").where("lang = 'en'").selectExpr("doc_id as path_id")
    return T.source_views(spark, sf).drop("content").join(paths, "path_id", "left_anti")


DOC = """doc AS (SELECT entry_step AS step_id, 0 AS phase, call_key AS ordinal, 'call_entry' AS kind, 'f' || function_id AS payload FROM calls
  UNION ALL SELECT step_id, 1, 0, 'step', kind FROM steps UNION ALL SELECT step_id, 2, io_index, 'io', kind FROM ios
  UNION ALL SELECT exit_step, 3, call_key, 'call_exit', 'f' || function_id FROM calls)"""


@query("SELECT CAST(step_id AS BIGINT) AS step_id, phase, CAST(ordinal AS BIGINT) AS ordinal, kind, payload FROM doc", T.STEPS, T.CALLS, T.IO, DOC)
def document(spark, sf):
    """All that happens at each step, woven into one order (E-5)."""
    steps = T.steps(spark, sf)
    return documents.document(steps, T.calls(spark, sf), T.io_events(spark, sf))


@query(
    """SELECT CAST(section AS INTEGER) AS section, CAST(step_id AS BIGINT) AS step_id, phase, CAST(ordinal AS BIGINT) AS ordinal, kind, payload FROM (
    SELECT 0 AS section, 0 AS step_id, 0 AS phase, path_id AS ordinal, 'path' AS kind, path AS payload FROM paths
    UNION ALL SELECT 1, 0, 0, p_partkey, 'function', p_name FROM part
    UNION ALL SELECT 2, entry_step, 0, depth * 1000000000 + call_key, 'call', 'f' || function_id FROM calls UNION ALL SELECT 2, step_id, 1, 0, 'step', kind FROM steps
    UNION ALL SELECT 2, step_id, 2, ordinal, 'value', varname FROM vals UNION ALL SELECT 2, exit_step, 3, -(depth * 1000000000 + call_key), 'return', 'f' || function_id FROM calls
    UNION ALL SELECT 3, step_id, 0, io_index, CASE kind WHEN 'error' THEN 'error' ELSE 'write' END, data FROM ios)""",
    T.STEPS, T.CALLS, T.IO, T.VALUES, T.PATHS,
)
def low_level_events(spark, sf):
    """The linear event list (I-1)."""
    names = T.table(spark, sf, "part").selectExpr("p_partkey as id", "p_name as name")
    return documents.low_level(T.line_lengths(spark, sf), names, T.steps(spark, sf), T.calls(spark, sf), T.values(spark, sf), T.io_events(spark, sf))


@query(
    """SELECT CAST(step_id AS BIGINT) AS step_id, phase, CAST(ordinal AS BIGINT) AS ordinal, CAST(json AS VARCHAR) AS json FROM (
    SELECT -1 AS step_id, 0 AS phase, p_partkey AS ordinal, json_object('event', 'declaration', 'id', p_partkey, 'name', p_name) AS json FROM part
    UNION ALL SELECT entry_step, 1, call_key, json_object('event', 'call', 'call_key', call_key, 'function_id', function_id) FROM calls
    UNION ALL SELECT step_id, 2, 0, json_object('event', 'step', 'step_id', step_id, 'kind', kind) FROM steps
    UNION ALL SELECT step_id, 3, ordinal, json_object('event', 'value', 'varname', varname, 'value', CAST(floor(value) AS BIGINT)) FROM vals
    UNION ALL SELECT step_id, 4, io_index, json_object('event', 'io', 'io_index', io_index, 'kind', kind) FROM ios)""",
    T.STEPS, T.CALLS, T.IO, T.VALUES,
)
def json_events(spark, sf):
    """The JSON event list, values as whole numbers (E-6)."""
    names = T.table(spark, sf, "part").selectExpr("p_partkey as id", "p_name as name")
    values = T.values(spark, sf).withColumn("value", F.floor("value").cast("long"))
    return documents.json_events(names, T.steps(spark, sf), T.calls(spark, sf), values, T.io_events(spark, sf))


_NAMES = " ".join(f"WHEN {n + i} THEN '{x}'" for n, xs in S.NATIVE_EVENTS.items() for i, x in enumerate(xs.split()))


@query(
    f"""SELECT section, geid, thread_id, stream_offset, source, event FROM (SELECT 0 AS section, geid, thread_id, stream_offset, 'thread' AS source,
    CASE event_type {_NAMES} ELSE 'ev_unknown_' || event_type END AS event FROM threads
    UNION ALL SELECT 1, step_id, 0, io_index, 'os', CASE kind WHEN 'error' THEN 'elkWrite' ELSE 'elkRead' END FROM ios)""",
    T.THREADS, T.IO,
)
def native_document(spark, sf):
    """Thread and OS events of a native bundle with their names (R4)."""
    threads = T.thread_events(spark, sf).withColumn("event", S.native_event_name(F.col("event_type")))
    os_events = T.io_events(spark, sf).select(F.col("step_id").alias("geid"), F.lit(0).cast("long").alias("thread_id"), F.col("io_index").alias("stored"), S.os_event_name(F.when(F.col("kind") == "error", 0).otherwise(2)).alias("event"))
    return documents.native(threads, os_events)


RULES = """
[meta]
version = 1
[scope]
default_exec = "skip"
[[scope.rules]]
selector = "file:glob:/src/src1*/**"
exec = "trace"
[[scope.rules]]
selector = "file:glob:**/de/*"
exec = "skip"
[[scope.rules]]
selector = "pkg:regex:/src/[a-z]+3/"
exec = "trace"
[[scope.rules]]
selector = "file:literal:/src/src1/en/f1.py"
exec = "skip"
"""


@query(
    """SELECT path_id, path, CASE WHEN path = '/src/src1/en/f1.py' THEN 'skip' WHEN regexp_matches(path, '^(?:/src/[a-z]+3/)') THEN 'trace'
    WHEN regexp_matches(path, '^(?:.*/)?de/[^/]*$') THEN 'skip' WHEN regexp_matches(path, '^/src/src1[^/]*/.*$') THEN 'trace' ELSE 'skip' END AS decision FROM paths""",
    T.PATHS,
)
def classify_paths(spark, sf):
    """Which paths are traced: the last matching rule decides (D, R9)."""
    rules = filters.compile_filters(RULES)
    return T.line_lengths(spark, sf).select("path_id", "path", rules.classify(F.col("path")).alias("decision"))


@query("SELECT path_id, '<workdir>/' || substr(path, 6) AS path FROM paths", T.PATHS)
def normalized_paths(spark, sf):
    """Paths below the working directory (C)."""
    return T.line_lengths(spark, sf).select("path_id", filters.normalize_path(F.col("path"), "/src").alias("path"))


@query("SELECT doc_id AS id, strlen(text) AS bytes, CAST(ceil(strlen(text) / 4096.0) AS BIGINT) AS blocks, CAST(ceil(strlen(text) / 4096.0) AS BIGINT) * 4096 AS allocated, CASE WHEN strlen(text) > 0 THEN strlen(text) / (ceil(strlen(text) / 4096.0) * 4096) ELSE 0 END AS utilization FROM documents WHERE text IS NOT NULL")
def file_space(spark, sf):
    """Blocks and utilization of each file (F-14)."""
    files = T.table(spark, sf, "documents").where("text is not null").selectExpr("doc_id as name", "cast(octet_length(text) as bigint) as bytes")
    return stats.file_space(files).withColumnRenamed("name", "id")


@query(
    """SELECT source, n, x[1] AS min, x[n // 2 + 1] AS median, x[least(n - 1, n * 95 // 100) + 1] AS p95, x[least(n - 1, n * 99 // 100) + 1] AS p99, x[n] AS max
    FROM (SELECT source, count(*) AS n, list(strlen(text) ORDER BY strlen(text)) AS x FROM documents WHERE text IS NOT NULL GROUP BY 1)"""
)
def size_percentiles(spark, sf):
    """Sizes at sorted indexes by source (F-15, R10)."""
    sizes = T.table(spark, sf, "documents").where("text is not null").selectExpr("source", "cast(octet_length(text) as bigint) as bytes")
    return stats.index_percentiles(sizes, "bytes", ["source"])


_CLASS = "CASE WHEN s <= 31 THEN 0 WHEN s <= 63 THEN 1 WHEN s <= 127 THEN 2 WHEN s <= 255 THEN 3 WHEN s <= 511 THEN 4 WHEN s <= 1023 THEN 5 ELSE 6 END"


@query(f"SELECT pool_class, CAST(32 * 2 ** pool_class AS INTEGER) AS pool_size, count(*) AS entries, CAST(sum(s) AS BIGINT) AS used_bytes, (count(*) * 32 * 2 ** pool_class - sum(s)) / (count(*) * 32 * 2 ** pool_class) AS fragmentation FROM (SELECT s, {_CLASS} AS pool_class FROM (SELECT o_orderkey % 2040 + 1 AS s FROM orders)) GROUP BY 1")
def pool_usage(spark, sf):
    """Pool classes of entry sizes and their fragmentation (F-16, F-17)."""
    return stats.pool_usage(T.table(spark, sf, "orders").selectExpr("o_orderkey % 2040 + 1 as size"))


@query("SELECT l_linenumber % 7 AS pool_class, count(*) FILTER (l_returnflag <> 'N') AS allocated, count(*) FILTER (l_returnflag = 'N') AS free FROM lineitem GROUP BY 1")
def pool_slots(spark, sf):
    """Allocated and free slots of each class (F-25, F-26)."""
    return stats.slots(T.table(spark, sf, "lineitem").selectExpr("l_linenumber % 7 as pool_class", "l_returnflag <> 'N' as used"))


@query("SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS hit_rate FROM lineitem")
def cache_hit_rate(spark, sf):
    """Hits by accesses (F-21)."""
    return stats.hit_rate(T.table(spark, sf, "lineitem").selectExpr("l_returnflag = 'R' as hit"))


@query("SELECT CAST(sum(o_orderkey % 100) AS BIGINT) AS compressed, CAST(sum(o_orderkey % 300) AS BIGINT) AS decompressed FROM orders")
def frame_totals(spark, sf):
    """Sizes of all frames (F-22, F-23)."""
    return stats.totals(T.table(spark, sf, "orders").selectExpr("o_orderkey % 100 as compressed_size", "o_orderkey % 300 as decompressed_size"))


@query("SELECT l_orderkey AS block_id, count(*) FILTER (l_returnflag <> 'N') AS replies, arg_min(l_partkey, l_linenumber * 1000000 + l_partkey) FILTER (l_returnflag <> 'N') AS data FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag <> 'N') >= 2")
def quorum_read(spark, sf):
    """Blocks that enough replicas answered, with the first answer (F-24)."""
    rows = T.table(spark, sf, "lineitem").selectExpr("l_orderkey as block_id", "l_linenumber * 1000000 + l_partkey as replica_no", "l_returnflag <> 'N' as ok", "l_partkey as data")
    return stats.quorum_read(rows, 2)


@query("SELECT entries, CAST(ceil(entries / 64.0) AS BIGINT) AS leaves, CAST(CASE WHEN entries = 0 THEN 0 ELSE 1 + ceil(log(greatest(ceil(entries / 64.0), 1)) / log(64) - 1e-9) END AS INTEGER) AS depth FROM (SELECT count(*) AS entries FROM orders)")
def tree_shape(spark, sf):
    """Leaves and depth of a tree of full nodes (F-18)."""
    return stats.tree_shape(T.table(spark, sf, "orders"), 64)


@query("SELECT block_id FROM (SELECT o_orderkey AS block_id, permanent, total - sum(CASE WHEN permanent THEN 0 ELSE bytes END) OVER (ORDER BY o_orderkey) + bytes AS left_before FROM (SELECT o_orderkey, o_orderkey % 5 = 0 AS permanent, o_orderkey % 97 + 1 AS bytes, sum(o_orderkey % 97 + 1) OVER () AS total FROM orders)) WHERE NOT permanent AND left_before > 20000")
def evicted_blocks(spark, sf):
    """Blocks a cache drops to meet its budget, by block id (H)."""
    return stats.evicted(T.table(spark, sf, "orders").selectExpr("o_orderkey as block_id", "o_orderkey % 5 = 0 as permanent", "o_orderkey % 97 + 1 as bytes"), 20000)


@query("SELECT user_id AS object_key, event_type AS upload, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type = 'error'")
def retry_pending(spark, sf):
    """Objects whose last upload failed (R8)."""
    rows = T.table(spark, sf, "events").selectExpr("user_id as object_key", "if(event_type = 'error', 'retryable_failure', event_type) as upload", "event_id as seq")
    return carry.retry_pending(rows).withColumn("upload", F.lit("error"))


@query("SELECT user_id AS idempotency_key, min(event_id) AS seq FROM events GROUP BY 1")
def finalized_uploads(spark, sf):
    """The first request of each idempotency key."""
    return carry.finalized(T.table(spark, sf, "events").selectExpr("user_id as idempotency_key", "event_id as seq"))


@query("SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN event_id END AS step_id, min(CASE WHEN event_type = 'click' THEN event_id END) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM events")
def carry_forward(spark, sf):
    """Values without a step go to the next one (R7, G-8)."""
    rows = T.table(spark, sf, "events").selectExpr("event_id as seq", "if(event_type = 'click', event_id, null) as step_id")
    return carry.carry_forward(rows, 1000)


@query("SELECT user_id AS address, count(*) AS n, min(event_id) AS first_tick, max(event_id) AS last_tick, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def memory_writes(spark, sf):
    """Writes of each address and the value after the last."""
    rows = T.table(spark, sf, "events").selectExpr("user_id as address", "event_id as tick", "0 as interval_id", "value as new_value")
    return indexes.memory_writes(rows)


@query("SELECT user_id AS key, max(event_id) AS commit_id, arg_max(value, event_id) AS payload FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def snapshot_read(spark, sf):
    """Keys as a pinned commit, the one in the middle, shows them (E-12, K-7)."""
    rows = T.table(spark, sf, "events").selectExpr("user_id as key", "event_id as commit_id", "if(event_type = 'error', null, value) as payload")
    return indexes.at_snapshot(rows, "key", rows.agg(F.max("commit_id")).first()[0] // 2)


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def key_lookup(spark, sf):
    """Payload rows of wanted keys, here of finished orders (E-10, E-11)."""
    wanted = T.table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey as key")
    return indexes.lookup(T.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "key"), wanted, "key").groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS key, CAST((CAST(o_orderkey AS HUGEINT) * 2654435761) % 18446744073709551616 % 7 AS INTEGER) AS shard FROM orders")
def home_shard(spark, sf):
    """The shard of each key (J, E-13)."""
    return T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), S.home_shard(F.col("o_orderkey"), 7).alias("shard"))


@query("SELECT event_id, CASE WHEN s >= 0 THEN s * 2 ELSE -s * 2 - 1 END AS zigzag, s AS back, CAST(CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 WHEN u < 2097152 THEN 3 ELSE 4 END AS INTEGER) AS size FROM (SELECT event_id, event_id * 7 - 20000 AS s, event_id * 1009 AS u FROM events)")
def number_codecs(spark, sf):
    """Zigzag and its inverse, and the length of varints (J)."""
    s = F.expr("event_id * 7 - 20000")
    return T.table(spark, sf, "events").select("event_id", S.zigzag(s).alias("zigzag"), S.unzigzag(S.zigzag(s)).alias("back"), S.varint_size(F.expr("event_id * 1009")).alias("size"))


@query("SELECT o_orderkey, o_orderkey // 4294967296 AS high, CAST((o_orderkey * 1000003) % 4294967296 AS BIGINT) AS low FROM orders")
def unpack_gli(spark, sf):
    """High and low half of a packed position (J)."""
    return T.table(spark, sf, "orders").select("o_orderkey", S.unpack_gli(F.col("o_orderkey"))[0].alias("high"), S.unpack_gli(F.expr("o_orderkey * 1000003"))[1].alias("low"))


@query("SELECT DISTINCT user_id AS block_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def present_blocks(spark, sf):
    """Wanted blocks that a cache holds (I-2, I-3)."""
    rows = T.table(spark, sf, "events")
    held = rows.where("event_type = 'error'").selectExpr("user_id as block_id").distinct()
    return rows.where("event_type = 'click'").selectExpr("user_id as block_id").distinct().join(held, "block_id", "left_semi")


@query("SELECT s.event_id AS block_id, o.o_orderkey AS segment FROM events s JOIN orders o ON s.event_id >= o.o_orderkey * 16 AND s.event_id <= o.o_orderkey * 16 + 15")
def resolve_blocks(spark, sf):
    """Segments that hold logical blocks (E-4)."""
    spans = T.table(spark, sf, "orders").selectExpr("o_orderkey as segment", "o_orderkey * 16 as block_start", "o_orderkey * 16 + 15 as block_end")
    blocks = T.table(spark, sf, "events").selectExpr("event_id as block_id")
    return ranges.range_join(blocks, spans, "block_id", "block_start", "block_end", 1024).select("block_id", "segment")


@query("SELECT event_id AS pos, max(o_orderkey * 3 + 10) AS base FROM events LEFT JOIN orders ON o_orderkey * 3 + 10 <= event_id WHERE event_id >= 10 GROUP BY 1")
def as_of_base(spark, sf):
    """The greatest base at or below each position (R3)."""
    bases = T.table(spark, sf, "orders").selectExpr("o_orderkey * 3 + 10 as base")
    return ranges.as_of(T.table(spark, sf, "events").selectExpr("event_id as pos"), bases, "pos", "base", 512).select("pos", "base")


@query("""SELECT step_id, CAST(step_id // 4096 AS BIGINT) AS chunk_id, CASE WHEN step_id % 4096 <> 0 AND d BETWEEN -64 AND 63 THEN 'delta' ELSE 'absolute' END AS kind,
  CASE WHEN step_id % 4096 <> 0 AND d BETWEEN -64 AND 63 THEN d ELSE position END AS v FROM (SELECT step_id, position, position - lag(position) OVER (ORDER BY step_id) AS d FROM positions)""", T.STEPS, T.POSITIONS)  # fmt: skip
def encode_steps(spark, sf):
    """Positions as deltas and absolute steps again (G-6w)."""
    return P.encode_steps(P.positions(T.steps(spark, sf)))


@query(f"SELECT step_id, path_id * {T.STRIDE} + line AS position FROM located WHERE {MOVING}", T.STEPS, T.POSITIONS, LOCATED)
def to_global(spark, sf):
    """Path and line as a position again (G-5)."""
    return located(spark, sf).select("step_id", P.to_global(F.col("path_id"), F.col("line")).alias("position"))
