"""Traces as relations, projected from the driver's tables by arithmetic that SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import dense
from ..operators.positions import CHUNK, STRIDE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step_id, chunk_id, kind, v (absolute position or delta), thread_id."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as step_id",
        f"event_id div {CHUNK} as chunk_id",
        "case when event_id = 0 or event_type = 'purchase' then 'absolute' when event_type in ('click', 'view') then 'delta' "
        "when event_type = 'signup' then 'thread_switch' else 'raise' end as kind",
        f"case when event_id = 0 or event_type = 'purchase' then (user_id % 5) * {STRIDE} + 1 + event_id % 97 "
        "when event_type in ('click', 'view') then event_id % 4 else 0L end as v",
        "user_id as thread_id",
    )


STEPS = f"""steps AS (SELECT event_id AS step_id, CAST((event_id - event_id % {CHUNK}) / {CHUNK} AS BIGINT) AS chunk_id,
  CASE WHEN event_id = 0 OR event_type = 'purchase' THEN 'absolute' WHEN event_type IN ('click', 'view') THEN 'delta'
       WHEN event_type = 'signup' THEN 'thread_switch' ELSE 'raise' END AS kind,
  CASE WHEN event_id = 0 OR event_type = 'purchase' THEN (user_id % 5) * {STRIDE} + 1 + event_id % 97
       WHEN event_type IN ('click', 'view') THEN event_id % 4 ELSE 0 END AS v,
  user_id AS thread_id FROM events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order and line number."""
    picks = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_shipdate")]
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*picks)


def fleet_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id and the columns of steps() of many traces: the events as one, and the lines of each order year as another."""
    first = steps(spark, sf_dir).selectExpr("'events' as trace_id", "step_id", "chunk_id", "kind", "v")
    lines = _lines(spark, sf_dir).selectExpr(
        "concat('lines-', year(l_shipdate)) as trace_id",
        "l_orderkey * 8 + l_linenumber as step_id",
        f"(l_orderkey * 8 + l_linenumber) div {CHUNK} as chunk_id",
        "case when l_linenumber = 1 then 'absolute' when l_linenumber < 6 then 'delta' else 'raise' end as kind",
        f"case when l_linenumber = 1 then (l_partkey % 5) * {STRIDE} + 1 + l_orderkey % 97 when l_linenumber < 6 then l_suppkey % 4 else 0L end as v",
    )
    return first.unionByName(lines)


FLEET = f"""lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2),
fleet AS (SELECT 'events' AS trace_id, step_id, chunk_id, kind, v FROM steps UNION ALL
  SELECT 'lines-' || year(l_shipdate), l_orderkey * 8 + l_linenumber, (l_orderkey * 8 + l_linenumber) // {CHUNK},
  CASE WHEN l_linenumber = 1 THEN 'absolute' WHEN l_linenumber < 6 THEN 'delta' ELSE 'raise' END,
  CASE WHEN l_linenumber = 1 THEN (l_partkey % 5) * {STRIDE} + 1 + l_orderkey % 97 WHEN l_linenumber < 6 THEN l_suppkey % 4 ELSE 0 END FROM lines),
fleet_positions AS (SELECT trace_id, step_id, kind, CAST(sum(v) OVER (PARTITION BY trace_id, seg ORDER BY step_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS position
  FROM (SELECT *, sum(CASE WHEN kind = 'absolute' THEN 1 ELSE 0 END)
          OVER (PARTITION BY trace_id ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM fleet) t)"""


def fleet_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, call_key, entry_step, exit_step: a call for each order in each trace that has lines of it, and the events' calls."""
    own = calls(spark, sf_dir).selectExpr("'events' as trace_id", "call_key", "entry_step", "exit_step")
    orders = _lines(spark, sf_dir).groupBy(F.expr("concat('lines-', year(l_shipdate)) as trace_id"), F.col("l_orderkey").alias("call_key"))
    lines = orders.agg(F.expr("min(l_orderkey * 8 + l_linenumber) as entry_step"), F.expr("max(l_orderkey * 8 + l_linenumber) as exit_step"))
    return own.unionByName(lines)


FLEET_CALLS = """fleet_calls AS (SELECT 'events' AS trace_id, call_key, entry_step, exit_step FROM calls UNION ALL
  SELECT 'lines-' || year(l_shipdate), l_orderkey, min(l_orderkey * 8 + l_linenumber), max(l_orderkey * 8 + l_linenumber) FROM lines GROUP BY 1, 2)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_key, function_id, entry_step, exit_step, depth: intervals of 900, 90 and 7 of each 1000, 100 and 10 steps.

    None crosses the end of another; some lie outside those of the next greater width, so depth is an order here, not a count.

    Keys number the calls by entry and depth. Each width has its own rank by arithmetic over its
    own entries, so nothing is sorted in one task: a call's key is the number of calls of all
    widths that enter before it, or with it at a smaller depth.
    """
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("e"))
    shapes = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(w).alias("w"), F.lit(k).alias("keep")) for d, w, k in ((0, 1000, 900), (1, 100, 90), (2, 10, 7))])
    rows = ids.select("e", F.explode(shapes).alias("g")).selectExpr("e", "g.depth", "cast(g.w as bigint) as w", "g.keep").where("e % w < keep")
    spans = rows.groupBy("depth", "w", F.expr("e - e % w").alias("first")).agg(F.min("e").alias("entry_step"), F.max("e").alias("exit_step"))
    before = "+".join(f"(entry_step div {w} + if(entry_step % {w} > 0 or depth > {d}, 1, 0))" for d, w in ((0, 1000), (1, 100), (2, 10)))
    return spans.selectExpr(f"cast({before} as bigint) as call_key", "(entry_step div w) % 20 as function_id", "entry_step", "exit_step", "depth")


CALLS = """calls AS (SELECT CAST(row_number() OVER (ORDER BY min(e), depth) - 1 AS BIGINT) AS call_key,
  CAST((min(e) - min(e) % w) / w AS BIGINT) % 20 AS function_id, min(e) AS entry_step, max(e) AS exit_step, depth
  FROM (SELECT event_id AS e FROM events) s
  CROSS JOIN (SELECT 0 AS depth, 1000 AS w, 900 AS keep UNION ALL SELECT 1, 100, 90 UNION ALL SELECT 2, 10, 7) g
  WHERE e % w < keep GROUP BY depth, w, e - e % w)"""

POSITIONS = """positions AS (SELECT step_id, kind, CAST(sum(v) OVER (PARTITION BY seg ORDER BY step_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS position
  FROM (SELECT *, sum(CASE WHEN kind = 'absolute' THEN 1 ELSE 0 END)
          OVER (ORDER BY step_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM steps) t)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step_id, ordinal, varname, type, value: two values a step."""
    one = table(spark, sf_dir, "events").selectExpr(
        "event_id as step_id",
        "array(named_struct('ordinal', 0, 'varname', event_type, 'type', 'float', 'value', value), "
        "named_struct('ordinal', 1, 'varname', 'k', 'type', 'int', 'value', cast(get_json_object(props, '$.k') as double))) as vs",
    )
    return one.select("step_id", F.inline("vs"))


VALUES = """vals AS (SELECT event_id AS step_id, 0 AS ordinal, event_type AS varname, 'float' AS type, value FROM events
  UNION ALL SELECT event_id, 1, 'k', 'int', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)"""


def io_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """io_index, kind, step_id, data: events of type error and purchase. Indexes are dense, by `dense`."""
    rows = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')").selectExpr(
        "event_id as step_id", "if(event_type = 'error', 'error', 'stdout') as kind", "props as data"
    )
    return dense(rows, "step_id", "io_index")


IO = """ios AS (SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS io_index, event_id AS step_id,
  CASE event_type WHEN 'error' THEN 'error' ELSE 'stdout' END AS kind, props AS data
  FROM events WHERE event_type IN ('error', 'purchase'))"""


def thread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, geid, tick, event_type (number), stream_offset."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as thread_id",
        "event_id as geid",
        "unix_micros(cast(ts as timestamp)) as tick",
        "case event_type when 'click' then 0 when 'error' then 19 when 'purchase' then 20 when 'signup' then 35 else 57 end as event_type",
        "event_id * 26 as stream_offset",
        "props as payload",
    )


THREADS = """threads AS (SELECT user_id AS thread_id, event_id AS geid, epoch_us(ts) AS tick,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 19 WHEN 'purchase' THEN 20 WHEN 'signup' THEN 35 ELSE 57 END AS event_type,
  event_id * 26 AS stream_offset, props AS payload FROM events)"""


def line_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path_id, path, line_lengths (bytes of each line, its end included): documents as source files."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id as path_id", "concat('/src/', source, '/', lang, '/f', doc_id, '.py') as path", "transform(split(text, '\\n', -1), l -> octet_length(l) + 1) as line_lengths")


PATHS = """paths AS (SELECT doc_id AS path_id, '/src/' || source || '/' || lang || '/f' || doc_id || '.py' AS path,
  list_transform(string_split(text, chr(10)), lambda l: strlen(l) + 1) AS line_lengths FROM documents)"""


def source_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view_idx, path_id, view_kind, view_name, content: three views of each path."""
    return table(spark, sf_dir, "pages").selectExpr("page_id as view_idx", "page_id div 3 as path_id", "cast(page_id % 3 as int) as view_kind", "url as view_name", "html as content")


VIEWS = "views AS (SELECT page_id AS view_idx, page_id // 3 AS path_id, CAST(page_id % 3 AS INTEGER) AS view_kind, url AS view_name, html AS content FROM pages)"
