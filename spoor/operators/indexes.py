"""Indexes from lines and keys to steps and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Steps, keys or views of a chunk of an index: one key's postings come in rows of so many at most, however hot it is.
POSTINGS = 65536


def postings(rows: DataFrame, keys: list, value: str, out: str, span: int = POSTINGS, *more) -> DataFrame:
    """keys, chunk_no, `out` (values in order) and what else is asked: one row for each key and `span` of values."""
    chunk = F.floor(F.col(value) / span).cast("long").alias("chunk_no")
    return rows.groupBy(*keys, chunk).agg(F.sort_array(F.collect_list(value)).alias(out), *more)


def line_hits(positions: DataFrame, span: int = POSTINGS, by: tuple[str, ...] = ()) -> DataFrame:
    """by, gli, chunk_no, step_ids (ascending), n of every line that a moving step reaches (F-1, F-2)."""
    moved = positions.where("kind in ('absolute', 'delta')")
    return postings(moved, [*by, F.col("position").alias("gli")], "step_id", "step_ids", span, F.count("*").alias("n"))


def lookup_hits(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """The hits of wanted lines (gli); a line that was never reached raises an error (E-9)."""
    met = wanted.select("gli").join(hits, "gli", "left")
    return met.withColumn("n", F.expr("if(n is null, raise_error(concat('no hits for line ', gli)), n)"))


def hit_counts(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """gli, n; 0 for a line that was never reached (F-2)."""
    sums = hits.groupBy("gli").agg(F.sum("n").alias("n"))
    return wanted.select("gli").join(sums, "gli", "left").select("gli", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def step_map(located: DataFrame, span: int = POSTINGS, by: tuple[str, ...] = ()) -> DataFrame:
    """by, path_id, line, chunk_no, step_count, first_step_id, last_step_id, step_ids of every source line (F-4)."""
    more = (F.count("*").alias("step_count"), F.min("step_id").alias("first_step_id"), F.max("step_id").alias("last_step_id"))
    return postings(located, [*by, "path_id", "line"], "step_id", "step_ids", span, *more)


def write_sorted(df: DataFrame, path: str, keys: list[str], parts: int | None = None) -> None:
    """Write an index as sorted Parquet, range-partitioned by its keys: row-group statistics then serve point reads."""
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def bulk_load(df: DataFrame, key: str, path: str) -> None:
    """Write unique keys in one commit; a repeated key raises an error (K-9)."""
    checked = df.withColumn("_n", F.expr(f"count(*) over (partition by `{key}`)"))
    checked = checked.withColumn(key, F.expr(f"if(_n > 1, raise_error(concat('repeated key ', `{key}`)), `{key}`)")).drop("_n")
    write_sorted(checked, path, [key])


def lookup(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of wanted keys (E-10, E-11)."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def at_snapshot(commits: DataFrame, key: str, snapshot: int) -> DataFrame:
    """Per key its latest row with commit_id <= snapshot; deleted ones (null payload) are left out (E-12, R8)."""
    rows = commits.where(F.col("commit_id") <= snapshot)
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "commit_id").alias("s"))
    return latest.select(key, "s.*").where("payload is not null")


def memory_writes(writes: DataFrame) -> DataFrame:
    """Per address: the number of writes, the first and last tick, and the value after the last write."""
    return writes.groupBy("address").agg(
        F.count("*").alias("n"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.max_by("new_value", F.struct("tick", "interval_id")).alias("value")
    )


def views_of_paths(views: DataFrame, span: int = POSTINGS) -> DataFrame:
    """path_id, chunk_no, view_idxs (ascending): the reverse index of source views (E-8)."""
    return postings(views, ["path_id"], "view_idx", "view_idxs", span)
