"""Helpers the operators share: tables cut from their lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OWN_DIR = "spark.spoor.shared.dir"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or in local mode, where it is unset, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set(OWN_DIR, found := f"file://{tempfile.mkdtemp(prefix='spoor-')}")
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor costs a reread, not the whole lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._spoor_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_spoor_path", None):
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind so many underscores more that no column of df has it."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in used:
            name = f"_{name}"
        out.append(name)
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph, by alternating large-star and small-star steps.

    edges: columns a, b (long). Returns node, comp for every node that has an edge to
    another one, as a written table; comp is the component's smallest node. Self-loops and
    repeated edges are ignored; an empty input gives an empty result. Each step is joins and
    aggregates only, so a hub's edges may be split over tasks, and ends in a written table. The
    number of steps grows with the logarithm of the longest path.
    """
    e = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "cc",
    )
    while True:
        # Done when every component is a star: no node points to two others, or is pointed to and points itself.
        ends = e.selectExpr("u as node", "1L as out", "0L as into").unionByName(e.selectExpr("v as node", "0L as out", "1L as into"))
        if not ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = cut(large.distinct(), "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        drop(e, large)
        e = small
    whole = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out = cut(whole.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components")
    drop(e)
    return out


_held: list = []


def hold(spark: SparkSession, value):
    """A broadcast that release() takes back from the executors."""
    _held.append(spark.sparkContext.broadcast(value))
    return _held[-1]


def release() -> None:
    """Take earlier broadcasts back from the executors; a table that still needs one fetches it again."""
    for b in _held:
        b.unpersist()
    _held.clear()


#: Rows of an Arrow batch where the session has Spark's own 10,000: texts may be long, and both sides hold whole batches.
BATCH = 1000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(BATCH))


def map_texts(df: DataFrame, id_col: str, text_col: str, returns: str, work, rows: int = 256) -> DataFrame:
    """id_col's values unchanged, then the columns of `returns` (DDL) that work(list of texts) gives as lists.

    Runs over Arrow batches, a few rows at a time, so memory is bounded by a slice of them.
    """
    small_batches(df.sparkSession)
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, {returns}"

    def run(batches):
        own = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                columns = work(part.column(1).to_pylist())
                if own is None:
                    own = to_arrow_schema(T.StructType.fromJson(shape))
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, list(own)[1:], strict=True)]
                arrays = [a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, list(own)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=own.names)

    shape = T.StructType.fromDDL(schema).jsonValue()
    return slim.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def filter_texts(df: DataFrame, text_col: str, test, rows: int = 256) -> DataFrame:
    """The rows of df, all columns unchanged, for whose text test(list of texts) gives True; a few rows at a time."""
    small_batches(df.sparkSession)
    at_text = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(test(part.column(at_text).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


#: ASCII other than letters and digits becomes a space, A-Z becomes a-z, and all other bytes stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and any other character beyond ASCII."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []
