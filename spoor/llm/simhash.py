"""SimHash near-duplicates over a positional byte index with count filtering (operator 4)."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

SEED = 42
MAX_BITS = 3
SHINGLE = 3
#: Three-byte keys: two fingerprints that share at least 5 of their 8 bytes share at least
#: 3 of the first four or 3 of the last four, so these eight triples meet every such pair.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of the word shingles of a text, as a signed long; no words: zero."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype="<u8")
    else:
        ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(x + 1 for x in ends[:-1])]
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        block = hashes[at : at + 4096]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in texts], dtype="int64")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) of every row."""
    return df.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"))


def _byte(fp, i: int):
    return F.shiftright(fp, 8 * i).bitwiseAND(F.lit(255))


def _shared_bytes(a, b):
    """The tally of positional bytes that two fingerprints share."""
    both = a.bitwiseXOR(b)
    return sum((F.when(_byte(both, i) == 0, 1).otherwise(0) for i in range(8)), F.lit(0))


def _linked(a, b):
    """Count filter (the tally taken from the two fingerprints, not summed over the index), then the exact distance. At most 3 differing bits touch at most 3 bytes, so 5 are shared."""
    return (_shared_bytes(a, b) >= 8 - MAX_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def postings(fps: DataFrame) -> DataFrame:
    """The inverted index: key (which triple, and its three bytes) -> fp, eight rows a fingerprint."""
    fp = F.col("fp")
    keys = [
        F.lit(n << 24) + _byte(fp, a) * F.lit(65536) + _byte(fp, b) * F.lit(256) + _byte(fp, c)
        for n, (a, b, c) in enumerate(TRIPLES)
    ]
    return fps.select(F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"), "fp")


def _refined(rows: DataFrame, big: int) -> DataFrame:
    """Keys of large lists get two bytes more: a pair that shares 5 bytes, 3 of them by the key, shares 2 of the rest."""
    fp, keyed = F.col("fp"), None
    for n, triple in enumerate(TRIPLES):
        rest = [i for i in range(8) if i not in triple]
        subs = [F.lit(k << 16) + _byte(fp, a) * F.lit(256) + _byte(fp, b) for k, (a, b) in enumerate(combinations(rest, 2))]
        arm = F.array(*[s.cast("long") for s in subs])
        keyed = F.when(F.shiftright("key", 24) == n, arm) if keyed is None else keyed.when(F.shiftright("key", 24) == n, arm)
    return rows.withColumn("sub", F.explode(F.when(F.col("n") > big, keyed).otherwise(F.array(F.lit(-1).cast("long")))))


def links(fps: DataFrame, big: int = 64) -> tuple[DataFrame, DataFrame]:
    """Components of distinct fingerprints under the distance, as (fp, comp) for linked ones, and the edges used.

    Two passes that lose no connection. First every list of the index links its members to its
    least and its greatest fingerprint only, which settles groups of near copies without their
    pairs. Then only lists whose members still lie in different components meet again, keyed
    by two more bytes where they are long, and pairs of different components are compared.
    """
    index = postings(fps)
    lists = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    lists = shared.cut(lists, "lists")
    members = shared.cut(index.join(lists, "key"), "members")
    hubs = members.select("fp", F.explode(F.array("lo", "hi")).alias("hub")).where("fp <> hub")
    first = hubs.where(_linked(F.col("fp"), F.col("hub"))).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()
    first = shared.cut(first, "edges")
    comps = shared.components(first)

    placed = members.where("n > 2").join(comps.withColumnRenamed("node", "fp"), "fp", "left")
    placed = placed.select("key", "n", "fp", F.coalesce("comp", "fp").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_lists = shared.cut(_refined(placed.join(mixed, "key"), big), "open")
    a, b = open_lists.alias("a"), open_lists.alias("b")
    second = a.join(
        b,
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.sub") == F.col("b.sub"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.col("a.comp") != F.col("b.comp"))
        & _linked(F.col("a.fp"), F.col("b.fp")),
    ).select(F.col("a.comp").alias("a"), F.col("b.comp").alias("b"))
    edges = comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(second.distinct())
    out = shared.components(edges)
    shared.drop(lists, members, open_lists, first, comps)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id, comp (the component's least fingerprint) for every row.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id that
    links reach, the row's own included. Null and empty texts have fingerprint zero and link
    like any other. Null doc_ids are kept and never chosen: their component_id is the smallest
    doc_id of the component, or null if it has none. Repeated rows each get a row. Texts
    may have any length. An empty table gives an empty result. Equal fingerprints meet once, so copies never pair up.
    """
    fps = shared.cut(fingerprints(df, id_col, text_col), "fingerprints")
    classes = shared.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    comps = links(classes.select("fp"))
    placed = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("comp", "fp").alias("comp")
    )
    least = placed.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = shared.cut(placed.join(least, "comp").select("fp", "component_id", "comp"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "comp")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df without near-duplicates: of each component one row stays, with all its columns.

    That row is the one with the component's smallest id; rows repeated under that id in the
    component count as one. An id with rows in several components is looked up by each row's own
    fingerprint. Where no row of a component has an id, one with the component's least fingerprint stays.
    """
    found = shared.cut(near_duplicates(df, id_col, text_col), "groups")
    keep, own, other, mark, comp = shared.free(df, "_keep", "_fp", "_id", "_print", "_comp")
    ids = found.where("doc_id is not null").groupBy(F.col("doc_id").alias(keep))
    ids = ids.agg(F.expr("bool_or(doc_id = component_id)").alias("kept"), F.expr("min(comp) <> max(comp)").alias("mixed")).where("kept")
    ids = shared.cut(ids, "kept-ids")
    alike, apart = ids.where("not mixed").select(keep), ids.where("mixed").select(keep)
    named = df.where(F.col(id_col).isNotNull())
    single = named.join(alike, F.col(id_col) == F.col(keep), "left_semi").dropDuplicates([id_col])
    several = named.join(apart, F.col(id_col) == F.col(keep), "left_semi").withColumn(own, _fingerprints(F.col(text_col)))
    placed = found.where("doc_id = component_id").selectExpr(f"doc_id as {other}", f"fp as {mark}", f"comp as {comp}").distinct()
    several = several.join(placed, (F.col(id_col) == F.col(other)) & (F.col(own) == F.col(mark))).dropDuplicates([id_col, comp]).select(*df.columns)
    alone = found.where("component_id is null and fp = comp").select(F.col("fp").alias(keep)).distinct()
    nameless = df.where(F.col(id_col).isNull()).withColumn(own, _fingerprints(F.col(text_col)))
    nameless = nameless.join(alone, F.col(own) == F.col(keep), "left_semi").dropDuplicates([own]).select(*df.columns)
    return single.unionByName(several).unionByName(nameless)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents: doc_id, fingerprint, component_id."""
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id")
    )
