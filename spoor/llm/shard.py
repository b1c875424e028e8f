"""Sharding over a hierarchical weighted hash tree (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Slots are counted in so many parts of a shard; the table of their sizes is bounded by shards times parts.
PARTS_HEX = 3


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shards, each shard with a weight; shards are numbered in order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, regions: int, racks: int, shards: int) -> Tree:
        return cls((((1.0,) * shards,) * racks,) * regions)

    @property
    def count(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: rows move only into it, and earlier numbers stay."""
        return Tree((*self.regions, ((weight,),)))

    def reweighted(self, region: int, rack: int, shard: int, weight: float) -> Tree:
        """Another weight for one shard: region draws change for its region alone, so no row moves between two others."""
        new = [[list(k) for k in r] for r in self.regions]
        new[region][rack][shard] = weight
        return Tree(tuple(tuple(tuple(k) for k in r) for r in new))


def _lit(values, depth: int) -> Column:
    if depth == 0:
        return F.lit(float(values))
    return F.array(*[_lit(v, depth - 1) for v in values])


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from an MD5 of key and path: the least draw wins in proportion to the weight."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", key, path)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf")))


def _pick(key: Column, above: Column | None, weights: Column) -> Column:
    """The index of the child that wins."""

    def each(w, i):
        name = i.cast("string") if above is None else F.concat_ws(".", above, i.cast("string"))
        return F.struct(_draw(key, name, w).alias("draw"), i.alias("i"))

    return F.array_min(F.transform(weights, each))["i"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key: descend by one draw among regions, one among the region's racks, one among the rack's shards."""
    region_w = _lit([sum(map(sum, r)) for r in tree.regions], 1)
    rack_w = _lit([[sum(k) for k in r] for r in tree.regions], 2)
    shard_w = _lit(tree.regions, 3)
    first, n = [], 0
    for r in tree.regions:
        first.append([])
        for k in r:
            first[-1].append(n)
            n += len(k)
    bases = F.array(*[F.array(*[F.lit(x) for x in r]) for r in first])
    step = F.struct(key.alias("key"), _pick(key, None, region_w).alias("r"))

    def racks(s):
        return F.struct(s["key"].alias("key"), s["r"].alias("r"), _pick(s["key"], s["r"].cast("string"), F.get(rack_w, s["r"])).alias("k"))

    def shards(s):
        path = F.concat_ws(".", s["r"].cast("string"), s["k"].cast("string"))
        return F.get(F.get(bases, s["r"]), s["k"]) + _pick(s["key"], path, F.get(F.get(shard_w, s["r"]), s["k"]))

    return F.transform(F.transform(F.array(step), racks), shards)[0].cast("int")


def assign(df: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot, and grown_shard where a second tree is given.

    The law is `key`: the id and the tree alone decide the shard. Raising a weight moves rows
    only into the subtrees that hold it, lowering it only out of them. Null ids count as an
    empty key and go to one shard. size is the text's UTF-8 bytes (null: none) plus 8, and
    text_crc32 that of its UTF-8 bytes (null: of none, 0). Slots are gapless from 0 in each
    shard: rows are numbered within parts that a hash of id, checksum and size deals out, so
    no shard is ever sorted in one task, and each part starts after those before it. Rows
    equal in id, checksum and size share a part and take its slots in any order. Null ids count as
    empty ones; null texts have no bytes, and texts may have any length. An empty table gives an
    empty result.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    named = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"), F.col("size"))
    rows = shared.cut(rows.withColumn("part", F.substring(F.md5(named), 1, PARTS_HEX)), "shards")
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = sizes.selectExpr(
        "shard", "part", "sum(n) over (partition by shard order by part rows between unbounded preceding and current row) - n as start"
    )
    placed = rows.selectExpr(
        "*", "row_number() over (partition by shard, part order by doc_id, text_crc32, size) - 1 as at"
    ).join(starts, ["shard", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(df: DataFrame, tree: Tree, path: str, id_col: str = "doc_id", files: int = 8) -> None:
    """Write df's rows into one folder a shard, each in `files` parts so that no shard is one task."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
    named = df.withColumns({"shard": shard_of(key, tree), "_spread": spread})
    named.repartition("shard", "_spread").drop("_spread").write.partitionBy("shard").parquet(path)


#: 24 shards: 3 regions of 4 racks of 2.
TREE = Tree.even(3, 4, 2)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents over 24 shards by the law `key`, and over 25."""
    found = assign(shared.table(spark, sf_dir, "documents"), TREE, TREE.grown())
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql(tree: Tree, out: str, source: str, key: str) -> str:
    """A CTE chain that descends the tree, as joins with its nodes."""
    regions = ", ".join(f"({r}, {sum(map(sum, x))})" for r, x in enumerate(tree.regions))
    racks = ", ".join(f"({r}, {k}, {sum(y)})" for r, x in enumerate(tree.regions) for k, y in enumerate(x))
    leaves, n = [], 0
    for r, x in enumerate(tree.regions):
        for k, y in enumerate(x):
            for s, w in enumerate(y):
                leaves.append(f"({r}, {k}, {s}, {w}, {n})")
                n += 1
    draw = "-ln((CAST('0x' || substr(md5(" + key + " || '|' || {0}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / w"
    return f"""
{out}_r AS (SELECT n, {key}, arg_min(r, {draw.format("r")}) AS r FROM {source}, (VALUES {regions}) AS t(r, w) GROUP BY ALL),
{out}_k AS (SELECT n, {key}, a.r, arg_min(k, {draw.format("a.r || '.' || k")}) AS k
            FROM {out}_r a JOIN (VALUES {racks}) AS t(r, k, w) ON a.r = t.r GROUP BY ALL),
{out} AS (SELECT n, arg_min(id, {draw.format("a.r || '.' || a.k || '.' || s")}) AS shard
          FROM {out}_k a JOIN (VALUES {", ".join(leaves)}) AS t(r, k, s, w, id) ON a.r = t.r AND a.k = t.k GROUP BY n, {key})"""


ORACLE_SQL = f"""
WITH table_of AS (
  SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
             hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size
      FROM documents),
bytes AS (SELECT n, list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))) AS b FROM d),
crc AS (SELECT n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS text_crc32
        FROM bytes, table_of),
{_sql(TREE, "old", "d", "key")},
{_sql(TREE.grown(), "new", "d", "key")}
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(old.shard AS INTEGER) AS shard,
       CAST(row_number() OVER (PARTITION BY old.shard ORDER BY substr(md5(key || '|' || text_crc32 || '|' || size), 1, {PARTS_HEX}),
            doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(new.shard AS INTEGER) AS grown_shard
FROM d JOIN crc USING (n) JOIN old USING (n) JOIN new USING (n)
"""
