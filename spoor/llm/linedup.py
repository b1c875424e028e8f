"""Fuzzy line dedup: MinHash over character shingles, bands, exact Jaccard, components (operator 2).

DataFrame expressions only. A line of fewer than SHINGLE characters is its own only shingle.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SHINGLE = 10
SIMILARITY = 0.8
#: Nine minima as the points of a 3 by 3 plane; a band is one of its twelve lines. Two minima are
#: in one band exactly once, so few hashes make many nearly independent bands: 99.0 % of pairs
#: with a similarity of 0.8 share one, 99.96 % of those with 0.9 (97.6 % and more on lines of 40 characters or fewer).
POINTS = 9
BANDS = [
    *[(3 * r, 3 * r + 1, 3 * r + 2) for r in range(3)],
    *[(c, c + 3, c + 6) for c in range(3)],
    *[(d, 3 + (d + 1) % 3, 6 + (d + 2) % 3) for d in range(3)],
    *[(d, 3 + (d + 2) % 3, 6 + (d + 1) % 3) for d in range(3)],
]
_rnd = random.Random(20240229)
#: Multiplying by an odd number modulo 2^31 permutes the hashes, and so does XOR with a constant.
#: Each minimum has its own order of all hashes; XOR alone would let all nine choose among the
#: few hashes with the same high bits.
MIXES = [(_rnd.getrandbits(31) | 1 << 29 | 1, _rnd.getrandbits(31)) for _ in range(POINTS)]
#: Shingles hashed in one row of the exploded lines; rows are dearer than expressions.
UNROLL = 16
#: Longs of a sketch, 64 bits each: the parity of the shingles whose hash falls on each bit.
SKETCH = 16
#: Shares of a bucket's lines that all its other lines are compared with, one after another; each divides the one before.
SHARES = (16, 1)
#: Rows of 64 bits in which sifted() marks hashes: a bound for what is broadcast, whatever the number of hashes.
SLOTS = 1 << 18
_BLANK = r" \t\r\n\f\u000B"


def lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, of (hash of the text), line_no, line, h (64-bit hash of the line), place (hash of the first three); lines of white space are left out."""
    # The text's hash and its parts are columns before they are exploded; else every line would hash its whole text again.
    whole = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("of"), F.split(text_col, "\n", -1).alias("parts"))
    rows = whole.select("doc_id", "of", F.posexplode("parts").alias("line_no", "line"))
    rows = rows.where(f"trim(leading '{_BLANK}' from line) <> ''")
    return rows.withColumns({"h": F.xxhash64("line"), "place": F.xxhash64("doc_id", "of", "line_no")})


def signatures(lines: DataFrame) -> DataFrame:
    """h, n (occurrences), place (the least of its places), m0..m8 of every distinct line.

    A shingle is 10 UTF-16 code units, that is characters but for those beyond the basic plane.
    Every shingle of a line takes part, however long the line is.
    """
    width = 2 * SHINGLE
    rows = lines.select("h", "place", F.encode("line", "UTF-16BE").alias("b"))
    rows = rows.selectExpr("h", "place", "b", f"greatest(length(b) - {width - 1}, 1) as last")
    rows = rows.selectExpr("h", "place", "b", "last", f"explode(sequence(1, last, {2 * UNROLL})) as at")
    hashed = [f"cast(hash(substring(b, least(at + {2 * j}, last), {width})) & 2147483647 as bigint) as s{j}" for j in range(UNROLL)]
    rows = rows.selectExpr("h", "place", "at", *hashed)
    minima = []
    for i, (a, x) in enumerate(MIXES):
        own = ", ".join(f"(s{j} * {a}L & 2147483647L) ^ {x}L" for j in range(UNROLL))
        minima.append(F.expr(f"cast(min(least({own})) as int)").alias(f"m{i}"))
    return rows.groupBy("h").agg(F.expr("sum(if(at = 1, 1L, 0L))").alias("n"), F.min("place").alias("place"), *minima)


def _shingles(line: str) -> str:
    """The set of a line's shingles of 10 characters, as an SQL expression."""
    at = f"sequence(1, greatest(length(b) - {2 * SHINGLE}, 0) + 1, 2)"
    one = f"array_distinct(transform({at}, i -> xxhash64(substring(b, i, {2 * SHINGLE}))))"
    return f"transform(array(encode({line}, 'UTF-16BE')), b -> {one})[0]"


def sketched(texts: DataFrame) -> DataFrame:
    """h, size (of the line's set of shingles) and k0..k15, the parities of the shingles on each of 1,024 bits."""
    rows = texts.selectExpr("h", f"explode({_shingles('line')}) as s")
    bit = "shiftleft(1L, cast(s & 63 as int))"
    parts = [F.expr(f"bit_xor(if((shiftright(s, 6) & {SKETCH - 1}) = {j}, {bit}, 0L))").alias(f"k{j}") for j in range(SKETCH)]
    return rows.groupBy("h").agg(F.count("*").alias("size"), *parts)


def _may_be_close() -> str:
    """What holds of every pair (a, b) with the similarity, and of few others.

    Sets whose sizes differ more can't have it, and each differing bit of the sketches stands for a
    shingle that only one line has: at similarity s there are (1 - s) / (1 + s) of both sizes at most.
    """
    sizes = f"least(a.size, b.size) >= {SIMILARITY}D * greatest(a.size, b.size)"
    differ = " + ".join(f"bit_count(a.k{j} ^ b.k{j})" for j in range(SKETCH))
    return f"{sizes} and {1 + SIMILARITY}D * ({differ}) <= {1 - SIMILARITY}D * (a.size + b.size) + 1e-6D"


def met(rows: DataFrame) -> DataFrame:
    """a, b: pairs of lines that share a bucket, belong to different components and may be close; one of them asks. Each pair once.

    rows: key, h, comp, size, band (that of the key, from 1), asks, k0..k15, m0..m8. Of the buckets
    that a pair shares, that of the first band in which their minima agree gives it.
    """
    # A join reads all columns of its condition for each pair of a bucket: minima go two in a long, and none may be null.
    high, low = [f"shiftleft(cast(m{i} as bigint), 32)" for i in range(0, POINTS, 2)], [*[f"m{i}" for i in range(1, POINTS, 2)], "0L"]
    longs = {c: c for c in ("key", "h", "comp", "size", *[f"k{j}" for j in range(SKETCH)])}
    longs |= {f"p{n}": f"{x} | {y}" for n, (x, y) in enumerate(zip(high, low, strict=True))}
    slim = rows.selectExpr("coalesce(band, 0) as band", "coalesce(asks, false) as asks", *[f"coalesce({x}, 0L) as {c}" for c, x in longs.items()])
    same = [f"(a.p{i // 2} ^ b.p{i // 2}) & 4294967295L = 0L" if i % 2 else f"shiftrightunsigned(a.p{i // 2} ^ b.p{i // 2}, 32) = 0L" for i in range(POINTS)]
    agree = (" and ".join(same[i] for i in band) for band in BANDS)
    here = f"a.band = case {' '.join(f'when {x} then {k + 1}' for k, x in enumerate(agree))} else 0 end"
    far = F.expr(f"a.key = b.key and a.comp <> b.comp and (a.h < b.h or not b.asks) and {here}") & F.expr(_may_be_close())
    return slim.where("asks").alias("a").join(slim.alias("b"), far).selectExpr("a.h as a", "b.h as b")


def sifted(rows: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """rows without most of those whose col (a hash) is not in wanted's; none that is there gets lost. Spares a shuffle its rows, not the join."""
    bit = f"shiftleft(1L, cast(shiftrightunsigned({col}, 32) & 63 as int))"
    slots = wanted.selectExpr(f"{col} & {SLOTS - 1}L as _slot", f"{bit} as _bit").groupBy("_slot").agg(F.expr("bit_or(_bit)").alias("_bits"))
    return rows.join(F.broadcast(slots), F.expr(f"{col} & {SLOTS - 1}L = _slot and {bit} & _bits <> 0L")).select(*rows.columns)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of line hashes those whose shingle sets have a Jaccard similarity of 0.8 or more; texts: h, line."""
    both = pairs.join(texts.selectExpr("h as a", "line as la"), "a").join(texts.selectExpr("h as b", "line as lb"), "b")
    # Sets and encoded lines are bound to lambda variables: plain columns would be inlined and computed at every mention.
    sets = f"array(named_struct('a', {_shingles('la')}, 'b', {_shingles('lb')}))"
    sizes = f"transform({sets}, p -> named_struct('n', size(p.a) + size(p.b), 'both', size(array_intersect(p.a, p.b))))"
    return both.where(f"exists({sizes}, q -> q.both >= {SIMILARITY}D * (q.n - q.both) - 1e-9D)").select("a", "b")


def line_components(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All distinct lines with signatures, and (node, comp) of those that have a near-duplicate.

    A bucket (equal minima in one band) first compares its lines with its least hash only. Then
    lines of buckets that still hold several components meet across components: first one in 16
    lines with all others, then all with all. Sizes and sketches sort out, inside the join, pairs
    that can't have the similarity; the rest is verified exactly. A pair comes from one of the buckets
    that it shares, and not again after an earlier share. Copies thus never give all
    their pairs, and no link that would join two components is lost.
    """
    distinct = shared.cut(signatures(lines), "line-signatures")
    minima = [f"m{i}" for i in range(POINTS)]
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"m{i}") for i in band]) for k, band in enumerate(BANDS)])
    index = distinct.select("h", F.explode(keys).alias("key"))
    # Sums by a key are written before they meet its rows again: Spark splits a hot key only where a join reads two plain shuffles.
    buckets = index.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("hub")).where("n > 1")
    buckets = shared.cut(buckets, "line-buckets")
    members = shared.cut(sifted(index, buckets, "key").join(buckets.hint("shuffle_hash"), "key"), "line-members")
    shared.drop(buckets)
    wanted = sifted(distinct.select("h", "place", *minima), members, "h")
    wanted = shared.cut(wanted.join(members.select("h").distinct(), "h", "left_semi"), "line-wanted")
    texts = sifted(lines.select("h", "place", "line"), wanted, "h").join(wanted.select("h", "place").hint("shuffle_hash"), ["h", "place"], "left_semi")
    texts = shared.cut(texts.select("h", "line").distinct(), "line-texts")
    sketches = shared.cut(sketched(texts).join(wanted.select("h", *minima), "h"), "line-sketches")
    shared.drop(wanted)
    near = F.expr(_may_be_close())
    first = members.where("h <> hub").select("hub", "h").distinct().alias("p")
    first = first.join(sketches.alias("a"), F.expr("p.hub = a.h")).join(sketches.alias("b"), F.expr("p.h = b.h") & near)
    first = shared.cut(first.selectExpr("p.hub as a", "p.h as b"), "line-near")
    good = shared.cut(verified(first, texts), "line-pairs")
    comps = shared.components(good)
    shared.drop(first, good)
    # Two lines of a bucket have met already; a bucket of one component needs no other look.
    apart, before = members.where("n > 2"), None
    for share in SHARES:
        now = shared.cut(apart.select("key", "h").join(comps.withColumnRenamed("node", "h"), "h", "left").selectExpr("key", "h", "coalesce(comp, h) as comp"), "line-now")
        several = now.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
        several = shared.cut(several.where("x <> y").select("key"), "line-several")
        shared.drop(apart)
        apart = shared.cut(now.join(several.hint("shuffle_hash"), "key"), "line-apart")
        # What differs between shares is a column, so that all shares run the same compiled join.
        band = F.array_position(keys, F.col("key")).cast("int").alias("band")
        rows = apart.join(sketches, "h").select("*", band, F.expr(f"pmod(h, {share}) = 0").alias("asks"))
        rows = shared.cut(rows.where(f"pmod(h, {before}) <> 0") if before else rows, "line-open")
        fresh = shared.cut(met(rows), "line-near")
        good = shared.cut(verified(fresh, texts), "line-pairs")
        merged = shared.components(comps.selectExpr("node as a", "comp as b").unionByName(good))
        shared.drop(now, several, rows, fresh, good, comps)
        comps, before = merged, share
    shared.drop(apart, members, texts, sketches)
    return distinct, comps


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, of, dropped (line numbers from 0, ascending): the documents that lose lines.

    Of the lines of a component, equal lines included, the first by doc_id (nulls last), then
    by the hash of the text, then by line number stays. Lines of white space take no part. Rows equal in
    id and text are one document. A 64-bit hash stands for a line. Null and empty texts have no
    lines; texts may have any length and number of lines; an empty table gives an empty result.
    """
    lines = lines_of(df, id_col, text_col)
    distinct, comps = line_components(lines)
    many = distinct.where("n > 1").select("h").join(comps.withColumnRenamed("node", "h"), "h", "full_outer")
    many = shared.cut(many.selectExpr("h", "coalesce(comp, h) as comp"), "line-many")
    shared.drop(distinct, comps)
    placed = shared.cut(sifted(lines.select("doc_id", "of", "line_no", "h"), many, "h").join(many, "h").select("comp", "doc_id", "of", "line_no"), "line-placed")
    shared.drop(many)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of", "line_no")
    first = shared.cut(placed.groupBy("comp").agg(F.min(rank).alias("first")), "line-first")
    lost = placed.join(first, "comp").where(rank != F.col("first"))
    lost = lost.groupBy("doc_id", "of").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    out = shared.cut(lost, "line-lost")
    shared.drop(placed, first)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with near-duplicate lines removed from its texts, all columns kept.

    A document that loses all its lines but those of white space goes; texts that lose no line stay as they are,
    null and blank ones among them. Repeated rows each keep their row. An empty table stays empty.
    """
    own, other, of, gone = shared.free(df, "_hash", "_id", "_of", "_dropped")
    lost = dropped_lines(df, id_col, text_col).selectExpr(f"doc_id as {other}", f"of as {of}", f"dropped as {gone}")
    named = df.withColumn(own, F.xxhash64(text_col))
    both = named.join(lost, F.col(id_col).eqNullSafe(F.col(other)) & (F.col(own) == F.col(of)), "left")
    at = f"array_except(sequence(0, size(l) - 1), {gone})"
    kept = f"transform(array(split(`{text_col}`, '\\n', -1)), l -> array_join(transform({at}, i -> l[i]), '\\n'))[0]"
    new = both.withColumn(text_col, F.expr(f"if({gone} is null, `{text_col}`, {kept})"))
    return new.where(f"{gone} is null or trim(both '{_BLANK}' from `{text_col}`) <> ''").select(*df.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines (not blank), n_dropped, and the dropped lines' numbers, comma-joined."""
    documents = shared.table(spark, sf_dir, "documents")
    lost = dropped_lines(documents).withColumnRenamed("doc_id", "_id")
    counted = documents.select(
        "doc_id",
        F.xxhash64("text").alias("_of"),
        F.expr(f"cast(coalesce(size(filter(split(text, '\\n', -1), l -> trim(leading '{_BLANK}' from l) <> '')), 0) as bigint)").alias("n_lines"),
    )
    both = counted.join(lost, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("of")), "left")
    return both.select(
        "doc_id",
        "n_lines",
        F.expr("cast(coalesce(size(dropped), 0) as bigint)").alias("n_dropped"),
        F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"),
    )
