"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Codes of a block of candidates and of a block of queries: a task holds one of each, and their estimates a slice at a time.
CANDIDATES = 16384
QUERIES = 1024
#: Bits of a code for each component; vectors are padded with zeros before the rotation, which tightens the bounds.
SPREAD = 16
#: An estimate is off by less than this many times sqrt((1 - f^2) / f^2 / (D - 1)) with high probability,
#: f being the inner product of a vector with its code of D bits; 1.9 is the usual choice, more reranks more and finds more.
BOUND = 3.0
#: Bits of a query's components, so that inner products are counts of bits.
PLANES = 6
SEED = 6


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """dim rows of a random orthogonal matrix of SPREAD times the size, in whole words of bits; the same on every executor."""
    wide = -(-SPREAD * dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1, by the largest component first so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per rotated unit vector: the packed signs, and its inner product with the code they stand for."""
    packed = np.packbits(turned >= 0, axis=1).view(np.uint64)
    return packed, (np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])).astype(np.float32)


def planes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per rotated query: its components in PLANES bits each, packed plane by plane; the step between levels; the lowest level."""
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-30)
    level = np.rint((turned - low) / step).astype(np.uint8)
    bits = np.stack([np.packbits((level >> k) & 1, axis=1).view(np.uint64) for k in range(PLANES)], axis=1)
    return bits, step[:, 0], low[:, 0]


def estimates(words: np.ndarray, factors: np.ndarray, query: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of one query (its planes, step and lowest level) with coded vectors, and their error bounds.

    words: the codes' first words of 64 bits in a row, then their second ones, and so on. The inner
    product with a code of signs is twice the sum over its set bits less the sum over all, and sums
    over set bits are counts of the bits that code and planes share. The rounding of the query's
    levels moves it as a random sum of half a step for each bit would.
    """
    bits, step, low = query
    wide = len(words) * 64
    ones, common, whole = np.zeros(len(factors), np.int32), np.zeros(len(factors), np.int32), 0
    for w, column in enumerate(words):
        ones += np.bitwise_count(column)
        for k in range(PLANES):
            common += np.bitwise_count(column & bits[k, w]).astype(np.int32) << k
            whole += int(np.bitwise_count(bits[k, w])) << k
    raw = (2 * (step * common + low * ones) - (step * whole + low * wide)) / np.sqrt(wide)
    bound = np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / (wide - 1)) + step / 2 / factors
    return raw / factors, BOUND * bound + 1e-5


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part, one row an id."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return rows.where(finite + " and exists(v, x -> x <> 0)").groupBy("vec_id").agg(F.min("v").alias("v"))


def _coded(rows: DataFrame, queries: bool, size: int, name: str) -> DataFrame:
    """dim, block, ids, data: codes and factors of candidates, or planes of queries, in blocks of at most `size` of one dimension."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}

        def packed(dim, ids, vs):
            turned = unit(np.array(vs, dtype=np.float64)) @ turns.setdefault(dim, rotation(dim))
            parts = planes(turned) if queries else codes(turned)
            columns = [pa.array([dim], pa.int32()), pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary())]
            columns.append(pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary())))
            return pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "data"])

        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(vec_id)
                vs.append(v)
                if len(ids) >= size:
                    yield packed(len(v), *held.pop(len(v)))
        for dim, (ids, vs) in held.items():
            yield packed(dim, ids, vs)

    shared.small_batches(rows.sparkSession)
    out = rows.mapInArrow(run, "dim int, ids binary, data array<binary>")
    return shared.cut(out.withColumn("block", F.monotonically_increasing_id()), name)


def _survivors(q_ids, q_data, c_ids, c_data, k: int):
    """For each query its id, its k + 1 greatest lower bounds, and the vectors of the block that may be among its k best, with upper bounds.

    The k-th greatest lower bound in the block decides. A query's own vector stays in: its other
    copies may be wanted, so k counts one more.
    """
    q_ids, c_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(c_ids, "<i8")
    bits = np.frombuffer(q_data[0], np.uint64).reshape(len(q_ids), PLANES, -1)
    step, low = (np.frombuffer(x, np.float64) for x in q_data[1:])
    words, factors = np.ascontiguousarray(np.frombuffer(c_data[0], np.uint64).reshape(len(c_ids), -1).T), np.frombuffer(c_data[1], np.float32)
    for i, query in enumerate(q_ids):
        found, bound = estimates(words, factors, (bits[i], step[i], low[i]))
        lower, upper = found - bound, found + bound
        least = np.partition(lower, -k - 1)[-k - 1] if len(lower) > k + 1 else -np.inf
        at = np.flatnonzero(upper >= least)
        yield query, np.sort(lower)[-k - 1 :], c_ids[at], upper[at]


def search(df: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of every row for which `queries` (a condition on vec_id) holds.

    Candidates are all rows but the query's own; ties go to the smaller id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part, rows repeated under one id count
    once (of different vectors the least), and only vectors of one length are compared. An empty table
    gives an empty result. Every vector is coded once. Equal vectors are one candidate, of which the
    k + 1 smallest ids matter, and one query, so copies never pair up. Only codes, one correction
    factor a vector and the queries' bit planes go into the blocks, whose pairs are compared one at
    a time; original vectors are fetched for those that the bounds leave, and compared in double
    precision. Recall: see the tests (over 0.99).
    """
    rows = shared.cut(usable(df, id_col, vector_col).withColumn("asked", queries), "vectors")
    spread = rows.withColumn("n", F.expr("row_number() over (partition by v order by vec_id)")).where(F.col("n") <= k + 1)
    classes = shared.cut(spread.groupBy("v").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("c", "v", "ids"), "vector-classes")
    asked = rows.where("asked").select("vec_id", "v").join(classes.select("c", "v"), "v").select(F.col("vec_id").alias("query_id"), "c")
    asked = shared.cut(asked, "asked")
    wanted = asked.select("c").distinct()
    few = _coded(classes.join(wanted, "c", "left_semi").select("c", "v"), True, QUERIES, "query-codes")
    many = _coded(classes.select("c", "v"), False, CANDIDATES, "codes")
    # The stated query set against all rows, in blocks: each block of codes goes once to each of its dimension's query blocks.
    sets = few.groupBy("dim").agg(F.collect_list("block").alias("sets"))
    pairs = many.join(sets, "dim").select("ids", "data", F.explode("sets").alias("block"))
    both = pairs.join(few.select("block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "block")
    both = both.select("q_ids", "q_data", "ids", "data").repartition(F.xxhash64("q_ids", "ids"))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                rows = zip(*_survivors(*(batch.column(i)[at].as_py() for i in range(4)), k), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(map(list, rows), own, strict=True)], names=["q", "lowers", "cs", "uppers"])

    own = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    near = shared.cut(both.mapInArrow(run, "q long, lowers array<double>, cs array<bigint>, uppers array<double>"), "survivors")
    # One row for each query and block; the bounds of all blocks thin the lists before they are rows of their own.
    lowers = near.select("q", F.explode("lowers").alias("lower"))
    least = lowers.withColumn("n", F.expr("row_number() over (partition by q order by lower desc)")).where(F.col("n") == k + 1).select("q", F.col("lower").alias("least"))
    fits = F.expr("filter(arrays_zip(cs, uppers), x -> least is null or x.uppers >= least)")
    near = near.join(least, "q", "left").select("q", F.explode(fits).alias("x")).select("q", F.col("x.cs").alias("c"))
    # Norms are bound to lambda variables: plain expressions would be computed again for every component.
    scaled = "transform(array(array_max(transform(v, y -> abs(y)))), m -> transform(v, x -> x / m))[0]"
    length1 = "transform(array(sqrt(aggregate(s, 0D, (a, y) -> a + y * y))), n -> transform(s, x -> x / n))[0]"
    units = shared.cut(classes.selectExpr("c", "ids", f"transform(array({scaled}), s -> {length1})[0] as u"), "units")
    exact = near.join(units.selectExpr("c as q", "u as qu"), "q").join(units, "c")
    exact = exact.selectExpr("q", "ids", "aggregate(zip_with(u, qu, (x, y) -> x * y), 0D, (a, p) -> a + p) as score")
    # The best k + 1 ids of each class of equal queries, as one may be a query's own: they lie in its best k + 1 classes.
    exact = exact.withColumn("n", F.expr("row_number() over (partition by q order by score desc, ids[0])")).where(F.col("n") <= k + 1)
    each = exact.select("q", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("n", F.expr("row_number() over (partition by q order by score desc, vec_id)")).where(F.col("n") <= k + 1)
    best = asked.join(each.withColumnRenamed("q", "c"), "c").where("query_id <> vec_id")
    ranked = best.withColumn("rank", F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest embeddings of every one whose vec_id is divisible by 50."""
    return search(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
