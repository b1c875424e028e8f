import hashlib
import math
import zlib
from collections import Counter

from spoor.llm import shard

SCHEMA = "doc_id long, text string, lang string, shard int, slot long"


def brute(key, tree):
    def draw(path, w):
        u = (int(hashlib.md5(f"{key}|{path}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / w if w > 0 else math.inf

    pick = lambda pre, ws: min(range(len(ws)), key=lambda i: (draw(f"{pre}{i}", ws[i]), i))
    r = pick("", [sum(map(sum, x)) for x in tree.regions])
    k = pick(f"{r}.", [sum(x) for x in tree.regions[r]])
    s = pick(f"{r}.{k}.", tree.regions[r][k])
    return sum(len(y) for x in tree.regions[:r] for y in x) + sum(map(len, tree.regions[r][:k])) + s


def rows_of(spark, tree, grown=None, n=3000):
    df = spark.createDataFrame([(i, f"t{i}", "x", 1, 2) for i in range(n)], SCHEMA)
    return shard.assign(df, tree, grown).collect()


def test_growth_moves_rows_only_into_the_new_shard(spark):
    rows = rows_of(spark, shard.TREE, shard.TREE.grown())
    assert all(r.shard == brute(r.doc_id, shard.TREE) for r in rows)
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    moved = sum(r.grown_shard == 24 for r in rows)
    assert 3000 / 25 * 0.6 < moved < 3000 / 25 * 1.4
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) < 2 * 3000 / 24
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_weights_confine_movement(spark):
    uneven = shard.Tree((((1.0, 3.0), (0.0,)), ((2.0,), (1.0, 1.0))))
    more = uneven.reweighted(1, 0, 0, 4.0)
    a, b = ({r.doc_id: r.shard for r in rows_of(spark, t)} for t in (uneven, more))
    assert a == {i: brute(i, uneven) for i in a}
    assert 2 not in a.values()
    share = Counter(a.values())
    assert abs(share[1] / share[0] - 3) < 0.6
    region = lambda s: 0 if s < 3 else 1
    assert all(a[i] == b[i] or region(b[i]) == 1 for i in a)
    assert not any(region(a[i]) == 1 and region(b[i]) == 0 for i in a)


def test_edge_rows(spark, tmp_path):
    long = "é" * 200000
    rows = [(None, None), (None, "a"), (1, ""), (2, long), (3, "x"), (3, "x"), (3, "x"), (3, "y")]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA)
    got = shard.assign(df, shard.TREE).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (d, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in rows
    )
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard is None for r in got)
    assert shard.assign(df.limit(0), shard.TREE).collect() == []
    shard.write_shards(df.drop("shard"), shard.TREE, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
