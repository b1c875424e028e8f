import re

import pytest
import xxhash

from spoor.llm import shared, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, comp string"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_matches_brute_force_on_documents(spark, sf):
    got = simhash.op4_simhash(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "One two"), (5, "one TWO"), (6, long), (6, long), (7, long + " tail"), (None, "one two"), (None, "only here é"), (9, "É a b"), (10, "é a b")]
    df = spark.createDataFrame([(d, t, "x", "y", 0, "f", "k", "c") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute_components(rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text[:11] if r.text else r.text) for r in kept.collect()), key=str) == sorted(
        [(1, None), (4, "One two"), (6, long[:11]), (None, "only here é"), (9, "É a b"), (10, "é a b")], key=str
    )


def test_one_id_in_several_components(spark):
    a, b = "the quick brown fox jumps over the lazy dog", "an entirely different sentence about other things"
    for rows in ([(1, a), (2, a), (2, b)], [(2, b), (2, a), (1, a)]):
        df = spark.createDataFrame([(d, t, "x", "y", 0, "f", "k", "c") for d, t in rows], SCHEMA)
        assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(1, a), (2, b)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one(df).collect() == []


@pytest.mark.parametrize("big", [2, 64])
def test_dense_group_keeps_every_link(spark, big):
    import random

    rnd = random.Random(5)
    base, prints = 0x0123456789ABCDEF, set()
    while len(prints) < 700:
        x = base
        for _ in range(rnd.randrange(7)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    prints |= {rnd.getrandbits(64) for _ in range(300)}
    prints = sorted(x - 2**64 if x >= 2**63 else x for x in prints)
    got = {r.node: r.comp for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"), big).collect()}
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(prints):
        for y in prints[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in prints} == {x: find(x) for x in prints}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 499), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in shared.components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 499: 499, 500: 499}
