import random
from collections import defaultdict

from pyspark.sql import functions as F

from spoor.llm import linedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, line string, dropped int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "s", 0, 1, "l", 2) for i, t in rows], SCHEMA)


def shingles(line):
    return {line[i : i + 10] for i in range(max(1, len(line) - 9))}


def brute(rows):
    """(id, text) -> the line numbers to drop, by comparing all pairs of lines."""
    docs = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
    lines = [(d, t, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\n\f\v")]
    parent, sets, text = {}, {}, {}
    for *_, x in lines:
        parent.setdefault(x, x)
        sets[x] = shingles(x)
    names = sorted(parent)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for x in names:
        for s in sets[x]:
            by[s].add(x)
    for x in names:
        for y in {y for s in sets[x] for y in by[s] if y > x}:
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    first, out = {}, defaultdict(list)
    for d, t, i, x in lines:
        if first.setdefault(find(x), (d, t, i)) != (d, t, i):
            out[d, t].append(i)
    return out


def test_recall_against_all_pairs(spark):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("abcdeéfghij") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    bases = [make(rnd.choice([4, 12, 40, 60])) for _ in range(150)]
    rows = []
    for i in range(300):
        out = []
        for _ in range(4):
            words = rnd.choice(bases).split(" ") if rnd.random() < 0.6 else make(20).split(" ")
            for _ in range(rnd.randrange(3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            out.append(" ".join(words))
        rows.append((i, "\n".join(out)))
    want = {(d, i) for (d, _), ns in brute(rows).items() for i in ns}
    got = {(r.doc_id, i) for r in linedup.dropped_lines(frame(spark, rows)).collect() for i in r.dropped}
    assert len(want) > 300
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.03 * len(want)  # where a missed link leaves two first lines


def test_edge_rows(spark):
    long = "\n".join(f"line number {i} says something of its own {i * 7919}" for i in range(4000))
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "a\nb\na"), (5, "b"), (6, "one line that is on its own here"), (7, "One line that is on its own here!\nkeep me"), (8, long), (8, long), (None, "a\nnew"), (None, "a\nnew"), (9, "ünïcödé line, quite long, is here\nx"), (10, "\t \n\t \nten"), (11, "\t \nten")]
    df = frame(spark, rows)
    got = {(r.doc_id, i) for r in linedup.dropped_lines(df).collect() for i in r.dropped}
    want = {(d, i) for (d, _), ns in brute(rows).items() for i in ns}
    assert {x for x in got if x[0] != 8} == {x for x in want if x[0] != 8}
    out = linedup.dedup_lines(df)
    assert out.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in out.collect() if r.doc_id != 8), key=str)
    assert texts == sorted([(1, None), (2, ""), (3, "\n \n"), (4, "a\nb"), (6, rows[5][1]), (7, rows[6][1]) if (7, 0) not in want else (7, "keep me"), (None, "new"), (None, "new"), (9, rows[-3][1]), (10, rows[-2][1])], key=str)
    assert linedup.dedup_lines(df.limit(0)).collect() == []


def test_recall_of_bands_by_line_length(spark):
    rnd = random.Random(4)
    letter = lambda: rnd.choice("abcdefghijklmnopqrstuvwxyz")
    pairs = []
    for n in (9, 18, 27, 36, 54, 108):
        for _ in range(800):
            a = "".join(letter() for _ in range(n + 9))
            b = a[: -n // 9] + "".join(letter().upper() for _ in range(n // 9))
            pairs.append((n, a, b))
    assert all(len(shingles(a) & shingles(b)) == 0.8 * len(shingles(a) | shingles(b)) for _, a, b in pairs)
    lines = spark.createDataFrame([(2 * i + k, x, 0) for i, p in enumerate(pairs) for k, x in enumerate(p[1:])], "h long, line string, place long")
    minima = {r.h: [r[f"m{i}"] for i in range(linedup.POINTS)] for r in linedup.signatures(lines).collect()}
    met = defaultdict(list)
    for i, (n, _, _) in enumerate(pairs):
        a, b = minima[2 * i], minima[2 * i + 1]
        met[n].append(any(all(a[k] == b[k] for k in band) for band in linedup.BANDS))
    shares = {n: sum(x) / len(x) for n, x in met.items()}
    assert min(shares.values()) >= 0.975, shares


def test_periodic_lines_of_any_length_meet(spark):
    units = ["-", "_", "#", "~", "- ", "Du ", "Be "]
    rows = [(2 * i + k, (u * 90)[:n].strip(" ")) for i, u in enumerate(units) for k, n in enumerate((60, 90))]
    got = {(r.doc_id, i) for r in linedup.dropped_lines(frame(spark, rows)).collect() for i in r.dropped}
    assert got == {(d, i) for (d, _), ns in brute(rows).items() for i in ns} == {(2 * i + 1, 0) for i in range(len(units))}


def test_sketches_lose_no_close_pair(spark):
    rnd = random.Random(8)
    pairs = []
    for i in range(300):
        a = [rnd.choice("abcdefgh") for _ in range(rnd.choice([12, 40, 200, 900]))]
        b = list(a)
        for _ in range(rnd.randrange(1 + len(a) // 40)):
            b[rnd.randrange(len(b))] = rnd.choice("ABC")
        pairs.append(("".join(a), "".join(b) + "x" * rnd.randrange(3)))
    texts = spark.createDataFrame([(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)], "h long, line string")
    got = linedup.sketched(texts)
    assert {r.h: r["size"] for r in got.collect()} == {2 * i + k: len(shingles(x)) for i, p in enumerate(pairs) for k, x in enumerate(p)}
    near = got.alias("a").join(got.alias("b"), F.expr("a.h + 1 = b.h and a.h % 2 = 0") & F.expr(linedup._may_be_close()))
    passed = {r.h // 2 for r in near.selectExpr("a.h as h").collect()}
    close = {i for i, (a, b) in enumerate(pairs) if len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))}
    assert close <= passed and len(close) > 50 and len(passed) < 280


def test_many_copies_give_no_pairs(spark):
    rnd = random.Random(2)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rnd.randrange(40)] = f"other{i}"
        rows.append((i, " ".join(words)))
    lines = linedup.lines_of(frame(spark, rows))
    _, comps = linedup.line_components(lines)
    sizes = [r["count"] for r in comps.groupBy("comp").count().collect()]
    assert sum(sizes) >= 396 and max(sizes) >= 396


def test_joins_of_hot_buckets_give_each_pair_once(spark, monkeypatch):
    rnd = random.Random(6)
    base, texts = [f"word{i}" for i in range(30)], []
    for i in range(160):
        words = list(base)
        for _ in range(rnd.randrange(1, 7)):
            words[rnd.randrange(30)] = f"own{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    join, shares = linedup.met, []

    def spied(rows):
        shares.append(([r.asDict() for r in rows.collect()], [tuple(r) for r in join(rows).collect()]))
        return join(rows)

    monkeypatch.setattr(linedup, "met", spied)
    linedup.line_components(linedup.lines_of(frame(spark, list(enumerate(texts)))))
    assert len(shares) == len(linedup.SHARES)
    by_hash = {r.h: shingles(r.line) for r in linedup.lines_of(frame(spark, list(enumerate(texts)))).collect()}
    asked, given, repeated = set(), 0, 0
    for rows, pairs in shares:
        got = {frozenset(p) for p in pairs}
        assert len(got) == len(pairs) and not got & asked
        asked, given = asked | got, given + len(pairs)
        buckets = defaultdict(list)
        for r in rows:
            buckets[r["key"]].append(r)
        for one in buckets.values():
            for a in one:
                for b in one:
                    repeated += a["h"] < b["h"] and frozenset((a["h"], b["h"])) in got
                    x, y = by_hash[a["h"]], by_hash[b["h"]]
                    if a["asks"] and a["comp"] != b["comp"] and len(x & y) >= 0.8 * len(x | y):
                        assert frozenset((a["h"], b["h"])) in got
    assert repeated > given > 20


def test_sifting_loses_no_row(spark):
    rows = spark.range(-3000, 3000).selectExpr("xxhash64(id) as h", "id").unionByName(spark.sql("select h, 0L as id from values (0L), (-1L), (9223372036854775807L), (-9223372036854775808L) as t(h)"))
    wanted = rows.where("id % 50 = 0").select("h")
    got = linedup.sifted(rows, wanted, "h")
    assert got.columns == rows.columns
    want, found = {r.h for r in wanted.collect()}, [r.h for r in got.collect()]
    assert want <= set(found) and len(found) == len(set(found)) < 1000
    assert linedup.sifted(rows, wanted.limit(0), "h").count() == 0


def test_documents_table(spark, sf):
    got = linedup.op2_line_dedup(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, i) for (d, _), ns in brute(rows).items() for i in ns}
    found = {(r.doc_id, int(i)) for r in got if r.dropped for i in r.dropped.split(",")}
    assert len(got) == len(rows) and all(r.n_dropped <= r.n_lines for r in got)
    assert len(found & want) >= 0.98 * len(want) and len(found - want) <= 0.02 * len(want)
