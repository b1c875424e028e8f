import corpus_pipeline
from spoor.llm import langid, sentencepiece, shared, simhash
from tests.llm import test_decontaminate, test_linedup, test_simhash

COLUMNS = list(shared.DOCUMENT_COLUMNS)


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = shared.cut(stage(spark, docs, sf), "test")
        seen[name] = (docs.collect(), out.collect())
        docs = out
        if name != "tokens":
            assert out.columns == COLUMNS
            assert out.schema == spark.read.parquet(f"{sf}/documents.parquet").schema
    was, now = seen["language"]
    assert {r.doc_id for r in was} - {r.doc_id for r in now} == {9001, 9002, 9003}
    was, now = seen["lines"]
    lost = test_linedup.brute([(r.doc_id, r.text) for r in was])
    want = {}
    for r in was:
        gone = set(lost.get((r.doc_id, r.text), ()))
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone)
        if not gone or text.strip("\n "):
            want[r.doc_id] = text
    got = {r.doc_id: r.text for r in now}
    assert sum(got.get(d) == t for d, t in want.items()) >= 0.98 * len(want)
    was, now = seen["near_duplicates"]
    comps = test_simhash.brute_components([(r.doc_id, r.text) for r in was])
    assert {r.doc_id for r in now} == {c for _, _, c in comps} and len(now) == len({c for _, _, c in comps})
    was, now = seen["benchmark"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {x.doc_id for x in now}
    first = {w for _, t in items for w in shared.words_of(t)[:1]}
    for r in was:
        few = first & set(shared.words_of(r.text))  # the slow comparison only where an item's first word stands
        _, n_hit, _ = test_decontaminate.brute(r.text, items) if few else (0, 0, [])
        bad = n_hit > 0 and 20 * n_hit >= len(shared.words_of(r.text))
        assert (r.doc_id in left) == (not bad)
    was, now = seen["tokens"]
    pieces = sentencepiece.Pieces.read()
    assert {r.doc_id: pieces.decode(r.ids) for r in now} == {r.doc_id: r.text for r in was}
    assert all(r.round_trip for r in now)
    assert langid.LEAST_SCORE == 0.5 and simhash.MAX_BITS == 3


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and out.count() > 50


def test_stages_take_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 0")
    odd = docs.unionByName(docs.limit(20)).selectExpr("*", "1 as h", "'x' as _id", "2 as place", "text as line")
    empty = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).collect() == [], name
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        n = out.count()
        assert 0 < n <= odd.count(), name
    assert corpus_pipeline.tokens(spark, empty, sf).collect() == []
    assert corpus_pipeline.tokens(spark, odd, sf).count() == odd.count()
