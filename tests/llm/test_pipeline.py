"""The pipeline against plain Python, stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_llm import grams, links, measured, removed, split

from voxloom.llm import quality_classifier


def by_stage(spark, docs, sf):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def check(spark, docs, sf):
    steps = by_stage(spark, docs, sf)
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps[:5]]
    order = lambda rs: sorted(rs, key=str)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = quality_classifier._scores([t for _, t in rows[0]], model)
    assert order(rows[1]) == order([r for r, s in zip(rows[0], scores) if s >= 0.7])

    def clean(text):
        n, chars, symbols, *_, repeat = measured(text)
        upper = sum(c.isupper() for c in text or "")
        return n >= 50 and 2 * repeat <= n and 10 * symbols <= n and 2 * upper <= chars
    assert order(rows[2]) == order([r for r in rows[1] if clean(r[1])])
    gone = {i for i, c, _ in links(rows[2]) if i != c}
    assert order(rows[3]) == order([r for r in rows[2] if r[0] not in gone])
    texts = dict(rows[3])
    counts = {i: (n, k) for i, n, k, _ in removed(rows[3], 20)}
    assert len(rows[4]) == len(rows[3])
    for i, text in rows[4]:
        n, k = counts[i]
        assert (text == texts[i]) if k == 0 else len(split(text)) == n - k
    assert steps[4].where((F.col("n_chars") != F.char_length("text")) & F.col("text").isNotNull()).count() == 0
    assert {r.doc_id for r in steps[5].select("doc_id").collect()} == {i for i, _ in rows[4]}
    return rows


def test_pipeline_on_a_table(spark, sf):
    rows = check(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert len(rows[0]) > len(rows[1]) > len(rows[2]) > len(rows[3]) > 50


def test_pipeline_on_odd_rows(spark, odd, sf):
    check(spark, odd.dropDuplicates(["doc_id"]), sf)


def test_one_row_of_each_group_stays(spark, sf):
    a, b, c = (" ".join(f"{s}{k}" for k in range(60)) for s in "abc")
    rows = [(None, a), (None, a), (None, a + " x"), (1, b), (1, b), (2, b), (2, c), (3, ""), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_duplicate_filter(spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert len(got) == 6 and [t for i, t in got if i is None and t][0] in (a, a + " x")
    assert [r for r in got if r[0] is not None] == [(1, b), (2, c), (3, "")]


def test_pipeline_on_no_rows(spark, none, sf):
    assert all(s.count() == 0 for s in by_stage(spark, none, sf))


def test_run(spark, sf):
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.count() > 0 and pieces.columns[:3] == ["doc_id", "start", "length"]
    assert grams("a b") == {("a", "b")}


def test_columns_of_any_name_come_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    names = ["row", "_row", "__row", "other", "rule_n_words", "uid", "none", "n_removed"]
    wide = docs.withColumns({n: F.lit(n) for n in names})
    for frame in (docs, wide):
        steps = by_stage(spark, frame, sf)
        assert all(s.columns == frame.columns for s in steps[:5]) and steps[4].count() > 50
    assert all(r[n] == n for r in steps[4].collect() for n in names)
