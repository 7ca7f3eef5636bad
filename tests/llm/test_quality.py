import numpy as np

from pressroom.llm import quality
from tests.conftest import SF01
from tests.llm.plain import AWKWARD, DOCS

SF1 = SF01.replace("sf0.01", "sf0.1")


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    # trained without the labels of every fourth document, judged on these
    scored = quality.score_documents(docs, labels.filter("doc_id % 4 <> 0"))
    out = scored.join(labels.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    wanted = (out.quality == 1) & (out.toxic != 1)
    assert out[wanted].keep.mean() > 0.98  # clean documents stay
    assert out[~wanted].keep.mean() < 0.2  # the others go
    assert scored.count() == docs.count()


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    n, pool = 200, 400
    y = (rng.random(n + pool) < 0.5).astype(float)
    words = [np.unique(np.where(rng.random(30) < 0.7, 100 * int(v) + rng.integers(0, 40, 30), rng.integers(300, 900, 30))) for v in y]
    meta = [np.array([2000 + int(v if rng.random() < 0.9 else 1 - v)]) for v in y]
    flat = np.zeros((n + pool, 1))
    text, page = quality.Rows(words, flat), quality.Rows(meta, flat)
    first, rest = np.arange(n), np.arange(n, n + pool)
    fitted = quality.co_train(text.take(first), page.take(first), y[:n], text.take(rest), page.take(rest), rounds=2, confident=0.9)
    a, b, stack = fitted
    z = np.column_stack((a.logits(text.take(rest)), b.logits(page.take(rest)))) @ stack[:2] + stack[2]
    assert ((z > 0) == (y[n:] == 1)).mean() > 0.88


def test_awkward_rows_and_labels(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("n_chars", "score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score_documents(docs, none).collect()
    assert len(got) == len(AWKWARD) and all(r["score"] == 1.0 and r["keep"] for r in got)
    one_kind = spark.createDataFrame([(1, 1, None), (1, None, 0), (None, 0, 0), (3, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, one_kind).filter("keep").count() == len(AWKWARD)
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    more = docs.unionAll(spark.createDataFrame([(i, ("good words here " if i % 2 else "BAD STUFF!! ") * 20, "en", "s", 1) for i in range(10, 60)], docs.schema))
    kept = quality.keep_wanted(more, both)
    assert kept.columns == more.columns and {r["doc_id"] for r in kept.collect() if (r["doc_id"] or 0) >= 10} == set(range(11, 60, 2))
    assert quality.keep_wanted(docs.limit(0), both).count() == 0


def test_labels_of_other_tables_take_no_room(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "BAD STUFF!! ") * 20, "en", "s", 1) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    kept = quality.keep_wanted(docs, labels, max_labelled=60)
    assert {r["doc_id"] for r in kept.collect()} == set(range(1, 60, 2))
