import corpus_pipeline as p
from pressroom.llm import quality
from tests.conftest import SF001, SF01
from tests.llm.plain import AWKWARD, DOCS, join_components, lines_that_go, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_compose_plainly(spark):
    """run() over a whole table against a plain version of every stage but the fitted one, whose
    decisions are read from its own operator."""
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    wanted = {r["doc_id"] for r in quality.score_documents(docs, labels).filter("keep").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in wanted]
    gone = lines_that_go(rows, 2, 30, equal_chars=1)
    left = []
    for doc, text in rows:
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get(doc, ()))
        if doc not in gone or kept.strip(" "):
            left.append((doc, kept))
    groups = {doc: c for doc, _, c in join_components(left)}
    left = [(doc, text) for doc, text in left if groups[doc] == doc]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    left = [(doc, text) for doc, text in left if not any(g and 100 * len(g & shingles(text)) >= 75 * len(g) for g in items)]
    got = p.run(spark, SF001)
    assert got.columns == [*COLUMNS, "ids", "n_ids", "round_trip"]
    got = got.collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(left)
    assert all(r["round_trip"] and r["n_chars"] == len(r["text"]) for r in got)


def test_awkward_rows_pass_every_stage(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in AWKWARD], DOCS + ", ids string, row string")
    for number, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF01)
        assert stage(spark, docs.limit(0), SF01).count() == 0
        if number < len(p.STAGES) - 1:
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in out.collect()} <= {r[0] for r in AWKWARD}


def test_stage_names():
    assert len(p.STAGES) == 5 and p.ORACLE_SQL is None
