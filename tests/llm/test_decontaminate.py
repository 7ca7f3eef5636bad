import random

import pytest

from pressroom.llm import decontaminate as d
from tests.llm.plain import AWKWARD, DOCS, shingles


def test_sketch_finds_all_that_verification_would():
    for n in range(1, 400):
        missing = n - d.need(n, 0.75)
        assert d.sketch_length(n, 0.75) > missing or d.sketch_length(n, 0.75) >= n


@pytest.mark.parametrize("threshold,block", [(0.75, 20_000), (0.75, 2), (0.4, 20_000), (1.0, 20_000)])
def test_against_a_plain_search(spark, threshold, block):
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 30, 60])))) for i in range(30)]
    items += [(90, None), (91, ""), (92, items[3][1].upper()), (93, "one two three")]
    docs = [r[:2] for r in AWKWARD] + [(200, "One two THREE")]
    for i in range(20, 100):
        words = [word() for _ in range(rng.randint(0, 200))]
        mine = rng.choice(items[:30])[1].split()
        if rng.random() < 0.7:
            for _ in range(rng.choice([0, 0, 1, 3])):
                mine[rng.randrange(len(mine))] = word()
            words[5:5] = mine
        docs.append((i, " ".join(words)))
    got = d.find_contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                              spark.createDataFrame(items, "item_id long, text string"), threshold, block).collect()
    want = set()
    for doc, text in docs:
        s = shingles(text)
        for item, t in items:
            g = shingles(t)
            if g and len(g & s) >= threshold * len(g) - 1e-9:
                want.add((doc, item, len(g & s), len(g)))
    assert {tuple(r)[:4] for r in got} == want and len(want) > 5


def test_filter_keeps_clean_rows_and_columns(spark):
    items = spark.createDataFrame([(1, AWKWARD[0][1]), (2, None)], "item_id long, text string")
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("lang", "row").withColumnRenamed("source", "doc")
    left = d.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] not in (1, 5))
    assert d.decontaminate(docs, items.limit(0)).count() == len(AWKWARD)
    assert d.decontaminate(docs.limit(0), items).count() == 0


def test_short_items_in_long_documents(spark):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "gamma"), (3, "one two three four"), (4, "a b c d e"), (5, "beta alpha")], "item_id long, text string")
    docs = [(1, "x y z alpha BETA and more"), (2, "alpha x beta y gamma z w"), (3, "zero one two three four five"), (4, "gammas a b c d x e"),
            (5, "alpha beta"), (6, "x a b c d e y"), (7, None), (8, "beta")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = d.find_contaminated(frame, items, short_items=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 1, 1), (5, 1, 1, 1), (6, 4, 1, 1)]
    assert sorted(r["doc_id"] for r in d.decontaminate(frame, items, short_items=True).collect()) == [4, 7, 8]
