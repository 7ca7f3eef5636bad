import random

import pytest

from pressroom.llm import line_dedup
from pressroom.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.plain import AWKWARD, DOCS, NULL_ID, edit_distance, lines_that_go


def mutate(rng, text, times):
    s = list(text)
    for _ in range(times):
        i = rng.randint(0, len(s))
        s[i:i + rng.choice([0, 1])] = rng.choice(["", "a", "é"])
    return "".join(s)


@pytest.mark.parametrize("edits", [0, 1, 2, 4, 15])
def test_banded_distance(edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("a", ""), ("", "abc")]
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        pairs.append((a, mutate(rng, a, rng.randint(0, edits + 3))))
    assert line_dedup.within(pairs, edits).tolist() == [edit_distance(a, b) <= edits for a, b in pairs]


@pytest.mark.parametrize("edits,least,hot", [(2, 6, 4096), (1, 6, 4096), (2, 10, 3), (0, 5, 2)])
def test_against_all_pairs(spark, edits, least, hot):
    rng = random.Random(edits * 10 + hot)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 25))) for _ in range(20)]
    rows = [(i, "\n".join(mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 7)))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, base[0] + "\n" + base[1]), (102, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = line_dedup.dedup_lines(docs, report=True, max_edits=edits, min_chars=least, hot=hot).collect()
    want = lines_that_go(rows, edits, least)
    assert {(NULL_ID if r["doc_id"] is None else r["doc_id"]): r["removed_lines"] for r in got if r["removed_lines"]} == want
    text = dict(rows)
    for r in got:
        gone = set(r["removed_lines"])
        assert r["text"] == (text[r["doc_id"]] if not gone else "\n".join(x for i, x in enumerate(text[r["doc_id"]].split("\n")) if i not in gone))


@pytest.mark.parametrize("edits,hot", [(2, 4096), (0, 2)])
def test_equal_lines_of_every_length(spark, edits, hot):
    rng = random.Random(edits + 40)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 20))) for _ in range(20)] + ["", "  ", "All rights reserved."]
    rows = [(i, "\n".join(mutate(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(0, 7)))) for i in range(40)]
    rows += [(100, None), (101, "a"), (102, "a\n\n"), (None, "All rights reserved.")]
    want = lines_that_go(rows, edits, 10, equal_chars=1)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), report=True,
                                 max_edits=edits, min_chars=10, hot=hot, equal_chars=1).collect()
    assert {(NULL_ID if r["doc_id"] is None else r["doc_id"]): r["removed_lines"] for r in got if r["removed_lines"]} == want
    only_short = spark.createDataFrame([(1, "a\nb"), (2, "a")], "doc_id long, text string")
    got = line_dedup.dedup_lines(only_short, report=True, equal_chars=1).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == {1: [], 2: [0]}


def test_awkward_rows(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("lang", "uid").withColumnRenamed("source", "n_lines")
    plain = line_dedup.dedup_lines(docs, max_edits=2, min_chars=30)
    assert plain.columns == docs.columns and sorted(map(str, plain.collect())) == sorted(map(str, docs.collect()))
    assert line_dedup.dedup_lines(docs.limit(0), report=True).count() == 0


def test_query_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_line_dedup"](spark, SF001).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["removed_lines"] for r in got if r["removed_lines"]} == lines_that_go(rows, 2, 30, equal_chars=1)
