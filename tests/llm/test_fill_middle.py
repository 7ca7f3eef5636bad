import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressroom.llm import fill_middle as fm
from pressroom.llm.queries import QUERIES
from tests.conftest import SF01
from tests.llm.plain import AWKWARD, DOCS


def plain_row(doc_id, text, seed=1):
    """Form and output by plain string slicing."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i: i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def units_of(texts):
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    return fm.Units(np.frombuffer(b"".join(raw), np.uint8), off)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=8))
def test_every_cut_of_every_text(texts):
    units = units_of(texts)
    assert units.counts.tolist() == [len(t) for t in texts]
    for k in range(max(map(len, texts)) + 1):
        at = np.array([min(k, len(t)) for t in texts])
        assert units.byte_of(at).tolist() == [len(t[:i].encode()) for t, i in zip(texts, at, strict=True)]


@pytest.mark.parametrize("length", [*range(18), 63, 64, 65])
@pytest.mark.parametrize("c", ["\0", "a", "\x7f", "é", "한", "\U0001f600"])
def test_words_filled_to_the_brim(length, c):
    units = units_of([c * length, "a", c * length])
    assert units.byte_of(np.array([length, 1, length // 2])).tolist() == [len(c.encode()) * length, 1, len(c.encode()) * (length // 2)]


def test_awkward_rows_and_long_texts(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("aé한\U0001f600 ") for _ in range(1_500_000))  # several MB, more than a slice
    more = [(20 + i, f"x<{c}>y" * 3, None, None, None) for i, c in enumerate("PSMQ")] + [(30, "<P", "", "", 0), (31, ">S><M", "", "", 0), (40, long, "", "", 0)]
    more += [(1000 + i, "<" * (i % 7) + "S" * (i % 3) + "é<M" * (i % 5), "", "", 0) for i in range(200)]
    rows = AWKWARD + more
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "form").withColumnRenamed("source", "output").repartition(3)
    done = fm.fill_in_middle(docs)
    got = done.select("*", fm.restore(done["output"], done["form"]).alias("restored")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in got) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fm.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_parameters(spark):
    docs = spark.createDataFrame([(i, "some text to cut") for i in range(300)], "doc_id long, text string")
    forms = lambda **x: {r["form"] for r in fm.fill_in_middle(docs, **x).select("form").distinct().collect()}
    assert forms(plain_from=0) == {"plain"} and forms(plain_from=100, spm_below=100) == {"spm"} and forms(plain_from=100, spm_below=0) == {"psm"}
    cuts = lambda seed: sorted(map(tuple, fm.fill_in_middle(docs, seed=seed).select("doc_id", "output").collect()))
    assert cuts(1) == cuts(1) != cuts(2)


def test_query_over_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = QUERIES["op13_fill_middle"](spark, SF01).collect()
    want = [(*(p := plain_row(*r))[:5], sha(p[5]), sha(r[1] or "")) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
