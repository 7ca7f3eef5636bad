import random

import pytest
import sentencepiece

from pressroom.llm import sentencepiece_codec as codec
from pressroom.llm.queries import QUERIES
from tests.conftest import SF001
from tests.llm.plain import AWKWARD, DOCS

PIECES = ["a", "b", "the", "ing", "  ", " ", "\n", "é", "日", "x", "ｆ", "aaa", "ab", "1", "2", ".", " a", "\U0001f600", "er", "on", "\t", "!!", "    "]


@pytest.fixture(scope="module")
def vocabulary():
    return codec.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)


@pytest.mark.parametrize("lockstep", [True, False])
def test_ids_equal_the_library(vocabulary, library, lockstep):
    own = codec.Codec(vocabulary, "bpe", codec.lockstep_tables(vocabulary) if lockstep else None)
    assert own.cuts and (not lockstep or own.tables is not None)
    rng = random.Random(8)
    texts = ["", None, " ", "ab" * 4000, "the" * 999 + "日" * 50, " " * 100, "▁x▁y"] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    for text, ids in zip(texts, own.encode_many(texts), strict=True):
        assert ids.tolist() == library.encode(text or "")
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())
        if "▁" not in (text or ""):
            assert own.decode(ids.tolist()) == (text or "")


def test_the_window_stays_bounded(vocabulary, library):
    own = codec.Codec(vocabulary, "bpe")
    text = "▁" + "abcabd" * 3000
    parts = list(own.stream(text))
    assert len(parts) > 100 and max(map(len, parts)) <= 40 * own.max_piece
    assert [i for p in parts for i in p] == library.encode("abcabd" * 3000)


def test_unigram_finds_the_best_sum():
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)} | {"a", "b"})
    vocabulary = [("<unk>", 0.0, "unknown")] + [(p, -rng.random() * 10 * len(p), "normal") for p in pieces]
    own = codec.Codec(vocabulary, "unigram")
    score = {p: s for p, s, _ in vocabulary[1:]}
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 120)))
        best = [0.0] + [-1e18] * len(text)
        for j in range(1, len(text) + 1):
            best[j] = max([best[i] + score[text[i:j]] for i in range(max(0, j - 4), j) if text[i:j] in score]
                          + ([best[j - 1] + own.worst] if text[j - 1] not in score else []))
        ids = [i for part in own.stream(text) for i in part]
        assert sum(score[vocabulary[i][0]] if i else own.worst for i in ids) == pytest.approx(best[-1])


def test_documents(spark, library):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumnRenamed("lang", "ids")
    got = codec.encode_documents(docs).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "") and r["n_ids"] == len(r["ids"]) and r["round_trip"]
    assert codec.encode_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equals_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = QUERIES["op3_sentencepiece"](spark, SF001).collect()
    assert len(got) == len(texts) and all(r["round_trip"] and r["ids"] == library.encode(texts[r["doc_id"]]) for r in got)
