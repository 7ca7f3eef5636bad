"""The plug-in tokenizer is handed bounded slices of the Arrow batches."""

from pyspark.sql import functions as F

from pressroom.operators import tokens


def test_slices_are_bounded_and_whole(spark):
    def split(texts):
        # a token that tells how many texts came with this one, and how long they were
        return texts.map(lambda t: [*t.split(" "), f"{len(texts)}:{texts.str.len().sum()}"])

    texts = [(i, "ab " * (i % 7) + "x") for i in range(500)] + [(500, "long " * 1000), (501, ""), (502, None)]
    df = spark.createDataFrame(texts, "id int, comments string").coalesce(1)
    read = df.select("id", tokens.pandas_tokenizer(split, slice_chars=100)(F.coalesce("comments", F.lit(""))).alias("t")).collect()
    assert [(r["id"], list(r["t"][:-1])) for r in read] == [(i, (t or "").split(" ")) for i, t in texts]
    slices = [tuple(map(int, r["t"][-1].split(":"))) for r in read]
    assert max(n for n, _ in slices) < 100
    assert all(chars < 100 + 5000 and (chars < 100 + 19 or i == 500 or n > 1) for i, (n, chars) in enumerate(slices))
    assert len(set(slices)) > 1


def test_query_holds_a_slice_of_tokens(spark, monkeypatch, tmp_path):
    """More texts than a slice holds come in several slices, and count as before."""
    from pressroom.plans import catalog_files
    spark.createDataFrame([(i, "s", "w%d common" % (i % 3), "en") for i in range(300)], "doc_id long, source string, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = []
    monkeypatch.setattr(tokens, "SLICE_CHARS", 50)
    real = tokens.pandas_tokenizer
    monkeypatch.setattr(tokens, "pandas_tokenizer", lambda split, slice_chars=50: made.append(slice_chars) or real(split, slice_chars))
    got = [tuple(r) for r in catalog_files.top_tokens_plugin(spark, str(tmp_path)).orderBy("rank").collect()]
    assert made == [50]
    assert got == [("en", 1, "common", 300), ("en", 2, "w0", 100), ("en", 3, "w1", 100), ("en", 4, "w2", 100)]
