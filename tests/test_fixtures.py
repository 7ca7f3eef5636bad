"""Worked cases F1-F16 of FIXTURES.md."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pressroom.functions.text import has_text, regex_tokens
from pressroom.operators import articles, boxstats, clean, groups, profile, scores, shares, timeprofile, tokens, visibility
from pressroom.sources import links, payload, press_tree, sink
from pressroom.streaming import ingest


def _tmp():
    return tempfile.mkdtemp(prefix="pressroom-test-")


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


# ---------------------------------------------------------------- F1-F4 press tree ingest
def test_f1_csv_text(spark):
    root = _tmp()
    body = ('user_nickname,comments\n'
            'u1,"a\nb"\n'
            'u2,"say ""hi"", x"\n'
            'u3,NA\n'
            'u4,null\n'
            'u5,\n'
            'u6,None\n'
            'u7,""\n'
            'u8, pad \n')
    _write(f"{root}/P/2024-12-05_P_t.csv", body.encode("utf-8"))
    rows, rejects = press_tree.ingest_press_tree(spark, root, extra_columns=True)
    got = [r.comments for r in rows.orderBy("row_no").collect()]
    assert got == ["a\nb", 'say "hi", x', None, None, None, None, None, " pad "]
    assert rejects.count() == 0


def test_f2_encodings(spark):
    root = _tmp()
    text = "press_name_col,n\n조선일보,1\n"
    _write(f"{root}/A/2024-12-05_A_u.csv", text.encode("utf-8"))
    _write(f"{root}/B/2024-12-05_B_c.csv", text.encode("cp949"))
    _write(f"{root}/C/2024-12-05_C_e.csv", text.encode("euc-kr"))
    _write(f"{root}/D/2024-12-05_D_bad.csv", b"a,b\n\xff\xfe\xfa,1\n")
    rows, rejects = press_tree.ingest_press_tree(spark, root, extra_columns=True)
    got = sorted((r.press_name, r.press_name_col, r.n) for r in rows.collect())
    assert got == [("A", "조선일보", "1"), ("B", "조선일보", "1"), ("C", "조선일보", "1")]
    rej = rejects.collect()
    assert len(rej) == 1 and rej[0].reason == "undecodable" and rej[0].path.endswith("bad.csv")


def test_f3_headers_bind_by_name(spark):
    root = _tmp()
    _write(f"{root}/P/2024-12-05_P_1.csv", b"a,b\n1,2\n")
    _write(f"{root}/P/2024-12-06_P_2.csv", b"b,a\n3,4\n")
    _write(f"{root}/P/2024-12-07_P_3.csv", b"a,c\n5,6\n")
    rows, _ = press_tree.ingest_press_tree(spark, root, columns=(("a", "bigint"), ("b", "bigint")), extra_columns=True)
    got = sorted((r.a, r.b, r.c) for r in rows.collect())
    assert got == [(1, 2, None), (4, 3, None), (5, None, "6")]


def test_f4_file_names(spark):
    root = _tmp()
    _write(f"{root}/X/2024-12-05_X_t.csv", b"comments\nhello\n")
    _write(f"{root}/X/notes.csv", b"comments\nskip\n")
    _write(f"{root}/into.txt", b"log line\n")
    rows, rejects = press_tree.ingest_press_tree(spark, root, extra_columns=True)
    r = rows.collect()
    assert [(x.press_name, x.date, x.comments) for x in r] == [("X", "2024-12-05", "hello")]
    rej = rejects.collect()
    assert len(rej) == 1 and rej[0].path.endswith("notes.csv")
    assert press_tree.files_per_press(rows).collect()[0].n_files == 1
    assert rows.select(press_tree.day_of_file(F.col("file_name")).alias("d")).first().d == "05"


def test_month_pruning_and_korean_names(spark):
    root = _tmp()
    _write(f"{root}/조선일보/2024-12-05_조선일보_제목.csv", b"comments\nx\n")
    _write(f"{root}/조선일보/2025-01-05_조선일보_제목.csv", b"comments\ny\n")
    rows, _ = press_tree.ingest_press_tree(spark, root, months=["2024-12"], with_title=True)
    got = [(r.press_name, r.date, r.title, r.comments) for r in rows.collect()]
    assert got == [("조선일보", "2024-12-05", "제목", "x")]


# ---------------------------------------------------------------- F5 payload pages
def _page(n, start=0):
    items = ",".join('{"userName":"u%d","contents":"c%d","visible":true,"sympathyCount":%d}' % (i, i, i)
                     for i in range(start, start + n))
    return '_callback({"result":{"commentList":[%s]}});' % items


def test_f5_payload(spark):
    rows = [("a1", 1, _page(100)), ("a1", 2, _page(40, 100)),
            ("a2", 1, _page(100)), ("a2", 2, '_callback({"result":{}});'),
            ("a3", 1, '_callback({"result":{"commentList":[]}});')]
    df = spark.createDataFrame(rows, "object_id string, page long, payload string")
    exploded = payload.explode_payload(df)
    counts = {r.object_id: r.n for r in exploded.groupBy("object_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"a1": 140, "a2": 100}
    rep = {r.object_id: (r.n_rows, r.complete) for r in payload.page_report(df).collect()}
    assert rep == {"a1": (140, True), "a2": (100, True), "a3": (0, False)}
    first = exploded.filter("object_id = 'a1' and page = 2 and pos = 0").first()
    assert first.user_nickname == "u100" and first.sympathyCount == 100 and first.visible is True


# ---------------------------------------------------------------- F6 time
def test_f6_time(spark):
    df = spark.createDataFrame([("2024-12-05T00:30:15+0900",), ("bad",), (None,)], "regTime string")
    parts = timeprofile.time_parts(df, "regTime").collect()
    p = parts[0]
    assert (p.hour, p.weekday, p.year_month, p.regTime) == (0, "Thursday", "2024-12", dt.datetime(2024, 12, 5, 0, 30, 15))
    assert parts[1].hour is None and parts[1].year_month is None
    cut = spark.createDataFrame([("2025-04-30T00:00:00+0900",), ("2025-04-30T00:00:01+0900",),
                                 ("2025-04-29T23:59:59",), ("bad",), (None,)], "regTime string")
    kept = [r.regTime for r in clean.filter_period(cut, "regTime", cutoff="2025-04-30").orderBy("regTime").collect()]
    assert kept == [dt.datetime(2025, 4, 29, 23, 59, 59), dt.datetime(2025, 4, 30, 0, 0, 0)]
    whole_day = clean.filter_period(cut, "regTime", cutoff="2025-04-30", inclusive_day=True).count()
    assert whole_day == 3


# ---------------------------------------------------------------- F7 shares
def test_f7_emotion_share(spark):
    df = spark.createDataFrame([("2024-12-X", "1", "1"), ("2024-12-X", "3", "5"), ("2025-01-Y", "0", "0"),
                                ("2025-1-Z", "x", "2")], "`Year-Month-Media` string, e1 string, e2 string")
    long = shares.emotion_share(df, ["e1", "e2", "missing"])
    got = sorted((r["Year-Month-Media"], r.Emotion_Type, r.Score, r.Ratio) for r in long.collect())
    assert ("2024-12-X", "e1", 1.0, 10.0) in got and ("2024-12-X", "e2", 5.0, 50.0) in got
    assert ("2025-01-Y", "e1", 0.0, 0.0) in got and ("2025-1-Z", "e1", 0.0, 0.0) in got
    assert ("2025-1-Z", "e2", 2.0, 100.0) in got
    by_month = {(r["Year-Month"], r.Emotion_Type): r.m for r in
                long.groupBy("Year-Month", "Emotion_Type").agg(F.avg("Ratio").alias("m")).collect()}
    assert by_month[("2024-12", "e1")] == 20.0 and by_month[("2024-12", "e2")] == 30.0
    assert by_month[("2025-1", "e2")] == 100.0
    g = shares.group_month_share(long, {"G": ["X", "Y", "Z"]}, order=["e1", "e2"], zero_pad=True).collect()
    merged = {(r["Year-Month"], r.Emotion_Type): (r.mean_ratio, r.start) for r in g if r.group == "G"}
    assert merged[("2025-01", "e1")] == (0.0, 0.0) and merged[("2025-01", "e2")] == (50.0, 0.0)
    assert merged[("2024-12", "e1")] == (20.0, 0.0) and merged[("2024-12", "e2")] == (30.0, 20.0)
    dup = shares.duplicate_keys(df).collect()
    assert [(r["Year-Month-Media"], r.n_rows) for r in dup] == [("2024-12-X", 2)]


def test_conform_bad_keys(spark):
    df = spark.createDataFrame([("2025-1-Z", "1"), ("bad", "2")], "`Year-Month-Media` string, e1 string")
    got = {r["Year-Month-Media"]: (r["Year-Month"], r.Media_Outlet, r.bad_key) for r in
           shares.conform_summary(df, ["e1"]).collect()}
    assert got == {"2025-1-Z": ("2025-01", "Z", False), "bad": (None, None, True)}


# ---------------------------------------------------------------- F8 month to date
class NumberScorer:
    """Test scorer: the comment text is its own score."""
    labels = ["s"]

    def __call__(self, text):
        return F.array(text.try_cast("double"))


def test_f8_month_to_date(spark):
    df = spark.createDataFrame([("P", "2024-12", "f1", "0.5"), ("P", "2024-12", "f1", "0.5"),
                                ("P", "2024-12", "f2", "9"), ("P", "2024-12", "f3", "  "),
                                ("P", "2024-12", "f0", None)],
                               "press_name string, month string, file_name string, comments string")
    mtd = {r.file_name: r.s for r in scores.mean_scores(df, NumberScorer()).collect()}
    assert mtd["f0"] is None and mtd["f1"] == 0.5
    assert mtd["f2"] == pytest.approx(10 / 3, abs=1e-6) and mtd["f3"] == pytest.approx(10 / 3, abs=1e-6)
    per_file = {r.file_name: r.s for r in scores.mean_scores(df, NumberScorer(), scope="file").collect()}
    assert per_file == {"f0": None, "f1": 0.5, "f2": 9.0, "f3": None}
    month = scores.mean_scores(df, NumberScorer(), scope="month").collect()
    assert month[0].s == pytest.approx(10 / 3, abs=1e-6) and month[0].n_comments == 3


def test_pandas_scorer_plugin(spark):
    sc = scores.pandas_scorer(lambda texts: [[len(t) / 10.0, 0.5] for t in texts], ["len", "half"])
    df = spark.createDataFrame([("P", "m", "f", "abcd"), ("P", "m", "f", "ab")],
                               "press_name string, month string, file_name string, comments string")
    r = scores.mean_scores(df, sc, scope="file").first()
    assert r.len == pytest.approx(0.3) and r.half == 0.5
    top = scores.top_emotions(scores.mean_scores(df, sc, scope="month"), ["len", "half"], ["press_name", "month"], k=1)
    assert [(x.emotion, x.rank) for x in top.collect()] == [("half", 1)]


# ---------------------------------------------------------------- F9 box stats
def test_f9_box_stats(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 50, None]
    df = spark.createDataFrame([("A", v) for v in vals], "g string, v long")
    r = boxstats.box_stats(df, "g", ["v"]).first()
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.n_outliers, r.n) == (3, 5, 7, 1, 8, 1, 9)
    approx = boxstats.box_stats(df, "g", ["v"], exact=False).first()
    assert approx.n == 9 and approx.n_outliers == 1


# ---------------------------------------------------------------- F10 visibility
def test_f10_visibility(spark):
    df = spark.createDataFrame([("A", True), ("A", True), ("A", False), ("B", True), ("B", None), (None, True)],
                               "press_name string, visible boolean")
    overall = {r.visible: (r.n_comments, r.pct) for r in visibility.visibility_ratio(df).collect()}
    assert overall == {True: (4, 80.0), False: (1, 20.0)}
    per = {r.press_name: (r.hidden_ratio, r.shown_ratio) for r in visibility.visibility_ratio(df, "press_name").collect()}
    assert per["A"] == pytest.approx((1 / 3, 2 / 3)) and per["B"] == (0.0, 1.0) and None not in per


# ---------------------------------------------------------------- F11 tokens, F13 blank
def test_f11_tokens(spark):
    df = spark.createDataFrame([("g", "b a b a c")], "grp string, comments string")
    top = [(r.word, r.n) for r in tokens.top_tokens(df, "grp", n=2, min_len=1).orderBy("rank").collect()]
    assert top == [("a", 2), ("b", 2)]
    t = spark.createDataFrame([("Éa b, 조선일보 x1 the",)], "s string")
    assert t.select(regex_tokens("s").alias("x")).first().x == ["Éa", "b", "조선일보", "x", "the"]
    kept = tokens.tokenize(t, "s", stopwords=[]).first().tokens
    assert kept == ["Éa", "조선일보", "the"]
    totals = tokens.token_totals(df, "grp", min_len=1).first()
    assert (totals.n_tokens, totals.n_comments) == (5, 1)


def test_f13_blank(spark):
    df = spark.createDataFrame([("\t\n 　",), ("x",), (None,)], "c string")
    assert [r.b for r in df.select(has_text("c").alias("b")).collect()] == [False, True, None]


# ---------------------------------------------------------------- F12 groups
def test_f12_groups(spark):
    df = spark.createDataFrame([("조선일보",), ("한겨레",), ("한겨례",), ("Z",)], "press_name string")
    g = {"group 1": ["조선일보"], "group 2": ["한겨례"]}
    got = {r.press_name: r.group for r in groups.assign_group(df, g).collect()}
    assert got == {"조선일보": "group 1", "한겨레": "other", "한겨례": "group 2", "Z": "other"}
    assert [r.press_name for r in groups.unlisted_outlets(df, g).collect()] == ["Z", "한겨레"]


# ---------------------------------------------------------------- F14 numbers
def test_f14_numbers(spark):
    df = spark.createDataFrame([("x",), ("1e2",), (" 3 ",), ("",), (None,), ("1,000",)], "v string")
    got = [r.d for r in df.select(F.col("v").try_cast("double").alias("d")).collect()]
    assert got == [None, 100.0, 3.0, None, None, None]


# ---------------------------------------------------------------- F15 increment (batch + stream)
def _fetches(spark, keys, seq0=0):
    return spark.createDataFrame([("2024-12-05", "P", f"t{k}", seq0 + i, f"c{i}") for i, k in enumerate(keys)],
                                 "date string, press_name string, title string, fetch_seq long, comments string")


def test_f15_increment_batch(spark):
    out = os.path.join(_tmp(), "sink")
    assert sink.write_new_articles(_fetches(spark, [1, 1, 2]), out) == 1 + 1  # key 1 first fetch, key 2
    assert sink.write_new_articles(_fetches(spark, [2, 3], seq0=10), out) == 1
    titles = sorted(r.title for r in spark.read.parquet(out).select("title").distinct().collect())
    assert titles == ["t1", "t2", "t3"]


def test_f15_increment_stream_equals_batch(spark):
    base = _tmp()
    src, out, ck, aud = (os.path.join(base, x) for x in ("src", "sink", "ck", "audit"))
    schema = "date string, press_name string, title string, fetch_seq long, comments string"
    _fetches(spark, [1, 1, 2]).write.parquet(os.path.join(src, "b1"))
    ingest.stream_ingest(spark, src + "/*", out, ck, schema, audit=aud)
    _fetches(spark, [2, 3], seq0=10).write.parquet(os.path.join(src, "b2"))
    ingest.stream_ingest(spark, src + "/*", out, ck, schema, audit=aud)
    titles = sorted(r.title for r in ingest.read_sink(spark, out).select("title").distinct().collect())
    assert titles == ["t1", "t2", "t3"]
    written = [r.n_written for r in ingest.batch_audit(spark, aud).collect()]
    assert written == [2, 1]


# ---------------------------------------------------------------- F16 article key
def test_f16_article_key(spark):
    df = spark.createDataFrame([("https://n.example.com/article/023/0001?sid=1", "a/b:c?", "2024-12-05"),
                                ("short", "t", "2024-12-05")], "url string, title string, day string")
    idx = articles.article_index(df).collect()
    assert len(idx) == 1
    r = idx[0]
    assert (r.press_id, r.article_id, r.object_id, r.safe_title) == ("023", "0001", "news023,0001", "a_b_c_")
    assert r.file_name == "2024-12-05_023_a_b_c_.csv"
    assert articles.article_rejects(df).count() == 1


def test_raw_path_names(spark):
    root = _tmp()
    _write(f"{root}/조선 일보/2024-12-05_x_50%off+1.csv", b"comments\nz\n")
    rows, _ = press_tree.ingest_press_tree(spark, root, with_title=True)
    r = rows.first()
    assert (r.press_name, r.title, r.comments) == ("조선 일보", "50%off+1", "z")


def test_sink_layout_round_trip(spark):
    root = os.path.join(_tmp(), "sink")
    df = spark.createDataFrame([("2024-12-05", "a/b+c", "t1", 0, 'say "x", y')],
                               "date string, press_name string, title string, fetch_seq long, comments string")
    sink.write_new_articles(df, root, fmt="csv")
    rows, rejects = press_tree.ingest_press_tree(spark, root, layout="partitioned",
                                                 columns=(("title", "string"), ("comments", "string")))
    r = rows.first()
    assert (r.press_name, r.date, r.title, r.comments) == ("a/b+c", "2024-12-05", "t1", 'say "x", y')
    assert rejects.count() == 0


def test_extra_columns_as_map(spark):
    root = _tmp()
    _write(f"{root}/P/2024-12-05_P_1.csv", b"a,b\n1,2\n")
    _write(f"{root}/P/2024-12-07_P_3.csv", b"a,c\n5,6\n")
    rows, _ = press_tree.ingest_press_tree(spark, root, columns=(("a", "bigint"),), extra_columns="map")
    got = sorted((r.a, sorted(r.extra.items())) for r in rows.collect())
    assert got == [(1, [("b", "2")]), (5, [("c", "6")])]


def test_running_sums_equal_plain_window(spark):
    from pyspark.sql import Window
    from pressroom.operators.running import running_sums
    rows = [("hot" if i % 3 else f"k{i % 7}", i if i % 11 else None, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v long").withColumn("id", F.monotonically_increasing_id())
    order = [F.col("o").asc_nulls_first(), F.col("id")]
    df = spark.createDataFrame(df.collect(), df.schema)
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.withColumn("r", F.sum("v").over(w))
    dealt = running_sums(df, {"r": F.col("v")}, order, keys=["k"])
    a = sorted((r.k, r.id, r.r) for r in plain.collect())
    b = sorted((r.k, r.id, r.r) for r in dealt.collect())
    assert a == b


def test_stream_csv_source(spark):
    base = _tmp()
    src, out, ck = (os.path.join(base, x) for x in ("src", "sink", "ck"))
    _write(f"{src}/b1.csv", 'date,press_name,title,fetch_seq,comments\n'
                            '2024-12-05,P,t1,0,"multi\nline, quoted"\n'
                            '2024-12-05,P,t1,1,later copy\n'.encode("utf-8"))
    schema = "date string, press_name string, title string, fetch_seq long, comments string"
    ingest.stream_ingest(spark, src, out, ck, schema, fmt="csv")
    got = [(r.title, r.comments) for r in ingest.read_sink(spark, out).collect()]
    assert got == [("t1", "multi\nline, quoted")]


def test_pandas_tokenizer_plugin(spark):
    import pandas as pd
    from pyspark.sql import types as T

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_ws(s: pd.Series) -> pd.Series:
        return s.fillna("").str.split()

    df = spark.createDataFrame([("g", "aa bb aa c-c"), ("g", None)], "grp string, comments string")
    top = [(r.word, r.n) for r in tokens.top_tokens(df, "grp", n=5, tokenizer=split_ws).orderBy("rank").collect()]
    assert top == [("aa", 2), ("bb", 1), ("c-c", 1)]


def test_stream_watermark_dedup(spark):
    base = _tmp()
    src, out, ck = (os.path.join(base, x) for x in ("src", "sink", "ck"))
    schema = "k long, ts timestamp_ntz, v string"
    t0 = dt.datetime(2024, 12, 5, 10, 0, 0)
    spark.createDataFrame([(1, t0, "a"), (1, t0 + dt.timedelta(minutes=5), "b"), (2, t0, "c")], schema) \
         .write.parquet(os.path.join(src, "b1"))
    ingest.stream_dedup_watermark(spark, src + "/*", out, ck, schema, ["k"], "ts", "1 hour")
    spark.createDataFrame([(2, t0 + dt.timedelta(minutes=1), "d"), (3, t0, "e")], schema) \
         .write.parquet(os.path.join(src, "b2"))
    ingest.stream_dedup_watermark(spark, src + "/*", out, ck, schema, ["k"], "ts", "1 hour")
    keys = sorted(r.k for r in spark.read.parquet(out).collect())
    assert keys == [1, 2, 3]


def test_a13_crawl_days(spark):
    n = spark.range(1).select(F.size(articles.day_list("2024-12-04", "2025-04-15")).alias("n")).first().n
    assert n == 132


def test_c1_lookup_unmatched_and_large_directory(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "pid long")
    dim = spark.createDataFrame([(1, "A"), (3, "C")], "id long, name string")
    dim = dim.unionAll(spark.createDataFrame([(1, "B"), (1, "A")], dim.schema))  # a repeated id adds no rows
    got = sorted(((r.pid, r.press_name) for r in articles.lookup_press(df, dim, "pid", "id", "name").collect()), key=repr)
    assert got == sorted([(1, "A"), (2, None), (None, None)], key=repr)


def test_scores_to_shares_chain(spark):
    df = spark.createDataFrame([("P", "2024-12", "f1", "0.2"), ("P", "2024-12", "f1", "0.6"),
                                ("Q", "2025-01", "f2", "1")],
                               "press_name string, month string, file_name string, comments string")
    month = scores.mean_scores(df, NumberScorer(), scope="month")
    summary = shares.summary_from_scores(month, ["s"])
    long = shares.emotion_share(summary, ["s"])
    got = sorted((r["Year-Month"], r.Media_Outlet, r.Score, r.Ratio) for r in long.collect())
    assert got == [("2024-12", "P", 0.4, 100.0), ("2025-01", "Q", 1.0, 100.0)]


def test_dense_weekdays(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 5, 1, 0),), (dt.datetime(2024, 12, 5, 2, 0),)], "ts timestamp_ntz")
    got = [(r.weekday, r.n_comments) for r in timeprofile.time_histogram(df, "ts", "weekday", dense=True).collect()]
    assert got[0] == ("Monday", 0) and got[3] == ("Thursday", 2) and len(got) == 7


def test_a11_a12_links_by_class_and_directory(spark):
    from pressroom.sources import links
    html = ('<ul><li><a class="list_press nclicks" href="https://n.example.com/office?officeId=023&x=1">'
            '<span> 조선일보 </span></a></li>'
            '<li><a href="https://n.example.com/office?officeId=025" class="other">중앙일보</a></li>'
            '<li><a class="list_press" href="https://n.example.com/office?officeId=028"> 한겨레\t</a></li></ul>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    picked = links.extract_links(df, css_class="list_press").orderBy("pos").collect()
    assert [(r.pos, r.text) for r in picked] == [(0, "조선일보"), (2, "한겨레")]
    directory = {r.press_id: r.press_name for r in
                 links.press_directory(links.extract_links(df, css_class="list_press")).collect()}
    assert directory == {"023": "조선일보", "028": "한겨레"}


def test_monthly_and_group_keyword_reports(spark):
    from pressroom.operators import reports
    df = spark.createDataFrame([
        ("P", "2024-12-05_P_a.csv", "alpha beta alpha", "2024-12-05T10:00:00+0900"),
        ("P", "2025-04-30_P_b.csv", "gamma gamma", "2025-04-30T00:00:00+0900"),
        ("Q", "2025-04-30_Q_c.csv", "delta", "2025-04-30T00:00:01+0900"),
        ("Q", "2025-05-01_Q_d.csv", "omega", "2025-05-01T09:00:00+0900"),
        ("Q", "2023-11-01_Q_e.csv", None, "bad"),
    ], "press_name string, file_name string, comments string, regTime string")
    top, totals = reports.monthly_keywords(df, n=1, cutoff="2025-04-30", stopwords=[])
    assert sorted((r.year_month, r.word, r.n) for r in top.collect()) == [("2024-12", "alpha", 2), ("2025-04", "gamma", 2)]
    assert sorted((r.year_month, r.n_tokens, r.n_comments) for r in totals.collect()) == [("2024-12", 3, 1), ("2025-04", 2, 1)]
    gtop, _ = reports.group_keywords(df, {"G": ["P"]}, start="2024-12", end="2025-04", n=5, stopwords=[])
    got = sorted((r.group, r.word, r.n) for r in gtop.collect())
    assert got == [("G", "alpha", 2), ("G", "beta", 1), ("G", "gamma", 2), ("other", "delta", 1)]


def test_emotion_report_chain(spark):
    from pressroom.operators import reports
    sc = scores.pandas_scorer(lambda texts: [[float(t), 1.0 - float(t)] for t in texts], ["pos", "neg"])
    df = spark.createDataFrame([("P", "2024-12", "f1", "0.25"), ("P", "2024-12", "f2", "0.75"),
                                ("Q", "2024-12", "f3", "1.0")],
                               "press_name string, month string, file_name string, comments string")
    _, long, g = reports.emotion_report(df, sc, {"G": ["P", "Q"]})
    ratios = sorted((r.Media_Outlet, r.Emotion_Type, r.Ratio) for r in long.collect())
    assert ratios == [("P", "neg", 50.0), ("P", "pos", 50.0), ("Q", "neg", 0.0), ("Q", "pos", 100.0)]
    got = {(r.Emotion_Type): (r.mean_ratio, r.start) for r in g.collect()}
    assert got == {"pos": (75.0, 0.0), "neg": (25.0, 75.0)}


def test_a3_summary_csv_in_cp949_feeds_shares(spark):
    root = _tmp()
    e1, e2 = shares.EMOTIONS[0], shares.EMOTIONS[1]
    text = f"Year-Month-Media,{e1},{e2}\n2024-12-조선일보,1,3\n2024-12-한겨레,NA,2\n"
    _write(f"{root}/summary.csv", text.encode("cp949"))
    df = press_tree.read_csv_table(spark, f"{root}/summary.csv")
    long = shares.emotion_share(df)
    got = sorted((r.Media_Outlet, r.Emotion_Type, r.Ratio) for r in long.collect())
    assert got == sorted([("조선일보", e1, 25.0), ("조선일보", e2, 75.0), ("한겨레", e1, 0.0), ("한겨레", e2, 100.0)])
    _write(f"{root}/bad.csv", b"a,b\n\xff\xfe\x80\x80,1\n")
    with pytest.raises(ValueError):
        press_tree.read_csv_table(spark, f"{root}/bad.csv")


def test_sink_read_is_pruned_to_the_batch_folders(spark):
    import contextlib
    import io
    out = os.path.join(_tmp(), "sink")
    sink.write_new_articles(_fetches(spark, [1, 2]), out)
    other_day = spark.createDataFrame([("2024-12-09", "P", "t9", 5, "c")],
                                      "date string, press_name string, title string, fetch_seq long, comments string")
    fresh = sink.new_articles(other_day, out, prune_by=("press_name", "date"))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        fresh.explain("formatted")
    assert "PartitionFilters: [" in buf.getvalue() and "2024-12-09" in buf.getvalue()
    assert [r.title for r in fresh.collect()] == ["t9"]
    assert sink.write_new_articles(_fetches(spark, [1, 2, 3], seq0=20), out) == 1


def test_payload_with_byte_order_mark(spark):
    df = spark.createDataFrame([("a", 1, "\ufeff" + _page(2))], "object_id string, page long, payload string")
    assert payload.explode_payload(df).count() == 2


def test_score_table_keys(spark):
    df = spark.createDataFrame([("P", "2024-12", "2024-12-05_P_t.csv", "0.5")],
                               "press_name string, month string, file_name string, comments string")
    t = scores.score_table(scores.mean_scores(df, NumberScorer(), scope="file"), ["s"])
    assert t.columns == ["press_name", "year-month-day", "s"]
    assert [tuple(r) for r in t.collect()] == [("P", "2024-12-05", 0.5)]


def test_dense_months_and_years_fill_gaps(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 11, 5),), (dt.datetime(2025, 2, 1),), (dt.datetime(2025, 2, 9),)],
                               "ts timestamp_ntz")
    months = [(r.year_month, r.n_comments) for r in timeprofile.time_histogram(df, "ts", "year_month", dense=True).collect()]
    assert months == [("2024-11", 1), ("2024-12", 0), ("2025-01", 0), ("2025-02", 2)]
    years = [(r.year, r.n_comments) for r in timeprofile.time_histogram(df, "ts", "year", dense=True).collect()]
    assert years == [(2024, 1), (2025, 2)]


# ---------------------------------------------------------------- rows that used to be lost or wrong
def test_null_keys_are_keys(spark):
    rows = [("P", None, 1), ("P", None, 2), (None, "a", 3), (None, "a", 3), ("P", "a", None)]
    df = spark.createDataFrame(rows, "press string, title string, seq long")
    got = sorted((tuple(r) for r in sink.first_fetch(df, ["press", "title"], "seq").collect()), key=repr)
    assert got == sorted([("P", None, 1), (None, "a", 3), (None, "a", 3), ("P", "a", None)], key=repr)
    out = os.path.join(_tmp(), "sink")
    assert sink.write_new_articles(df, out, ["press", "title"], "seq", partition_by=["press"]) == 4
    assert sink.write_new_articles(df, out, ["press", "title"], "seq", partition_by=["press"]) == 0


def test_csv_cells_keep_blanks_and_length(spark):
    root = _tmp()
    long = "x" * 200_000
    df = spark.createDataFrame([("P", "2024-12-05", "  padded  "), ("P", "2024-12-05", long), (None, "2024-12-06", "no press")],
                               "press_name string, date string, comments string")
    sink.write_table(df, os.path.join(root, "t"), partition_by=["press_name", "date"], fmt="csv")
    rows, rejects = press_tree.ingest_press_tree(spark, os.path.join(root, "t"), layout="partitioned")
    assert sorted(((r.press_name, r.comments) for r in rows.collect()), key=repr) == sorted(
        [("P", "  padded  "), ("P", long), (None, "no press")], key=repr)
    assert rejects.count() == 0


def test_cells_beyond_the_header_and_repeated_names(spark):
    root = _tmp()
    _write(f"{root}/P/2024-12-05_P_t.csv", b"a,a,b\n1,2,3,4\n")
    rows, _ = press_tree.ingest_press_tree(spark, root, columns=(("a", "bigint"),))
    assert [(r.a, r.extra) for r in rows.collect()] == [(1, {"a.1": "2", "b": "3", "_cell3": "4"})]


def test_nan_is_no_value(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0,), (2.0,), (nan,)], "v double")
    r = profile.profile(df, ["v"]).first()
    assert (r["count"], r["mean"], r["p50"], r["max"]) == (2, 1.5, 1.5, 2.0)
    wide = spark.createDataFrame([("2024-12-P", "NaN", "3")], "`Year-Month-Media` string, Angry string, Happy string")
    assert {r["Emotion_Type"]: r["Ratio"] for r in shares.emotion_share(wide, ["Angry", "Happy"]).collect()} == {"Angry": 0.0, "Happy": 100.0}


def test_article_split_over_two_stream_files(spark):
    from pressroom.streaming import ingest
    base = _tmp()
    schema = "date string, press_name string, title string, fetch_seq long, comments string"
    for n, rows in enumerate([[("d", "P", "t", 0, "first half")], [("d", "P", "t", 0, "second half"), ("d", "P", "t", 1, "later fetch")]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/src")
        ingest.stream_ingest(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", schema, glob_filter="*.parquet")
        assert ingest.read_sink(spark, f"{base}/sink").count() == n + 1


def test_anchors_of_all_kinds(spark):
    html = """<a href="/1">plain</a><a
      class="x  hot y" href="/2?a=1&amp;officeId=9">over
      lines</a><A HREF='/3'>upper</A><a data-x="a>b" href=/4>bare</a><a name="n">none</a>"""
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [(r.pos, r.href) for r in links.extract_links(df).orderBy("pos").collect()]
    assert got == [(0, "/1"), (1, "/2?a=1&officeId=9"), (2, "/3"), (3, "/4")]
    assert [r.href for r in links.extract_links(df, css_class="y hot").collect()] == ["/2?a=1&officeId=9"]
    q = df.select(links.query_value(F.lit("http://h/p?officeId=a%20b&amp;x=1"), "officeId").alias("v"), links.query_value(F.lit("http://h/p?a=1&amp;x=2"), "x").alias("w"))
    assert tuple(q.first()) == ("a b", "2")


def test_scores_go_by_label(spark):
    labels = ["a", "b"]
    assert scores.label_scores([[("b", 1.0)], {"a": 2, "z": 9}, [{"label": "b", "score": 3}], [4, 5], []], labels) == [
        [0.0, 1.0], [2.0, 0.0], [0.0, 3.0], [4.0, 5.0], [0.0, 0.0]]
    with pytest.raises(ValueError):
        scores.label_scores([[1.0]], labels)
    df = spark.createDataFrame([("P", "m", "f", " "), ("P", "m", "f", "2"), ("P", "m", "f", None)], "press_name string, month string, file_name string, comments string")
    strict = scores.pandas_scorer(lambda: (lambda texts: [{"a": float(t)} for t in texts]), labels, loads=True)
    assert [(r.a, r.b, r.n_comments) for r in scores.mean_scores(df, strict, scope="month").collect()] == [(2.0, 0.0, 1)]


def test_broadcast_goes_by_bytes(spark):
    from pressroom.operators.joins import bounded_broadcast, size_bound
    small = spark.createDataFrame([("x" * 100, 1)] * 10, "s string, n long")
    assert 1000 <= size_bound(small) <= 2000
    assert bounded_broadcast(small, 2000)[1] and not bounded_broadcast(small, 500)[1]
