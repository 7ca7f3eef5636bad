"""Reading of multi-line CSV by ranges: notes of chunks, files in many ranges, rejects; the one merged file."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressroom.sources import press_tree, sink, split_csv

CELLS = st.lists(st.sampled_from(["a", "\"", "\n", ",", "\r\n", "한", " "]), max_size=12).map("".join)


def as_csv(rows, **options):
    out = io.StringIO(newline="")
    csv.writer(out, **options).writerows(rows)
    return out.getvalue()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(CELLS, min_size=2, max_size=2), min_size=1, max_size=8), st.lists(st.integers(1, 4), max_size=30), st.sampled_from(["\n", "\r\n"]))
def test_notes_of_chunks_put_the_records_together(rows, cuts, end):
    data = as_csv(rows, lineterminator=end).encode()
    lines = data.split(b"\n")[:-1]
    inside, records = False, []
    while lines:
        size = cuts.pop() if cuts else 2
        chunk, lines = lines[:size], lines[size:]
        whole = b"\n".join(chunk) + b"\n"
        after, starts, head, tail, error = split_csv.note(chunk, inside)
        assert error is None
        if inside:
            records[-1] += whole[:head]
        got = split_csv.records_of(whole[head:tail], "utf-8")
        assert starts == len(got) + (tail < len(whole))
        records += [as_csv([r], lineterminator=end).encode() for r in got]
        if tail < len(whole):
            records.append(whole[tail:])
        inside = after
    assert not inside
    assert [split_csv.records_of(r, "utf-8")[0] for r in records] == [r for r in csv.reader(io.StringIO(data.decode(), newline=""))]


@pytest.mark.parametrize("line,inside,after,wrong", [
    (b'a,"b', False, True, False), (b'a""b,c"d', False, False, False), (b'"a""', False, True, False), (b'x"",y', True, True, False),
    (b'x",y\r', True, False, False), (b'x"y', True, False, True), (b'"a" ,b', False, False, True), (b"a\rb", False, False, True), (b"a\r", False, False, False),
    (b'"a\rb"', False, False, False), (b'""', True, True, False), (b'"', True, False, False), (b"", True, True, False)])
def test_lines(line, inside, after, wrong):
    got, error = split_csv.after_line(line, inside)
    assert bool(error) == wrong and (wrong or got == after)


@pytest.fixture
def small_ranges(spark):
    """Files in ranges of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_files_in_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    cell = lambda: "".join(rng.choice(["a", "b", '"', "\n", ",", "\r\n", "한", '"\n', " "]) for _ in range(rng.randint(0, 25)))
    folder = tmp_path / "한 글=x"
    folder.mkdir()
    want = {}
    for name, encoding in (("a b+%41", "utf-8"), ("c", "cp949"), ("d", "utf-8-sig")):
        rows = [[str(i), cell(), cell()] for i in range(120)] + [["120", "x\n" * 1200, ""]]
        want[name] = rows
        (folder / f"{name}.csv").write_bytes(as_csv([["id", "x y", "글"], *rows]).encode(encoding))
    bad = {"open": (b'a,b\n1,"x\n', "ends inside quotes"), "bad": (b"a,b\n\xff\xff,1\n", "undecodable"), "after": (b'a,b\n"1"x,2\n', "after a closing quote"),
           "blank": (b"\n\n", "empty file")}
    for name, (content, _) in bad.items():
        (folder / f"{name}.csv").write_bytes(content)
    files = split_csv.CsvFiles(spark, f"{tmp_path}/*/*.csv", ("utf-8", "cp949"), chunk_bytes=300)
    stem = lambda p: p.rsplit("/", 1)[1].removesuffix(".csv")
    assert {stem(r["path"]): r["reason"] for r in files.rejects().collect()} == {n: r for n, r in ((n, next(x for x in (
        "undecodable", "empty file", "parse error: text after a closing quote", "parse error: the file ends inside quotes") if w in x)) for n, (_, w) in bad.items())}
    assert files.names() == ["id", "x y", "글"]
    got = {}
    for r in files.records(files.names()).orderBy("path", "record").collect():
        got.setdefault(stem(r["path"]), []).append([r["id"], r["x y"], r["글"]])
    assert got == want
    # one file, several ranges, each of them several chunks
    counts = files.located.filter(F.col("path").endswith("/c.csv")).agg(F.countDistinct("range").alias("r"), F.count("*").alias("n")).first()
    assert counts["r"] > 2 and counts["n"] > counts["r"]
    longest = files.records(["x y"]).filter("record = 121").select(F.length("x y").alias("n")).distinct().collect()
    assert [r["n"] for r in longest] == [2400]


def test_names_and_ragged_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,a,b\r\n1,2\r\n\r\n3,4,5,6\r\n"7\r\n",8,9\r\n')
    (tmp_path / "b.csv").write_text("b\n\"\"\nx\n")
    files = split_csv.CsvFiles(spark, f"{tmp_path}/*.csv")
    got = {(r["path"][-5], r["record"]): (r["b"], r["rest"]) for r in files.records(["b"], rest="rest").collect()}
    assert got == {("a", 1): (None, {"a": "1", "a.1": "2"}), ("a", 2): ("5", {"a": "3", "a.1": "4", "_cell3": "6"}), ("a", 3): ("9", {"a": "7\r\n", "a.1": "8"}),
                   ("b", 1): ("", {}), ("b", 2): ("x", {})}
    assert files.names() == ["a", "a.1", "b"] and files.names(F.col("path").endswith("b.csv")) == ["b"]


def test_no_files_with_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    files = split_csv.CsvFiles(spark, f"{tmp_path}/*.csv")
    assert files.records(files.names()).count() == 0 and files.rejects().count() == 0


def test_one_merged_file(spark, tmp_path, small_ranges):
    rng = random.Random(2)
    rows = [(rng.choice("pqr"), i, "".join(rng.choice(['a', '"', "\n", ",", "\r\n", "한", "\\"]) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    rows += [(None, 300, None), ("q", 301, "")]
    path = str(tmp_path / "out" / "all.csv")
    for _ in range(2):  # replaced, not appended to
        sink.write_merged_csv(spark.createDataFrame(rows, "press string, n int, text string").repartition(7), path, ["press", F.desc("n")])
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["all.csv"]
    raw = list(csv.reader(io.StringIO((tmp_path / "out" / "all.csv").read_bytes().decode(), newline="")))
    want = sorted(rows, key=lambda r: (r[0] or "", -r[1]))
    assert raw == [["press", "n", "text"], *[[p or "", str(n), t or ""] for p, n, t in want]]
    files = split_csv.CsvFiles(spark, path, chunk_bytes=200)
    got = [(r["press"], r["n"], r["text"]) for r in files.records(files.names()).orderBy("record").collect()]
    assert got == [(p or "", str(n), t or "") for p, n, t in want]
    assert files.located.select("range").distinct().count() > 2
    assert press_tree.read_csv_table(spark, path, encodings=("utf-8",)).count() == len(rows)


def test_article_files_in_the_raw_layout(spark, tmp_path):
    rows = [("한 a", "2024-01-02_p_1.csv", "a,b\r\n1,한".encode("cp949")), ("q", "2024-01-03_q_=%2.csv", b"x")]
    sink.write_article_files(spark.createDataFrame(rows, "press_name string, file_name string, content binary"), str(tmp_path / "tree"))
    found = {(p.parent.name, p.name): p.read_bytes() for p in (tmp_path / "tree").glob("*/*.csv")}
    assert found == {(p, f): c + b"\n" for p, f, c in rows}


def test_press_tables_keep_other_presses_and_empty_ones(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "press_name string, day string, score double"
    read = lambda: sink.read_press_tables(spark, path)
    sink.write_press_tables(spark.createDataFrame([("A", "1", 1.0), ("A", "2", 2.0), ("023", "1", 3.0)], schema), path)
    listed = spark.createDataFrame([("A",), ("empty",)], "press_name string")
    sink.write_press_tables(spark.createDataFrame([("A", "3", 4.0)], schema), path, listed)
    rows, presses = read()
    assert sorted(map(tuple, rows.select("press_name", "day", "score").collect())) == [("023", "1", 3.0), ("A", "3", 4.0)]
    assert sorted(r[0] for r in presses.collect()) == ["023", "A", "empty"]
    # scored again and without comments now
    sink.write_press_tables(spark.createDataFrame([], schema), path, spark.createDataFrame([("A",)], "press_name string"))
    rows, presses = read()
    assert [r[0] for r in rows.select("press_name").collect()] == ["023"] and presses.count() == 3


def test_listed_folders_are_pruned_by_the_list(spark, tmp_path):
    rows = [(f"0{p}", f"2024-0{m}", i) for p in range(4) for m in range(1, 7) for i in range(3)]
    path = str(tmp_path / "t")
    sink.write_table(spark.createDataFrame(rows, "press_name string, month string, n int"), path, partition_by=["press_name", "month"])
    listed = spark.createDataFrame([("01", "2024-02", 1), ("03", "2024-05", 1), ("03", "2024-06", 2)], "press_name string, month string, place int").filter("place <= 1")
    found = sink.read_listed(spark, path, listed, {"press_name": "press_name", "month": "month"})
    assert sorted({(r["press_name"], r["month"]) for r in found.collect()}) == [("01", "2024-02"), ("03", "2024-05")] and found.count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
