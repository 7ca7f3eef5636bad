"""Trees of many files are listed by folder, and hold the files that their globs match and no others."""

import contextlib
import io
import os
import re

import pytest

from pressroom.sources import press_tree, sink, split_csv


def lay(root, names):
    for name in names:
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", encoding="utf-8", newline="") as f:
            f.write(f"a,b\n{name},x\n")


TREE = ["p 1/2024-01-02_p_t%41.csv", "p 1/2024-02-02_p_=x.csv", "신문/2024-01-03_신문_제목+1.csv"]
OTHERS = ["2024-01-01_beside.csv", "p 1/deep/2024-01-02_p_u.csv", "p 1/k=1/2024-01-02_p_v.csv", "p 1/2024-01-02_p_t.txt", "p 1/_2024-01-02_p_t.csv"]


def test_folders_are_listed_not_files(spark, tmp_path):
    lay(tmp_path, [f"p{i % 2}/2024-01-{i % 28 + 1:02d}_p_{i}.csv" for i in range(50)])
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        split_csv.load_files(spark, "text", f"{tmp_path}/*/*.csv").explain("formatted")
    assert [int(n) for n in re.findall(r"InMemoryFileIndex\((\d+) paths\)", out.getvalue())] in ([], [2])
    table = press_tree.read_csv_table(spark, f"{tmp_path}/*/*.csv", encodings=("utf-8",))
    assert table.count() == 50


def test_only_the_files_that_the_globs_match(spark, tmp_path):
    lay(tmp_path, TREE + OTHERS)
    columns = (("a", "string"),)
    read = lambda months: sorted(r["a"] for r in press_tree.ingest_press_tree(spark, str(tmp_path), months=months, columns=columns, extra_columns=False)[0].collect())
    assert read(None) == sorted(TREE)
    assert read(["2024-01"]) == sorted([TREE[0], TREE[2]])
    assert read(["2024-02", "2024-01"]) == sorted(TREE)
    for months in (["2023-01"], ["2024-01", "2023-01"]):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read(months)


def test_article_files_keep_names_and_bytes(spark, tmp_path):
    rows = [(press, f"2024-01-{i % 28 + 1:02d}_{press}_{i} %41=x#.csv", f"a,b\n{i},가".encode()) for press in ("p%1", "신 문") for i in range(20)]
    sink.write_article_files(spark.createDataFrame(rows, "press_name string, file_name string, content binary").repartition(3), str(tmp_path / "tree"))
    found = {(p, n): (tmp_path / "tree" / p / n).read_bytes() for p in os.listdir(tmp_path / "tree") for n in os.listdir(tmp_path / "tree" / p) if not n.startswith(".")}
    assert found == {(p, n): c + b"\n" for p, n, c in rows}
