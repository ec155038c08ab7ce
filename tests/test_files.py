import json

import pytest
from pyspark.sql import functions as F

from loomgrid.sources import files as S


@pytest.fixture
def tree(tmp_path):
    for p, t in {"file1.txt": "Hello world\nThis is a test\nHello again", "file2.txt": "Different content\nNo matches here", "file3.py": "print('Hello world')\n# Hello comment", "sub/deep/x.txt": "deep", ".hid/y.txt": "no", "sub/.z.txt": "no", "_under.txt": "yes"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    return str(tmp_path)


def names(df):
    return [r.name for r in df.collect()]


def test_find(spark, tree):
    assert names(S.find_files(spark, tree, "*.txt", file_type="file")) == ["_under.txt", "file1.txt", "file2.txt", "x.txt"]
    assert names(S.find_files(spark, tree, file_type="directory")) == ["sub", "deep"]
    assert names(S.find_files(spark, tree, "*.TXT", "^FILE", case_sensitive=False, limit=1)) == ["file1.txt"]
    assert names(S.find_files(spark, tree, "*.txt", include_hidden=True, file_type="file", min_size=2, max_size=2)) == ["y.txt", ".z.txt"]
    assert "x.txt" not in names(S.find_files(spark, tree, max_depth=1))
    with pytest.raises(ValueError):
        S.find_files(spark, tree, limit=0)


def test_tree_of_many(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"test_file_{i}.py").write_text("")
    for i in range(3):
        (tmp_path / f"d{i}").mkdir()
        for j in range(10):
            (tmp_path / f"d{i}/sub_test_{j}.py").write_text("")
    assert S.find_files(spark, str(tmp_path), "*.py").count() == 150


def test_search(spark, tree):
    got = S.search_files(spark, tree, "Hello", context_lines=1).collect()
    assert [(r.file.split("/")[-1], r.line_number) for r in got] == [("file1.txt", 1), ("file1.txt", 3), ("file3.py", 1), ("file3.py", 2)]
    assert [(c.line_number, c.content, c.is_match) for c in got[0].context] == [(1, "Hello world", True), (2, "This is a test", False)]
    assert S.search_files(spark, tree, "hello", case_sensitive=False, file_pattern="*.py", limit=1).count() == 1


def test_read_and_write(spark, tree, tmp_path):
    one = S.read_files(spark, f"{tree}/file1.txt").first()
    assert (one.lines, one.characters, one.size) == (3, 38, 38)
    assert S.read_files(spark, tree, max_size=30).filter("name = 'file1.txt'").count() == 0
    out = f"{tmp_path}/out"
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    S.write_text(df, out)
    S.write_text(df, out, append=True)
    assert spark.read.text(out).count() == 4
    S.write_text(df, out)
    assert spark.read.text(out).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_text(df, out, overwrite=False)
    assert S.delete_where(df, F.col("value") == "a").count() == 1


def test_settings(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"a": {"b": 2}, "c": [1]}))
    got = S.settings(str(p), {"a": {"b": 1, "x": 1}}, {"c": 3})
    assert got == {"a": {"b": 2, "x": 1}, "c": 3}
    assert S.lookup(got, "a.b") == 2 and S.lookup(got, "a.q", 9) == 9
    assert S.settings(str(tmp_path / "none.json"), {"a": 1}) == {"a": 1}
    S.save_settings(got, str(tmp_path / "d/e.json"))
    assert S.settings(str(tmp_path / "d/e.json")) == got
    assert S.from_environment("X_", {"X_A__B": "1", "X_A__C": "yes", "Y": "2"}) == {"a": {"b": 1, "c": "yes"}}


def test_one_file_or_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert S.read_file(spark, str(tmp_path / "a.txt")).first().content == "one\ntwo\n"
    for path, most, error in ((tmp_path / "none", 10, FileNotFoundError), (tmp_path, 10, IsADirectoryError), (tmp_path / "a.txt", 3, ValueError)):
        with pytest.raises(error):
            S.read_file(spark, str(path), most)


def test_yaml_settings(tmp_path):
    pytest.importorskip("yaml")
    path = str(tmp_path / "x" / "s.yml")
    S.save_settings({"a": {"b": 1}, "c": [1, "x"]}, path)
    assert S.settings(path, {"a": {"d": 2}}) == {"a": {"b": 1, "d": 2}, "c": [1, "x"]}
    (tmp_path / "bad.yaml").write_text("a: [1")
    (tmp_path / "list.yaml").write_text("- 1")
    assert S.settings(str(tmp_path / "bad.yaml"), {"a": 1}) == S.settings(str(tmp_path / "list.yaml"), {"a": 1}) == {"a": 1}
