import os

import pytest

from cuesheet.sinks.named import NamedFilesWriter, Written, write_named


def contents(folder):
    return {f: open(f"{folder}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(folder))}


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, text string")


def test_a_file_a_row_under_its_name(spark, tmp_path):
    out = f"{tmp_path}/out"
    write_named(frame(spark, [("a.json", '{"ü": 1}'), ("b.csv", "x,y\n"), ("empty", None)]).repartition(3), out)
    assert contents(out) == {"a.json": '{"ü": 1}', "b.csv": "x,y\n", "empty": ""}
    write_named(frame(spark, [("b.csv", "new"), ("c", "z")]), out, overwrite=False)
    assert contents(out) == {"a.json": '{"ü": 1}', "b.csv": "new", "c": "z", "empty": ""}
    write_named(frame(spark, [("d", "only")]), out)
    assert contents(out) == {"d": "only"}


@pytest.mark.parametrize("rows", [[("a", "1"), ("a", "2")], [("../a", "1")], [("", "1")], [(None, "1")]])
def test_bad_names_leave_the_folder_as_it_was(spark, tmp_path, rows):
    out = f"{tmp_path}/out"
    write_named(frame(spark, [("kept", "x")]), out)
    with pytest.raises(Exception, match="name"):
        write_named(frame(spark, rows).repartition(2), out)
    assert contents(out) == {"kept": "x"}


def test_only_committed_attempts_become_files(tmp_path):
    """A lost attempt's files are dropped, and an abort keeps what was there."""
    writer = NamedFilesWriter(str(tmp_path), overwrite=False)
    writer.write(iter([("a", "lost attempt")]))
    kept = writer.write(iter([("a", "second attempt")]))
    assert not [f for f in os.listdir(tmp_path) if not f.startswith("_")]
    writer.commit([kept, None, Written()])
    assert contents(tmp_path) == {"a": "second attempt"}
    other = NamedFilesWriter(str(tmp_path), overwrite=True)
    other.write(iter([("b", "x")]))
    other.abort([])
    assert contents(tmp_path) == {"a": "second attempt"}
