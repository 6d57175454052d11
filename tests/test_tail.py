"""The tailing source: whole lines only, from offset to offset."""

from specloom.sources import tail


def test_lines_and_offsets(tmp_path):
    path = str(tmp_path / "log")
    assert tail.read_new_lines(path, 0) == ([], 0)
    with open(path, "wb") as f:
        f.write("﻿one\r\ntwo x\npart".encode())
    lines, at = tail.read_new_lines(path, 0)
    assert [x for _, x in lines] == ["one", "two x"]
    with open(path, "ab") as f:
        f.write(b"ial\n")
    assert tail.read_new_lines(path, at) == ([(at, "partial")], at + 8)
    assert [x for _, x in tail.read_new_lines(path, 0, 4)[0]] == ["one"]
    with open(path, "wb") as f:
        f.write(b"new\n")
    assert tail.read_new_lines(path, at) == ([(0, "new")], 4)


def test_stream(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("a\nb\nc")
    query = tail.tail(spark, str(path)).writeStream.format("memory").queryName("tailed").start()
    try:
        query.processAllAvailable()
        assert [r["value"] for r in spark.table("tailed").orderBy("entry_seq").collect()] == ["a", "b"]
        with path.open("a") as f:
            f.write("c\n")
        query.processAllAvailable()
        assert [r["value"] for r in spark.table("tailed").orderBy("entry_seq").collect()] == ["a", "b", "cc"]
    finally:
        query.stop()
