"""Raw files of all kinds, and the query that reads the documents back from files."""

import os

from pyspark.sql import functions as F

from rolesieve.functions.text import normalize_text_of
from rolesieve.operators.tables import parse_bytes
from rolesieve.plans import catalog
from rolesieve.sources.files import FILE, Files, RawFilesReader, read_raw_files, read_text_files

DATA = "/root/testdata/sf0.001"


def test_empty_broken_and_large_files(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_bytes("Một  văn bản\r\n".encode())
    (d / "none.txt").write_bytes(b"")
    (d / "blank.md").write_bytes(b" \n\t ")
    (d / "odd.bin").write_bytes(b"\xff\xfeok\x80")
    (d / "sub/large.log").write_bytes(b"line of text\n" * 400_000)
    (d / "_hidden").write_bytes(b"no")
    (d / "sub/.hidden").write_bytes(b"no")
    name = lambda p: os.path.basename(p)
    for where in (str(d), f"file://{d}"):
        texts, rejects = read_text_files(spark, where, task_bytes="1000")
        got = {name(r["path"]): r for r in texts.collect()}
        assert set(got) == {"a.txt", "odd.bin", "large.log"} and got["odd.bin"]["text"] == "ok" and got["a.txt"]["page"] == 1
        assert got["a.txt"]["text"] == normalize_text_of("Một  văn bản\r\n") and got["large.log"]["text"].count("line of text") == 400_000
        why = {name(r["path"]): r["reason"] for r in rejects.collect()}
        assert why["none.txt"] == "no bytes" and why["blank.md"] == "empty text" and set(why) == {"none.txt", "blank.md"}
    one = read_raw_files(spark, str(d / "a.txt")).collect()
    assert [(name(r["path"]), r["size"], r["error"]) for r in one] == [("a.txt", len("Một  văn bản\r\n".encode()), None)]
    (tmp_path / "empty").mkdir()
    assert read_raw_files(spark, str(tmp_path / "empty")).count() == 0


def test_a_file_that_cannot_be_read_is_a_reject(spark, tmp_path):
    """One that went between listing and reading, and one that is a folder by then."""
    (tmp_path / "a.txt").write_bytes(b"fine")
    reader = RawFilesReader({"path": str(tmp_path)})
    rows = [b.to_pylist()[0] for b in reader.read(Files([(str(tmp_path / "a.txt"), 4), (str(tmp_path / "gone"), 9), (str(tmp_path), 1)]))]
    assert [(r["size"], r["content"], r["error"] is None) for r in rows] == [(4, b"fine", True), (9, None, False), (1, None, False)]
    texts, rejects = parse_bytes(spark.createDataFrame([(r["path"], r["size"], r["content"], r["error"]) for r in rows], FILE))
    assert [r["text"] for r in texts.collect()] == ["fine"] and rejects.count() == 2 and {r["reason"] for r in rejects.collect()}.isdisjoint({"no bytes", "empty text"})


def test_tasks_by_size(tmp_path):
    for i, n in enumerate([10, 10, 10, 500, 5, 5, 0]):
        (tmp_path / f"f{i}").write_bytes(b"x" * n)
    parts = [[n for _, n in p.files] for p in RawFilesReader({"path": str(tmp_path), "task_bytes": "25", "task_files": "2"}).partitions()]
    assert parts == [[10, 10], [10], [500], [5, 5], [0]]


def test_documents_as_files(spark):
    got = {r["shelf"]: r["text"] for r in catalog.queries()["read_text_files"](spark, DATA).collect()}
    want: dict[str, list] = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").select("text", F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")).alias("shelf")).collect():
        want.setdefault(r["shelf"], []).append((r["text"] or "") + "\n")
    assert got == {k: normalize_text_of("".join(v)) for k, v in want.items()} and len(got) > 1
