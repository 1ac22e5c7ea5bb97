import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veilscan import Scanner, scan_directory, scan_file, scan_files, scan_path, summarise
from veilscan.operators.gates import is_text_path
from veilscan.sources.files import decode_bytes, list_directory, scan_listed
from veilscan.sources.listing import LISTED, _list, list_tree

MAIL = "write to a.b@x.org today"


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    files = {
        "a.txt": MAIL.encode(),
        "B.LOG": b"nothing here",
        "x.env": b"IP=10.0.0.1",
        "c.bin": MAIL.encode(),
        "noext": MAIL.encode(),
        "blank.md": b" \n\t ",
        "empty.md": b"",
        "latin.txt": b"caf\xe9 a.b@x.org",
        "utf16.txt": MAIL.encode("utf-16"),
        "broken.txt": b"\xff\xfe\x00\xd8",
        "large.csv": b"a.b@x.org\n" * 400,
        "sub/deep/n.Json": MAIL.encode(),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


def by_name(results, root):
    return {row.file.removeprefix(f"file:{root}/"): row for row in results.collect()}


SMALL = Scanner.for_request(overrides={"max_file_size_mb": 0.003})


def test_directory(spark, tree):
    rows = by_name(scan_path(spark, str(tree), scanner=SMALL), tree)
    assert set(rows) == {
        "a.txt", "B.LOG", "x.env", "blank.md", "empty.md", "latin.txt", "utf16.txt", "broken.txt",
        "large.csv", "sub/deep/n.Json",
    }
    a = rows["a.txt"]
    assert (a.status, a.pii_count, a.chunks_processed, a.file_size_bytes, a.error) == (
        "success", 1, 1, len(MAIL), None,
    )
    assert a.entities[0].asDict() == {
        "text": "a.b@x.org", "label": "email", "score": pytest.approx(0.95), "start": 9, "end": 18,
    }
    assert (rows["B.LOG"].status, rows["B.LOG"].pii_count) == ("success", 0)
    for name, size in (("blank.md", 4), ("empty.md", 0)):
        row = rows[name]
        assert (row.status, row.error, row.file_size_bytes, row.chunks_processed) == (
            "skipped", "Empty file", size, 0,
        )
    # Offsets are bytes of the decoded text.
    assert rows["latin.txt"].entities[0].start == 6
    assert rows["utf16.txt"].entities[0].start == 9
    broken = rows["broken.txt"]
    assert (broken.status, broken.file_size_bytes, broken.chunks_processed) == ("error", None, 0)
    assert "Unable to decode" in broken.error
    large = rows["large.csv"]
    assert (large.status, large.error, large.file_size_bytes) == (
        "skipped", "File too large (0.0MB > 0.0MB)", 4000,
    )
    summary = summarise(scan_path(spark, str(tree), scanner=SMALL)).first()
    assert summary.asDict() == {"total_files": 10, "files_with_pii": 5, "total_pii": 5, "errors": 1}


def test_flat_listing(spark, tree):
    rows = by_name(scan_directory(spark, str(tree), recursive=False), tree)
    assert "sub/deep/n.Json" not in rows and len(rows) == 9


def test_spark_reader_gives_the_same(spark, tree):
    plain = scan_files(list_directory(spark, str(tree)), SMALL)
    own = scan_directory(spark, str(tree), scanner=SMALL).filter("file_size_bytes is distinct from 0")
    assert sorted(plain.collect(), key=repr) == sorted(own.collect(), key=repr)


def test_hidden_names(spark, tmp_path):
    names = ["__init__.py", "_config.yml", ".prod.env", "ok.txt", ".git/_x/a.md"]
    (tmp_path / ".git" / "_x").mkdir(parents=True)
    for name in [*names, ".env"]:
        (tmp_path / name).write_text(MAIL)
    rows = by_name(scan_path(spark, str(tmp_path)), tmp_path)
    assert {name: row.pii_count for name, row in rows.items()} == dict.fromkeys(names, 1)
    (row,) = scan_path(spark, str(tmp_path / "__init__.py")).collect()
    assert (row.status, row.pii_count) == ("success", 1)


def test_links(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "a.txt").write_text(MAIL)
    (tmp_path / "file.txt").symlink_to(tmp_path / "real" / "a.txt")
    (tmp_path / "dir.txt").symlink_to(tmp_path / "real")
    (tmp_path / "loop").symlink_to(tmp_path)
    (tmp_path / "gone.txt").symlink_to(tmp_path / "none")
    rows = by_name(scan_directory(spark, str(tmp_path)), tmp_path)
    assert {name: row.status for name, row in rows.items()} == {
        "real/a.txt": "success", "file.txt": "success", "dir.txt": "error", "gone.txt": "error",
    }


def test_directories_that_cannot_be_listed_become_errors(spark, tmp_path):
    listed = spark.createDataFrame([(f"file:{tmp_path}/none",)], "path string").mapInPandas(_list, LISTED)
    (row,) = scan_listed(listed, Scanner()).collect()
    assert (row.file, row.status, row.file_size_bytes) == (f"file:{tmp_path}/none", "error", None)
    assert "Unable to list directory" in row.error


def test_empty_directory(spark, tmp_path):
    assert scan_directory(spark, str(tmp_path)).collect() == []


def test_single_file_ignores_extension(spark, tree):
    (row,) = scan_path(spark, str(tree / "c.bin")).collect()
    assert (row.status, row.pii_count) == ("success", 1)


def test_single_file_failure_is_raised(spark, tree):
    with pytest.raises(Exception, match="Unable to decode"):
        scan_file(spark, str(tree / "broken.txt")).collect()
    with pytest.raises(Exception, match="Unable to decode"):
        scan_file(spark, str(tree / "broken.txt")).select("file", "pii_count").collect()


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        scan_path(spark, str(tmp_path / "none"))


def test_unreadable_files_become_errors(spark, tree):
    results = scan_directory(spark, str(tree))
    (tree / "a.txt").unlink()
    row = by_name(results, tree)["a.txt"]
    assert (row.status, row.file_size_bytes, row.pii_count, row.entities) == ("error", None, 0, [])
    assert "Unable to read file" in row.error


def test_single_empty_file(spark, tree):
    (row,) = scan_file(spark, str(tree / "empty.md")).collect()
    assert (row.status, row.error, row.file_size_bytes) == ("skipped", "Empty file", 0)


def test_names_that_need_quoting(spark, tmp_path):
    names = ["a b.txt", "100%.txt", "x+y.txt", "é#1.txt", "empty +%20.txt"]
    for name in names:
        (tmp_path / name).write_text("" if name.startswith("empty") else MAIL)
    rows = by_name(scan_directory(spark, str(tmp_path)), tmp_path)
    assert {name: row.status for name, row in rows.items()} == {
        name: "skipped" if name.startswith("empty") else "success" for name in names
    }


def test_listing_includes_every_file(spark, tree):
    listed = list_tree(spark, str(tree))
    assert listed.count() == 12
    assert {row.kind for row in listed.collect()} == {"file"}
    assert listed.filter("path like '%/a.txt'").first().length == len(MAIL)


def test_text_paths(evaluate):
    paths = {
        "/d/a.txt": True, "/d/B.LOG": True, "x.env": True, "/d/c.bin": False, "/d/.env": False,
        "/d.txt/file": False, "/d/a.tar.JSON": True, "/d/a.": False, "/d/.a.py": True,
    }
    found = evaluate(is_text_path(F.col("p")), [(p,) for p in paths], "p string")
    assert dict(zip(paths, found)) == paths


def test_decoding(evaluate):
    cases = {
        b"\x63\x61\x66\xe9": "café",
        b"\x80": "€",
        b"\x81\x93": "\x81“",
        "é€😀".encode(): "é€😀",
        b"\xef\xbb\xbfabc": "﻿abc",
        b"\xef\xbb\xbf\xff": None,
        "a😀é".encode("utf-16"): "a😀é",
        b"\xfe\xff" + "a😀é".encode("utf-16-be"): "a😀é",
        b"\xff\xfe": "",
        b"\xff\xfea": None,
        b"\xff\xfe\x00\xd8a\x00": None,
        b"\xff\xfe\x00\xdc": None,
        b"\xfe\xff\xd8\x00": None,
        b"": "",
        b"a\x00b": "a\x00b",
    }
    found = evaluate(decode_bytes(F.col("c")), [(bytearray(c),) for c in cases], "c binary")
    assert found == list(cases.values())


def test_every_byte_decodes_as_windows_1252(evaluate):
    (text,) = evaluate(decode_bytes(F.col("c")), [(bytearray(range(256)),)], "c binary")
    undefined = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
    expected = [chr(b) if b in undefined else bytes([b]).decode("cp1252") for b in range(256)]
    assert list(text) == expected
