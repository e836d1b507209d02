"""File digests: exact bytes, whole and cut files, and no task that holds a file."""

import hashlib
import random

import pyarrow as pa
import pytest

from folioweave.sources import stores

CONTENTS = {
    "marked.txt": b"\xef\xbb\xbfone\r\ntwo\n\nthree", "mark.txt": b"\xef\xbb\xbf", "mark_and_end.txt": b"\xef\xbb\xbf\n", "ends.html": b"\n\n",
    "empty.txt": b"", "returns.TXT": b"a\rb\r\n\r", "x y%20\u00e9.pdf": random.Random(1).randbytes(3_000_000), "ended.parquet": random.Random(2).randbytes(2_000_001) + b"\n",
    "blank.docx": b"\n" * 100_000, "sub/marked.txt": b"\xff\xfe\x00\n\x80", "three.htm": b"abc", "line.doc": b"x" * 300_000,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "sub").mkdir()
    for name, data in CONTENTS.items():
        (top / name).write_bytes(data)
    for name in ("other.csv", "broken.gz", "plain"):
        (top / name).write_bytes(b"no\n")
    return str(top)


def expected():
    return sorted((name.split("/")[-1], len(data), hashlib.sha256(data).hexdigest()) for name, data in CONTENTS.items() if data)


def test_digests_of_files_read_whole(spark, folder):
    found = stores.file_manifest(spark, folder)
    assert found.columns == ["name", "file_type", "size", "sha256"]
    assert sorted((r["name"], r["size"], r["sha256"]) for r in found.collect()) == expected()
    assert sorted((r["name"], r["size"]) for r in stores.file_manifest(spark, folder, digest=False).collect()) == [e[:2] for e in expected()]
    assert [r["name"] for r in stores.file_manifest(spark, folder, "*.pdf").collect()] == ["x y%20\u00e9.pdf"]
    assert stores.file_manifest(spark, folder, "*.none").count() == 0


def test_digests_of_files_that_are_cut(spark, folder, monkeypatch):
    """A session that holds on to small splits."""
    conf, put = type(spark.conf), type(spark.conf).set
    monkeypatch.setattr(conf, "set", lambda self, key, value: put(self, key, "65536" if key.endswith("maxPartitionBytes") else value))
    assert sorted((r["name"], r["size"], r["sha256"]) for r in stores.file_manifest(spark, folder).collect()) == expected()


def test_a_file_is_not_one_value(spark, folder):
    """Before, the content of a file was one row, read whole and copied by the task."""
    assert "sha2(" not in stores.file_manifest(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    lines = [b"%d\n" % i for i in range(1000)]
    batches = [pa.RecordBatch.from_pydict({
        "file": ["f"] * 10, "size": [len(b"".join(lines))] * 10, "start": [0] * 10, "whole": [True] * 10, "data": lines[i : i + 10],
    }) for i in range(0, 1000, 10)]
    made = pa.Table.from_batches(stores._digests_or_pieces(iter(batches))).to_pylist()
    assert [(r["data"], r["sha256"]) for r in made] == [(None, hashlib.sha256(b"".join(lines)).hexdigest())]


def test_a_file_that_changes_while_it_is_read_is_an_error():
    taken = stores.LineDigest()
    taken.add(memoryview(b"ab\n"))
    with pytest.raises(ValueError):
        taken.result(7)
