import os
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import chunking, diff
from tidemark.plans import content
from tidemark.sources import files


def test_listing_keeps_hidden_names_and_skips_links(spark, tmp_path):
    (tmp_path / "docs" / "deep").mkdir(parents=True)
    for name, data in ((".hidden", b"h"), ("_under", b""), ("docs/A.txt", b"abc"), ("docs/deep/CON.txt", b"x"), ("docs/cafe\u0301", b"nfd")):
        (tmp_path / name).write_bytes(data)
    os.utime(tmp_path / "docs/A.txt", ns=(0, 1_700_000_000_123_000_000))
    os.symlink(tmp_path / "docs", tmp_path / "link_to_folder")
    os.symlink(tmp_path / "docs/A.txt", tmp_path / "link_to_file")
    listing = files.list_files(spark, str(tmp_path))
    rows = {r.path: r for r in listing.collect()}
    assert set(rows) == {".hidden", "_under", "docs/A.txt", "docs/deep/CON.txt", "docs/café"}
    a = rows["docs/A.txt"]
    assert (a.length, a.mtime_ms, a.path_key, a.path_error) == (3, 1_700_000_000_123, "docs/a.txt", None)
    assert rows["docs/deep/CON.txt"].path_error == "RESERVED_NAME"
    assert rows["docs/café"].display == "docs/caf\u00e9"
    contents = {r.path: bytes(r.content) for r in files.read_contents(listing, str(tmp_path)).collect()}
    assert contents["docs/A.txt"] == b"abc" and contents["_under"] == b""
    by_uri = files.list_files(spark, f"file://{tmp_path}/docs").select("path", "length").collect()
    assert ("A.txt", 3) in [tuple(r) for r in by_uri]


def test_unreadable_root_refuses_the_snapshot(spark, tmp_path):
    listing = files.list_files(spark, str(tmp_path / "absent"))
    row = listing.first()
    assert row.path_error.startswith("WALK_ERROR")
    me = spark.createDataFrame([("me", "ACTIVE")], "device string, status string")
    gate = diff.diff_gate(me, "me", spark.range(0), listing)
    assert [r.violation for r in gate.collect()] == ["INVALID_PATH"]


def test_streamed_chunks_equal_chunks_of_the_whole_value(spark, tmp_path):
    sizes = {"a": 300_000, "b": 0, "c": 10, "d": 65_536}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    listing = files.list_files(spark, str(tmp_path))
    small = dict(minimum=64, average=256, maximum=1024)
    got = files.chunk_files(listing, str(tmp_path), block=5000, **small).collect()
    for name in sizes:
        data = (tmp_path / name).read_bytes()
        rows = sorted((r for r in got if r.path == name), key=lambda r: r.chunk_index)
        assert b"".join(bytes(r.payload) for r in rows) == data
        ends = chunking.cut_points(np.array([0, len(data)]), np.frombuffer(data, np.uint8), tuple(small.values()))[0]
        assert [r.offset + r.size for r in rows] == ends
    assert files.chunk_files(listing, str(tmp_path)).agg(F.sum("size")).first()[0] == sum(sizes.values())


def test_file_addresses_follow_no_links(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "real" / "a b.txt").write_bytes(b"x")
    (tmp_path / "link.txt").symlink_to(tmp_path / "real" / "a b.txt")
    (tmp_path / "loop").symlink_to(tmp_path)
    listed = files.list_files(spark, tmp_path.as_uri())
    assert [r.path for r in listed.collect()] == ["real/a b.txt"]
    assert bytes(files.read_contents(listed, tmp_path.as_uri()).first().content) == b"x"


def test_files_that_vanish_are_rows(spark, tmp_path):
    (tmp_path / "kept").write_bytes(b"abc")
    (tmp_path / "gone").write_bytes(b"abc")
    listed = files.list_files(spark, str(tmp_path))
    paths = listed.select("path").collect()
    (tmp_path / "gone").unlink()
    listed = spark.createDataFrame(paths, "path string")
    read = {r.path: (r.content and bytes(r.content), r.error) for r in files.read_contents(listed, str(tmp_path)).collect()}
    assert read["kept"] == (b"abc", None) and read["gone"][0] is None and read["gone"][1].startswith("READ_ERROR")
    chunks = {r.path: (r.size, r.error) for r in files.chunk_files(listed, str(tmp_path)).collect()}
    assert chunks["kept"] == (3, None) and chunks["gone"][0] is None and chunks["gone"][1].startswith("READ_ERROR")


SMALL = dict(minimum=64, average=256, maximum=1024)


def test_blocks_of_one_file_give_the_cuts_of_the_whole(spark, tmp_path):
    pick = random.Random(12)
    contents = {
        "random": pick.randbytes(200_000),
        "zeros": bytes(50_001),
        "mixed": pick.randbytes(7_001) + bytes(30_000) + pick.randbytes(20_000),
        "periodic": pick.randbytes(700) * 90,
        "empty": b"",
        "tiny": b"x" * 63,
        "edge": pick.randbytes(4096),
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    listing = files.list_files(spark, str(tmp_path))
    for block in (64, 1000, 4096, 1 << 20):
        if block == 64:
            wanted = listing.where("path IN ('tiny', 'edge', 'empty')")
        else:
            wanted = listing.unionByName(listing)
        rows = files.chunk_blocks(wanted, str(tmp_path), block=block, **SMALL).collect()
        assert all(r.error is None for r in rows)
        for name in {r.path for r in wanted.collect()}:
            data, mine = contents[name], sorted((r for r in rows if r.path == name), key=lambda r: r.chunk_index)
            ends = chunking.cut_points(np.array([0, len(data)]), np.frombuffer(data, np.uint8), tuple(SMALL.values()))[0]
            assert [r.offset + r.size for r in mine] == ends, (name, block)
            assert [r.chunk_index for r in mine] == list(range(len(ends)))
    cuts = files.chunk_blocks(listing, str(tmp_path), block=4096, **SMALL)
    read = files.chunk_payloads(cuts, str(tmp_path), block=4096).collect()
    for name, data in contents.items():
        mine = sorted((r for r in read if r.path == name), key=lambda r: r.offset)
        assert b"".join(bytes(r.payload) for r in mine) == data


def test_blocks_that_cannot_be_read_refuse_their_file(spark, tmp_path):
    (tmp_path / "kept").write_bytes(b"abc" * 1000)
    (tmp_path / "shrunk").write_bytes(b"abc" * 1000)
    listed = spark.createDataFrame(
        [("kept", 3000), ("shrunk", 9000), ("gone", 5000), ("no length", None)], "path string, length bigint"
    )
    rows = files.chunk_blocks(listed, str(tmp_path), block=1000, **SMALL).collect()
    assert {r.path for r in rows} == {"kept", "shrunk", "gone"}
    for name in ("shrunk", "gone"):
        (row,) = (r for r in rows if r.path == name)
        assert row.size is None and row.error.startswith("READ_ERROR")
    assert sum(r.size for r in rows if r.path == "kept") == 3000
    assert files.chunk_blocks(listed.limit(0), str(tmp_path)).collect() == []
    cut = spark.createDataFrame([("gone", 0, 0, 10, None), ("kept", 0, 2995, 10, None)], files.CUT)
    assert [r.payload for r in files.chunk_payloads(cut, str(tmp_path)).collect()] == [None, None]


def test_registered_folder_queries_equal_the_folder(spark):
    sf = "/root/testdata/sf0.001"
    here = {}
    for folder, _, names in os.walk(sf):
        for name in names:
            with open(os.path.join(folder, name), "rb") as source:
                here[os.path.relpath(os.path.join(folder, name), sf)] = source.read()
    listed = {r.path: r.length for r in content.folder_listing(spark, sf).collect()}
    assert listed == {path: len(data) for path, data in here.items()}
    sizes, found = tuple(content.FOLDER_SIZES.values()), {}
    for r in content.folder_chunks(spark, sf).orderBy("path", "chunk_index").collect():
        found.setdefault(r.path, []).append(r.offset + r.size)
    for path, data in here.items():
        assert found.get(path, []) == chunking.cut_points(np.array([0, len(data)]), np.frombuffer(data, np.uint8), sizes)[0]
