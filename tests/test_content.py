import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.operators import chunking, integrity
from tidemark.operators import manifests as mf

SMALL = (64, 256, 1024)


def noise(n, seed=1):
    return random.Random(seed).randbytes(n)


def cuts(data, sizes=SMALL):
    return chunking.cut_points(np.array([0, len(data)]), np.frombuffer(data, np.uint8), sizes)[0]


def slow_cuts(data, sizes=SMALL):
    """The same rule, one byte at a time."""
    minimum, average, maximum = sizes
    strict, loose = (int(m) for m in chunking._masks(average))
    gear = [int(g) for g in chunking.GEAR]
    out, start, hashes, h = [], 0, [], 0
    for byte in data:
        h = ((h << 1) + gear[byte]) % 2**64
        hashes.append(h)
    while start < len(data):
        end = min(start + maximum, len(data))
        cut = end
        for p in range(start + minimum, end):
            mask = strict if p < start + average else loose
            if hashes[p - 1] & mask == 0:
                cut = p
                break
        out.append(cut)
        start = cut
    return out


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 300, 5000, 40_000])
def test_cuts_match_a_byte_at_a_time_scan(size):
    data = noise(size, seed=size)
    assert cuts(data) == slow_cuts(data)


def test_cuts_do_not_depend_on_neighbours_or_block_edges():
    values = [noise(n, seed=n) for n in (700, 0, 90_000, 64, 3000)]
    joined = b"".join(values)
    offsets = np.cumsum([0] + [len(v) for v in values])
    together = chunking.cut_points(offsets, np.frombuffer(joined, np.uint8), SMALL)
    for start, value, found in zip(offsets, values, together):
        assert [c - start for c in found] == cuts(value)
    big = noise(chunking.BLOCK + 5000, seed=9)
    tail = cuts(big)
    assert tail[-1] == len(big) and tail == slow_cuts(big)


def test_sizes_are_within_bounds_and_average_is_near():
    found = cuts(noise(400_000))
    sizes = np.diff([0] + found)
    assert sizes.max() <= 1024 and sizes[:-1].min() >= 64
    assert 150 < sizes.mean() < 450


def test_configuration_rules():
    assert chunking.size_error(*chunking.DEFAULT_SIZES) is None
    assert chunking.size_error(1, 256, 1024) == "MINIMUM_SIZE_OUT_OF_RANGE"
    assert chunking.size_error(64, 300, 1024) == "AVERAGE_SIZE_NOT_POWER_OF_TWO"
    assert chunking.size_error(512, 256, 1024) == "INVALID_SIZE_ORDER"


def test_small_insertion_reuses_most_bytes(spark):
    before = noise(64 * 1024)
    after = before[:30_000] + b"inserted text" + before[30_000:]
    df = spark.createDataFrame([(1, before), (2, after), (3, b"")], "id bigint, content binary")
    chunks = chunking.cdc_chunk(df, "id", "content", *SMALL, key="k").cache()
    assert chunks.where("id = 3").count() == 0
    refs = chunks.select(F.col("id").alias("manifest_id"), "chunk_index", "content_id", "size")
    have = chunks.where("id = 1").select("content_id", F.lit(True).alias("available")).distinct()
    plan = mf.delta_plan(mf.delta_required(refs.where("manifest_id = 2"), have)).first()
    assert plan.reused_bytes + plan.transfer_bytes == len(after)
    assert plan.reused_bytes > len(after) // 2 > plan.transfer_bytes
    ordered = chunks.where("id = 2").orderBy("chunk_index").collect()
    assert b"".join(r.payload for r in ordered) == after
    assert ordered[0].content_id == hashlib.sha256(b"kchunk\0" + ordered[0].payload).hexdigest()


def test_repeated_chunk_is_transferred_once(spark):
    refs = spark.createDataFrame([(1, 0, "x", 10), (1, 1, "x", 10)], "manifest_id int, chunk_index int, content_id string, size bigint")
    none = spark.createDataFrame([], "content_id string, available boolean")
    row = mf.delta_plan(mf.delta_required(refs, none)).first()
    assert (row.required_chunks, row.reused_chunks, row.reused_bytes, row.transfer_bytes) == (1, 1, 10, 10)
    have = spark.createDataFrame([("x", True), ("x", True)], "content_id string, available boolean")
    row = mf.delta_plan(mf.delta_required(refs, have)).first()
    assert row.is_complete and row.reused_chunks == 2


def test_hot_chunk_counts_are_whole(spark):
    refs = spark.range(30_000).select(
        (F.col("id") % 50).alias("manifest_id"),
        F.col("id").alias("chunk_index"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("content_id"),
        F.lit(2).cast("bigint").alias("size"),
    )
    none = spark.createDataFrame([], "content_id string, available boolean")
    row = mf.delta_plan(mf.delta_required(refs, none)).agg(F.sum("reused_chunks"), F.sum("transfer_bytes")).first()
    assert tuple(row) == (10_000 - 50, 2 * (20_000 + 50))


def test_statuses_of_reassembly(spark):
    manifests = spark.createDataFrame([("ok", 6), ("gone", 4), ("short", 3), ("wrong", 9), ("empty", 0), ("far", 3)], "manifest_id string, size bigint")
    refs = spark.createDataFrame(
        [("ok", 0, "a", 3), ("ok", 1, "b", 3), ("gone", 0, "b", 3), ("gone", 1, "none", 1), ("short", 0, "a", 2), ("wrong", 0, "a", 3), ("far", 0, "a", 2), ("far", 1, "none", 1)],
        "manifest_id string, chunk_index bigint, content_id string, size bigint",
    )
    payloads = spark.createDataFrame([("a", b"one"), ("b", b"two")], "content_id string, payload binary")
    parts, status = mf.reassemble(manifests, refs, payloads, part_bytes=3)
    assert {r.manifest_id: r.status for r in status.collect()} == {
        "ok": "OK", "gone": "MISSING_CHUNK", "short": "CHUNK_SIZE_MISMATCH", "wrong": "FILE_SIZE_MISMATCH", "empty": "OK", "far": "CHUNK_SIZE_MISMATCH",
    }
    assert {(r.manifest_id, r.part): bytes(r.payload) for r in parts.collect()} == {("ok", 0): b"one", ("ok", 1): b"two"}
    whole = {r.manifest_id: r.payload for r in mf.reassemble_whole(parts, status).collect()}
    assert whole["ok"] == b"onetwo" and whole["empty"] == b"" and whole["gone"] is None


def test_sealing_binds_kind_and_id(spark):
    df = spark.createDataFrame([(1, b"payload"), (2, b"payload")], "n int, payload binary")
    chunk, key = F.lit("CHUNK"), "k"
    sealed = integrity.seal(df, "payload", F.lit("g"), chunk, "0123456789abcdef", key).cache()
    a, b = sealed.collect()
    assert a.content_id == b.content_id and a.ciphertext != b.ciphertext

    def status(frame, group="g", kind="CHUNK", cid=F.col("content_id"), secret="0123456789abcdef"):
        return integrity.open_sealed(frame, F.lit(group), F.lit(kind), cid, secret, key).first().status

    assert status(sealed) == "OK"
    assert status(sealed, group="other") == "AUTH_FAILED"
    assert status(sealed, kind="MANIFEST") == "BAD_KIND"
    assert status(sealed, cid=F.lit("x")) == "BAD_ID"
    assert status(sealed, secret="fedcba9876543210") == "AUTH_FAILED"
    forged = integrity.seal(df, "payload", F.lit("g"), chunk, "0123456789abcdef", "another key")
    assert status(forged) == "ID_MISMATCH"
    domains = df.select(*[ids.content_id(F.col("payload"), d, key) for d in (ids.CHUNK, ids.MANIFEST, ids.PATH)]).first()
    assert len(set(domains)) == 3
