import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vv

SCHEMA = f"a {vv.VV_TYPE}, b {vv.VV_TYPE}"


def relation(a, b):
    ahead = any(c > b.get(d, 0) for d, c in a.items())
    behind = any(c > a.get(d, 0) for d, c in b.items())
    return {(0, 0): "EQUAL", (1, 0): "DESCENDANT", (0, 1): "ANCESTOR", (1, 1): "CONCURRENT"}[(ahead, behind)]


def entries(vector):
    return sorted(vector.items())


def test_relation_merge_and_order_agree_with_definition(spark):
    rng = random.Random(7)
    make = lambda: {d: rng.randint(1, 3) for d in "abcd" if rng.random() < 0.6}
    pairs = [(make(), make()) for _ in range(200)] + [({}, {}), ({"a": 1}, {})]
    df = spark.createDataFrame([(entries(a), entries(b)) for a, b in pairs], SCHEMA)
    rows = df.select(
        "a",
        "b",
        vv.vv_relation(F.col("a"), F.col("b")).alias("fwd"),
        vv.vv_relation(F.col("b"), F.col("a")).alias("bwd"),
        vv.vv_merge(F.col("a"), F.col("b")).alias("m"),
        vv.vv_ge(F.col("a"), F.lit("r"), F.col("b"), F.lit("r")).alias("ge"),
    ).collect()
    swap = {"EQUAL": "EQUAL", "CONCURRENT": "CONCURRENT", "ANCESTOR": "DESCENDANT", "DESCENDANT": "ANCESTOR"}
    for row in rows:
        a, b = dict(map(tuple, row.a)), dict(map(tuple, row.b))
        assert row.fwd == relation(a, b) and row.bwd == swap[row.fwd]
        merged = {d: max(a.get(d, 0), b.get(d, 0)) for d in {*a, *b}}
        assert [tuple(e) for e in row.m] == entries(merged)
        assert relation(a, merged) in ("EQUAL", "ANCESTOR")
        assert row.ge == (entries(a) >= entries(b))


@pytest.mark.parametrize(
    "given, plain, record",
    [
        ([("a", 1), ("b", 2)], None, None),
        ([], None, "EMPTY"),
        ([("a", 0)], "ZERO_COUNTER", "ZERO_COUNTER"),
        ([("a", 1), ("a", 2)], "DUPLICATE_DEVICE", "NOT_STRICTLY_SORTED"),
        ([("b", 1), ("a", 2)], None, "NOT_STRICTLY_SORTED"),
    ],
)
def test_validation(spark, given, plain, record):
    row = spark.createDataFrame([(given,)], f"e {vv.VV_TYPE}").select(
        vv.vv_error(F.col("e")).alias("p"),
        vv.vv_error(F.col("e"), manifest=True).alias("r"),
        vv.vv_from_entries(F.col("e")).alias("v"),
    ).first()
    assert (row.p, row.r) == (plain, record)
    assert (row.v is None) == (plain is not None)
    if row.v is not None:
        assert [tuple(e) for e in row.v] == sorted(given)


def test_counter_increment_and_overflow(spark):
    df = spark.createDataFrame([([("a", 1)], [("a", vv.LONG_MAX)])], SCHEMA)
    row = df.select(
        vv.vv_counter(F.col("a"), F.lit("a")).alias("known"),
        vv.vv_counter(F.col("a"), F.lit("z")).alias("unknown"),
        vv.vv_text(vv.vv_increment(F.col("a"), F.lit("0"))).alias("joined"),
        vv.vv_label(F.col("a")).alias("label"),
        vv.vv_label(F.array().cast(vv.VV_TYPE)).alias("nobody"),
    ).first()
    assert tuple(row) == (1, 0, "0:1,a:1", "device-a", "device")
    with pytest.raises(Exception, match="OVERFLOW"):
        df.select(vv.vv_increment(F.col("b"), F.lit("a"))).collect()


def test_label_prefers_counter_then_device(spark):
    df = spark.createDataFrame([([("aaaaaaaa-1", 3), ("bbbbbbbb-2", 3), ("cccccccc-3", 1)], [])], SCHEMA)
    assert df.select(vv.vv_label(F.col("a"))).first()[0] == "device-bbbbbbbb"


def test_null_is_not_the_empty_vector(spark):
    df = spark.createDataFrame([(None, [])], SCHEMA)
    row = df.select(
        vv.vv_relation(F.col("a"), F.col("b")).alias("r"), vv.vv_counter(F.col("a"), F.lit("x")).alias("c")
    ).first()
    assert tuple(row) == (None, None)


def test_malformed_vectors_do_not_abort(spark):
    twice = [("a", 1), ("a", 2)]
    none = [(None, 1)]
    df = spark.createDataFrame(
        [(1, twice, [("a", 1)]), (2, [("a", 1)], none), (3, [("a", 2)], [("a", 1)])],
        f"i int, l {vv.VV_TYPE}, r {vv.VV_TYPE}",
    )
    rows = {
        r.i: (r.m, r.rel)
        for r in df.select("i", vv.vv_merge(F.col("l"), F.col("r")).alias("m"), vv.vv_relation(F.col("l"), F.col("r")).alias("rel")).collect()
    }
    assert rows[1] == (None, None) and rows[2] == (None, None)
    assert [tuple(e) for e in rows[3][0]] == [("a", 2)] and rows[3][1] == "DESCENDANT"
