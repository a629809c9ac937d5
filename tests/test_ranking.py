import random

from tidemark.operators import ranking, requests
from tidemark.operators.manifests import missing_objects


def test_small_groups_are_ranked_after_one_shuffle(spark):
    df = spark.createDataFrame([(k % 50, k * 2**40) for k in range(500)], "k bigint, v bigint")
    plan = ranking.dense_rank(df, "v", by=["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_small_and_large_groups_have_the_same_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "GROUP_ROWS", 20)
    rng = random.Random(8)
    sizes = {"a": 20, "b": 21, "c": 150, None: 90, "d": 1}
    rows = [(k, v) for k, n in sizes.items() for v in [None, *rng.sample(range(-(2**20), 2**45), n - 1)]]
    ranked = ranking.dense_rank(spark.createDataFrame(rows, "k string, v bigint"), "v", by=["k"])
    assert dict(ranked.dtypes)["rank"] == "bigint"
    got = ranked.collect()
    assert len(got) == len(rows)
    for key in sizes:
        mine = sorted((r for r in got if r.k == key), key=lambda r: (r.v is not None, r.v or 0))
        assert [r["rank"] for r in mine] == list(range(1, sizes[key] + 1))


def test_what_is_missing_is_found_once_for_all_requests(spark):
    wanted = spark.createDataFrame([("p", f"{i:064x}") for i in range(50)] * 2, "peer string, content_id string")
    have = spark.createDataFrame([(f"{i:064x}", True) for i in range(10)], "content_id string, available boolean")
    out = requests.request_batches(missing_objects(wanted, have, ["peer"]), ["peer"], n=16)
    assert "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.request: r.content_ids for r in out.collect()}
    assert got == {k: [f"{i:064x}" for i in range(10, 50)][16 * (k - 1) : 16 * k] for k in (1, 2, 3)}
