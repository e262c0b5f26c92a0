import math
import random

import pytest
from pyspark.sql import functions as F

from tesseral.operators import evaluation, filters, metrics, streams


@pytest.mark.parametrize("n,seed,block", [(1, 17, 1 << 20), (2, 0, 16), (10, 17, 3), (1000, 5, 100), (10_000, 17, 1 << 20), (10_000, 2**70 + 3, 777)])
def test_one_stream_for_all_pairs(spark, n, seed, block):
    rng, want = random.Random(seed), []
    for _ in range(n):
        two = [0, 1]
        rng.shuffle(two)
        want.append(two == [1, 0])
    got = {r.ordinal: r.swapped for r in streams.two_way_shuffles(spark, seed, n, block=block).collect()}
    assert [got[k] for k in range(n)] == want and len(got) == n


def test_blinding_by_one_stream(spark):
    rng, rows, want = random.Random(17), [], {}
    pairs = sorted((f"p{i}", s) for i in range(40) for s in (1001, 1002))
    for k, (prompt, s) in enumerate(pairs, 1):
        order = ["base", "lora"]
        rng.shuffle(order)
        for label, condition in zip("AB", order):
            rows.append((prompt, s, condition))
            want[prompt, s, condition] = (k, label)
    random.Random(1).shuffle(rows)
    got = evaluation.blinded_by_stream(spark.createDataFrame(rows, "prompt_id string, seed int, condition string"))
    assert {(r.prompt_id, r.seed, r.condition): (r.pair_number, r.blind_label) for r in got.collect()} == want
    assert streams.two_way_shuffles(spark, 1, 0).collect() == []


@pytest.mark.parametrize("bits", [None, filters.BITMAP, 3 * filters.BITMAP])
def test_benchmark_rows_go_and_no_others(spark, bits):
    rng = random.Random(6)
    keys = [f"h{i}" for i in range(30_000)]
    bench = keys[:20_000]  # far too many for one bitmap: nearly all rows are suspects, and all the same are right
    rows = [(i, rng.sample(keys, 3) if i % 4 else [f"x{i}", None], "text") for i in range(2000)] + [(7, ["x"], "text")] * 2 + [(9, None, "null"), (10, [], "none")]
    df = spark.createDataFrame(rows, "id int, h array<string>, __filter string")
    got = metrics.without_benchmark(df.withColumnRenamed("__filter", "more"), "h", spark.createDataFrame([(b,) for b in bench] + [(None,)], "b string"), "b", bits=bits)
    known = set(bench)
    want = sorted((i, tuple(h or ())) for i, h, _ in rows if not known & set(h or ()))
    assert sorted((r.id, tuple(r.h or ())) for r in got.collect()) == want and got.columns == ["id", "h", "more"]


def test_bloom_filters_pass_all_keys_and_few_others(spark):
    keys = spark.range(5000).selectExpr("cast(id as string) as k")
    bits = filters.bits_for(5000)
    assert filters.bits_for(0) == filters.BITMAP and filters.bits_for(10**12) == filters.MOST_BITS and bits == 3 * filters.BITMAP
    asked = spark.range(50_000).selectExpr("id", "cast(id as string) as k")
    arrays = asked.selectExpr("id", "case when id % 3 = 0 then array(k, null) when id % 3 = 1 then array('none', k) else array() end as ks")
    some = {r.id for r in arrays.where(filters.any_might(keys, "k", bits, "ks")).select("id").collect()}
    assert {i for i in range(5000) if i % 3 < 2} <= some and not any(i % 3 == 2 for i in some) and len(some) < 4500
    got = asked.select("id", filters.might_have(filters.bloom(keys, "k", bits), F.col("k"), bits).alias("m")).where("m").collect()
    passed = {r.id for r in got}
    assert set(range(5000)) <= passed and len(passed) - 5000 < 0.02 * 45_000
    # whole rows stay where they are: only suspects are joined
    rows = spark.range(1000).selectExpr("id", "array(cast(id + 10000 as string)) as h")
    plan = metrics.without_benchmark(rows, "h", keys, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "__key" not in plan and "Union" in plan and plan.index("Union") < plan.index("Join")


def test_sketches_merge_within_their_bound(spark):
    rows = spark.range(200_000).selectExpr("id", "id % 7 as day", "case when id % 2 = 0 then 'a' else 'b' end as model", "cast(id * 7919 % 200003 as double) as ms")
    days = metrics.latency_sketches(rows, ["day", "model"], "ms")
    assert days.count() == 14
    got = metrics.sketched_quantiles(metrics.merged_sketches(days, ["model"]), {"p50": 0.5, "p95": 0.95}).collect()
    whole = {r.model: r for r in metrics.sketched_quantiles(metrics.latency_sketches(rows, ["model"], "ms"), {"p50": 0.5, "p95": 0.95}).collect()}
    for r in got:
        values = [v.ms for v in rows.where(F.col("model") == r.model).select("ms").collect()]
        assert r.n == len(values) == 100_000
        for q, merged, one in ((0.5, r.p50, whole[r.model].p50), (0.95, r.p95, whole[r.model].p95)):
            for v in (merged, one):
                assert abs(sum(x <= v for x in values) / len(values) - q) <= 2 * metrics.rank_error()
    assert metrics.latency_sketches(rows.limit(0), ["model"], "ms").count() == 0


def tail(k, n, p):
    """P(X >= k) of the binomial distribution."""
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))


def test_exact_lower_bounds(spark):
    cases = [(1, 1), (1, 2), (3, 40), (39, 40), (40, 40), (0, 10), (90, 100), (950, 1000), (2, 5000), (2500, 5000)]
    df = spark.createDataFrame(cases, "k int, n int")
    got = {(r.k, r.n): r.lower for r in df.withColumn("lower", metrics.exact_lower(F.col("k"), F.col("n"))).collect()}
    for k, n in cases:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if k and tail(k, n, mid) < 0.05 else (lo, mid)
        assert got[k, n] == pytest.approx(lo if k else 0.0, abs=1e-9), (k, n)
    assert got[40, 40] == pytest.approx(0.05 ** (1 / 40), abs=1e-12)


def test_threshold_by_either_bound(spark):
    rng = random.Random(2)
    scored = [(i, c := round(rng.random(), 3), int(rng.random() < 0.55 + 0.45 * c)) for i in range(600)]
    df = spark.createDataFrame(scored, "i int, c double, y int")
    at = {b: metrics.calibrated_threshold(df, "c", "y", precision=0.85, coverage=0.2, bound=b).first() for b in ("wilson", "exact")}

    def lowest():
        for c in sorted({c for _, c, _ in scored}):
            kept = [y for _, x, y in scored if x >= c]
            if len(kept) < 0.2 * len(scored):
                return None
            if tail(sum(kept), len(kept), 0.85) <= 0.05:
                return c

    assert at["exact"].c == lowest() and at["exact"].lower >= 0.85 and at["wilson"].c <= at["exact"].c
    with pytest.raises(ValueError):
        metrics.calibrated_threshold(df, "c", "y", bound="other")
