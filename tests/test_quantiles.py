import random

import pytest
from pyspark.sql import functions as F

from twinfold.operators import checks, sanity, summaries
from twinfold.operators.quantiles import exact_quantiles, quantile_struct

SHARES = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}


def expected(rows, keys):
    found = rows.groupBy(*keys).agg(F.percentile("v", list(SHARES.values())).alias("p"))
    return {tuple(r[k] for k in keys): r["p"] for r in found.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_percentile(spark, seed):
    rnd = random.Random(seed)
    draw = [lambda: rnd.uniform(-5, 5), lambda: rnd.choice([0.0, 1.0, 50000.0]), lambda: rnd.lognormvariate(0, 9),
            lambda: -float(rnd.randrange(10**12))]
    data = [(f"g{i % 4}", draw[i % 4]() if rnd.random() < 0.95 else None) for i in range(rnd.randrange(3, 900))]
    rows = spark.createDataFrame(data, "k string, v double")
    counted = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = exact_quantiles(counted, ["k"], "v", "n", SHARES).collect()
    assert len(got) == len({r["k"] for r in got})
    want = expected(rows.where("v is not null"), ["k"])
    assert {r["k"] for r in got} == {k for k, in want}
    for r in got:
        assert [r[n] for n in SHARES] == want[r["k"],]
    whole = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    assert [[r[n] for n in SHARES] for r in exact_quantiles(whole, [], "v", "n", SHARES).collect()] == [expected(rows, [])[()]]


def test_empty_single_and_hot_value(spark):
    empty = spark.createDataFrame([], "v double, n bigint")
    assert [tuple(r) for r in exact_quantiles(empty, [], "v", "n", {"m": 0.5}).collect()] == [(None,)]
    assert exact_quantiles(empty.withColumn("k", F.lit("x")), ["k"], "v", "n", {"m": 0.5}).count() == 0
    one = spark.createDataFrame([(7.0, 1)], "v double, n bigint")
    assert spark.range(1).select(quantile_struct(one, "v", "n", {"m": 0.5})["m"]).first()[0] == 7.0
    hot = spark.createDataFrame([(1.0, 10**12), (2.0, 10**12), (float("inf"), 1)], "v double, n bigint")
    assert exact_quantiles(hot, [], "v", "n", {"m": 0.5, "top": 1.0}).first() == (2.0, float("inf"))


def test_no_plan_gathers_values(spark):
    money = "pair_id string, old_salary string, new_salary string"
    pairs = spark.createDataFrame([("p", "1", "3")], money)
    people = spark.createDataFrame([(0, "a", "d", "t", "5")], "src_ord bigint, worker_id string, department string, job_title string, salary string")
    frames = [summaries.salary_change_stats(pairs), sanity.salary_delta_buckets(pairs), checks.salary_statistics(people),
              checks.median_by(people.withColumn("v", F.col("salary").cast("double")), ["department"], "v")]
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in plan and "median(" not in plan
