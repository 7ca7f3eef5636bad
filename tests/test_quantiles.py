"""Band-refined exact quantiles equal Spark's exact ``percentile``."""

import random

import pytest
from pyspark.sql import functions as F

from pressroom.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles_match_percentile(spark, accuracy):
    rnd = random.Random(7)
    rows = [("hot", rnd.gauss(0, 10)) for _ in range(6000)]            # continuous, hot group
    rows += [("ties", float(rnd.randint(0, 5))) for _ in range(3000)]  # heavy ties
    rows += [("one", 3.5), ("nulls", None), ("nulls", 1.0), ("nulls", 2.0)]
    rows += [("hot", float("nan"))] * 7
    rows += [("small", float(x)) for x in (1, 2, 3, 4, 5, 6, 7, 8, 50)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.25, 0.5, 0.75, 0.0, 1.0, 0.9]
    got = {r.g: [r[f"q{i}"] for i in range(len(probs))] + [r.n]
           for r in exact_quantiles(df, ["g"], "v", probs, accuracy=accuracy).collect()}
    exp = {r.g: list(r.q) + [r.n] for r in
           df.filter(~F.isnan("v")).groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q"),
                                F.count("v").alias("n")).collect()}
    assert got.keys() == exp.keys()
    for g in exp:
        assert got[g] == pytest.approx(exp[g], rel=1e-12, abs=1e-12), g


def test_failed_brackets_fall_back_to_whole_range(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame([("g", rnd.random()) for _ in range(3000)] + [("h", float(i % 7)) for i in range(900)],
                               "g string, v double")
    probs = [0.1, 0.5, 0.99]
    got = {r.g: [r[f"q{i}"] for i in range(3)] for r in
           exact_quantiles(df, ["g"], "v", probs, accuracy=100, margin=0.0).collect()}
    exp = {r.g: list(r.q) for r in
           df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    for g in exp:
        assert got[g] == pytest.approx(exp[g], rel=1e-12, abs=1e-12), g
