"""Poisson draws by quantile against the distribution itself, at small and very large rates."""

import math

from pyspark.sql import functions as F

from plumbline.operators import stats as ST


def plain_cdf(rate, k):
    return sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(max(0, int(rate - 12 * rate**0.5 - 40)), k + 1))


def test_poisson_table_is_the_distribution(spark):
    rates = [1, 2, 7, 29, 30, 31, 400, 12_345]
    table = {r.units: r for r in ST.poisson_table(spark.createDataFrame([(x,) for x in rates * 2], "units long")).collect()}
    assert sorted(table) == rates
    for x, r in table.items():
        assert all(a <= b for a, b in zip(r.cdf, r.cdf[1:])) and r.cdf[-1] == 1.0
        for k in (r.lo, x - 1, x, x + int(2 * x**0.5)):
            if k >= r.lo:
                assert abs(r.cdf[k - r.lo] - plain_cdf(x, k)) < 1e-9


def test_draws_have_the_right_moments(spark):
    for rate in (3, 29, 30, 5_000, 100_000_000):
        table = ST.poisson_table(spark.createDataFrame([(rate,)], "units long"))
        us = F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.col("lo") + ST.below(F.col("cdf"), F.col("steps"), (i + 0.5) / 20_000))
        d = table.select(F.explode(us).alias("w")).agg(F.avg("w"), F.variance("w")).first()
        assert abs(d[0] - rate) < 0.01 * math.sqrt(rate) and abs(d[1] / rate - 1) < 0.01


def test_below_counts_smaller_entries(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5, 0.9], u) for u in (0.0, 0.1, 0.11, 0.5, 0.51, 0.95)] + [([], 0.5)], "c array<double>, u double")
    assert [r[0] for r in df.select(ST.below(F.col("c"), ST.halvings("c"), F.col("u"))).collect()] == [0, 0, 1, 1, 3, 4, 0]
