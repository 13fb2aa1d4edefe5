import math

import pytest
from pyspark.sql import functions as F

from gridcast.functions import expr as X
from gridcast.functions.draws import uniform
from gridcast.functions.special import log_gamma, normal_two_sided_p
from gridcast.operators import significance


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("double")


def test_pythagorean(spark):
    assert one(spark, X.pythagorean(lit(400.0), lit(300.0))) == pytest.approx(0.6641, abs=1e-3)
    for pf, pa in ((0.0, 10.0), (10.0, 0.0), (-1.0, 5.0), (float("nan"), 5.0), (float("inf"), 5.0), (None, 5.0)):
        assert one(spark, X.pythagorean(lit(pf), lit(pa))) is None


def test_log5_is_complementary(spark):
    a, b = one(spark, X.log5(lit(0.7), lit(0.4))), one(spark, X.log5(lit(0.4), lit(0.7)))
    assert a + b == pytest.approx(1.0, abs=1e-12)
    assert one(spark, X.log5(lit(1.0), lit(1.0))) == 0.5


def test_logistic_limits(spark):
    assert one(spark, X.sigmoid(lit(-800.0))) == 0.0
    assert one(spark, X.sigmoid(lit(800.0))) == 1.0
    assert one(spark, X.sigmoid(X.logit(lit(0.3)))) == pytest.approx(0.3, abs=1e-12)
    assert one(spark, X.logit(lit(0.0))) == pytest.approx(math.log(1e-6 / (1 - 1e-6)), rel=1e-9)


def test_home_field(spark):
    assert one(spark, X.with_home_field(lit(0.5), F.lit(False))) == pytest.approx(1 / (1 + math.exp(-0.25)))
    assert one(spark, X.with_home_field(lit(0.5), F.lit(None).cast("boolean"))) == pytest.approx(1 / (1 + math.exp(-0.25)))
    assert one(spark, X.with_home_field(lit(0.5), F.lit(True))) == 0.5


def test_shrinkage_null_rules(spark):
    n = F.lit(4)
    none = lit(None)
    assert one(spark, X.shrink(lit(20.0), n, lit(10.0))) == 15.0
    assert one(spark, X.shrink(none, F.lit(0), lit(10.0))) == 10.0
    assert one(spark, X.shrink(lit(20.0), n, none)) == 20.0
    assert one(spark, X.shrink(none, F.lit(0), none)) is None
    assert one(spark, X.shrink_weight(lit(20.0), n, none)) == 1.0
    assert one(spark, X.shrink_weight(none, F.lit(0), lit(10.0))) == 0.0


def test_payout_and_kelly(spark):
    assert one(spark, X.home_payout(lit(0.0), lit(1.0))) == 0.5
    assert one(spark, X.away_payout(lit(0.0), lit(1.0))) == 0.5
    assert one(spark, X.kelly_fraction(lit(0.55), lit(2.0))) == 0.05
    assert one(spark, X.kelly_fraction(lit(0.3), lit(2.0))) == 0.0
    assert one(spark, X.kelly_fraction(lit(0.9), lit(1.0))) == 0.0


def test_reliability_bin_edges(spark):
    values = [i / 100 for i in range(101)] + [0.3, 0.6, 0.7, 0.1 + 0.2]
    got = [r["b"] for r in spark.createDataFrame([(v,) for v in values], "p double").select(X.reliability_bin(F.col("p")).alias("b")).collect()]
    width = 1.0 / 10
    for v, b in zip(values, got):
        want = next(i for i in range(10) if i * width <= v < (i + 1) * width or (i == 9 and v == (i + 1) * width))
        assert b == want, v


def test_special_functions(spark):
    rows = [(float(x),) for x in (1, 2, 3.5, 10, 123, 10001, 1e7)]
    for r in spark.createDataFrame(rows, "z double").select("z", log_gamma(F.col("z")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["z"]), rel=1e-13, abs=1e-11)
    zs = [(z,) for z in (0.0, 0.5, -1.96, 2.9, 3.1, 6.0)]
    for r in spark.createDataFrame(zs, "z double").select("z", normal_two_sided_p(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-8, abs=1e-13)


def test_exact_tests(spark):
    df = spark.createDataFrame([(1, 3, 1, 1, 3)], "k int, a int, b int, c int, d int")
    assert significance.fisher_exact(df, ["k"]).first()["fisher_p"] == pytest.approx(0.4857, abs=1e-4)
    pairs = spark.createDataFrame([(1, 10, 2), (2, 0, 0), (3, 5, 5)], "k int, x int, y int")
    got = {r["k"]: r["mcnemar_p"] for r in significance.mcnemar_exact(pairs, ["k"], "x", "y").collect()}
    assert got[1] == pytest.approx(0.0386, abs=1e-4)
    assert got[2] == 1.0 and got[3] == 1.0


def test_exact_tests_across_chunks(spark):
    df = spark.createDataFrame([(1, 50000, 50000, 50400, 49600)], "k int, a int, b int, c int, d int")
    p = significance.fisher_exact(df, ["k"]).first()["fisher_p"]
    z = 0.004 / math.sqrt(0.502 * 0.498 * 2 / 100000)  # the large-sample test comes close
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-3)


def test_paired_z(spark):
    d = [0.1, 0.2, -0.05, 0.3]
    df = spark.createDataFrame([(1, x) for x in d] + [(2, 1.0), (3, 1.0), (3, 1.0)], "k int, d double")
    got = {r["k"]: r for r in significance.paired_z(df, ["k"], "d").collect()}
    mean = sum(d) / 4
    sd = math.sqrt(sum((x - mean) ** 2 for x in d) / 3)
    assert got[1]["z"] == pytest.approx(mean / (sd / 2))
    assert got[2]["z"] is None and got[3]["z"] is None


def test_uniform_is_plain_arithmetic(spark):
    assert one(spark, uniform(7, 3, 15)) == pytest.approx(0.27700687286038783, abs=0)


def _tail(n_terms, ratio, start, limit):
    """Sum of a unimodal law outwards from ``start`` (weight 1) until terms vanish, with 30 digits: {x: weight}."""
    from decimal import Decimal, localcontext

    with localcontext() as context:
        context.prec = 30
        weights = {start: Decimal(1)}
        for step in (1, -1):
            x, w = start, Decimal(1)
            while 0 <= x + step <= n_terms and w > limit:
                top, bottom = ratio(x) if step == 1 else ratio(x - 1)[::-1]
                w = w * top / bottom
                x += step
                weights[x] = w
        return weights


@pytest.mark.parametrize("a, row1, row2, col1", [(5_000_800, 10**7, 10**7, 10**7), (1_200, 10**7, 3 * 10**6, 1_500), (3, 5, 10**7, 4)])
def test_fisher_keeps_its_digits_at_large_counts(spark, a, row1, row2, col1):
    from decimal import Decimal

    from gridcast.operators import significance

    mode = (row1 + 1) * (col1 + 1) // (row1 + row2 + 2)
    weights = _tail(min(row1, col1), lambda x: ((row1 - x) * (col1 - x), (x + 1) * (row2 - col1 + x + 1)), mode, Decimal("1e-20"))
    want = sum(w for w in weights.values() if w <= weights[a] * (1 + Decimal("1e-7"))) / sum(weights.values())
    df = spark.createDataFrame([(1, a, row1 - a, col1 - a, row2 - col1 + a)], "k int, a long, b long, c long, d long")
    assert significance.fisher_exact(df, ["k"]).first()["fisher_p"] == pytest.approx(float(want), rel=1e-9)


@pytest.mark.parametrize("x, y", [(500_000, 501_000), (10, 12), (0, 0), (0, 40)])
def test_mcnemar_keeps_its_digits_at_large_counts(spark, x, y):
    from decimal import Decimal

    from gridcast.operators import significance

    n, k = x + y, min(x, y)
    weights = _tail(n, lambda i: (n - i, i + 1), n // 2, Decimal("1e-20"))
    want = min(1, 2 * sum(w for i, w in weights.items() if i <= k) / sum(weights.values()))
    df = spark.createDataFrame([(1, x, y)], "k int, x long, y long")
    assert significance.mcnemar_exact(df, ["k"], "x", "y").first()["mcnemar_p"] == pytest.approx(float(want), rel=1e-9)


def test_log_gamma_step(spark):
    from fractions import Fraction

    from gridcast.functions.special import log_gamma_step

    rows = [(1.0, 0.0), (1.0, 5.0), (6.0, -5.0), (1e7, 3.0), (1e7, -3.0), (123.0, 50.0)]
    for r in spark.createDataFrame(rows, "y double, k double").select("y", "k", log_gamma_step(F.col("y"), F.col("k")).alias("g")).collect():
        low, high = int(min(r["y"], r["y"] + r["k"])), int(max(r["y"], r["y"] + r["k"]))
        product = math.prod((Fraction(i) for i in range(low, high)), start=Fraction(1))
        want = (math.log(product.numerator) - math.log(product.denominator)) * (1 if r["k"] >= 0 else -1)
        assert r["g"] == pytest.approx(want, abs=1e-12, rel=1e-14)
