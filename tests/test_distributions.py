import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import distributions as D


def p(spark, column):
    return spark.range(1).select(column.alias("p")).first()["p"]


@pytest.mark.parametrize("column,expected", [
    (lambda: D.t_pvalue(F.lit(2.0), F.lit(10)), 0.0733880347707),
    (lambda: D.t_pvalue(F.lit(-1.0), F.lit(1)), 0.5),
    (lambda: D.t_pvalue(F.lit(0.0), F.lit(5.5)), 1.0),
    (lambda: D.t_pvalue(F.lit(1.959963984540054), F.lit(10_000_000)), 0.05),
    (lambda: D.f_pvalue(F.lit(3.0), F.lit(2), F.lit(20)), 1.3 ** -10),
    (lambda: D.f_pvalue(F.lit(1.0), F.lit(2000), F.lit(2000)), 0.5),
    (lambda: D.f_pvalue(F.lit(0.0), F.lit(4), F.lit(7)), 1.0),
    (lambda: D.chi2_pvalue(F.lit(3.841458820694124), F.lit(1)), 0.05),
    (lambda: D.chi2_pvalue(F.lit(4.0), F.lit(2)), math.exp(-2.0)),
    (lambda: D.chi2_pvalue(F.lit(10.0), F.lit(4)), 6 * math.exp(-5.0)),
    (lambda: D.normal_two_sided_p(F.lit(1.959963984540054)), 0.05),
])
def test_tail_probabilities(spark, column, expected):
    assert p(spark, column()) == pytest.approx(expected, rel=1e-6)


def test_small_tails_keep_their_size(spark):
    assert p(spark, D.chi2_pvalue(F.lit(80.0), F.lit(2))) == pytest.approx(math.exp(-40.0), rel=1e-6)
    assert p(spark, D.chi2_pvalue(F.lit(5.0), F.lit(0))) is None
    assert p(spark, D.f_pvalue(F.lit(None), F.lit(1), F.lit(1))) is None
