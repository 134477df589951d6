"""Order statistics and histograms over infinities, NaN and the whole range of 64-bit integers."""

import pytest

from tablemodels.operators import order, profile

INF = float("inf")


@pytest.mark.parametrize("values", [
    [1.0, -INF, INF, 2.0, INF, 0.5, -1.5], [INF, INF, -INF], [1.7e308, -1.7e308, 0.0, 1.0], [-INF, 3.0],
    [2**63 - 1, -(2**63), 0, 5, -7], [2**62, -(2**62), 2**62 + 1, 1], [3, 1, 2, 2],
])
def test_every_rank(spark, values):
    kind = "double" if isinstance(values[0], float) else "long"
    df = spark.createDataFrame([(v,) for v in values + [None]], f"v {kind}").repartition(3)
    got = order.order_statistics(df, "v", list(range(len(values))), bins=4)
    assert [got[r] for r in range(len(values))] == sorted(values)


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)] + [(float("nan"),), (None,)], "v double")
    rows = profile.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [20] * 5 and rows[0]["lower"] == 0.0 and rows[-1]["upper"] == 99.0
