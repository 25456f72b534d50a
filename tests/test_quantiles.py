import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qualframe.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("small, read_out", [(10**7, 10), (0, 4096), (0, 3), (0, 0)])
def test_matches_linear_interpolation(spark, small, read_out):
    rng = np.random.default_rng(5)
    columns = {
        "normal": rng.normal(size=3000),
        "ties": rng.integers(0, 4, 3000).astype(float),
        "ends": np.array([0.0] * 1499 + [1.0] * 2 + [2.0] * 1499),
        "wide": 10 ** rng.uniform(-9, 9, 3000),
    }
    rows = [tuple(map(float, r)) for r in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in columns))
    got = exact_quantiles(df, {n: F.col(n) for n in columns}, [0.0, 0.25, 0.5, 0.75, 1.0], small, read_out)
    for name, values in columns.items():
        count, found = got[name]
        assert count == 3000
        assert found == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0]).tolist(), rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1.0, 2.0]), min_size=1, max_size=60))
def test_any_small_column(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").coalesce(2)
    _, found = exact_quantiles(df, {"x": F.col("x")}, [0.25, 0.75], 0, 2)["x"]
    assert found == pytest.approx(np.quantile(values, [0.25, 0.75]).tolist(), rel=1e-9, abs=1e-9)


def test_columns_without_numbers_are_left_out(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {}
