"""Order statistics by narrowed histograms against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.operators.selection import at_places, percentiles


@pytest.fixture(scope="module")
def groups():
    draw = random.Random(9)
    return {
        "spread": [draw.gauss(0, 1) for _ in range(500)], "tied": [1.0] * 200 + [2.0, 3.0], "one": [7.0], "two": [1.0, 2.0], "heavy": [10.0 ** draw.randrange(-9, 9) for _ in range(300)],
        "equal": [5.0] * 100, "near": [1.0 + i * 1e-15 for i in range(40)],
    }


@pytest.mark.parametrize(("few", "bins"), [(4096, 256), (5, 4), (1, 3)])
def test_places_and_percentiles_equal_sorted_lists(spark, groups, few, bins):
    rows = spark.createDataFrame([(k, x) for k, own in groups.items() for x in own] + [("spread", None), (None, 1.0)], "k string, x double")
    middle = at_places(rows, "k", "x", {"middle": F.floor(F.col("n") / 2), "last": F.col("n") - 1}, few=few, bins=bins).collect()
    assert {r["k"]: (r["n"], r["middle"], r["last"]) for r in middle} == {k: (len(x), sorted(x)[len(x) // 2], max(x)) for k, x in groups.items()}
    got = {r["k"]: (r["p95"], r["p50"]) for r in percentiles(rows, "k", "x", {"p95": 0.95, "p50": 0.5}, few=few, bins=bins).collect()}
    assert set(got) == set(groups)
    assert all(np.allclose(got[k], (np.percentile(x, 95), np.percentile(x, 50)), rtol=1e-12) for k, x in groups.items())
