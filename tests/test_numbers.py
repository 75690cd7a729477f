"""Python's fixed-point formatting reproduced with column expressions."""

import random

import pytest

from callsight.functions.numbers import py_fixed


def _values():
    rnd = random.Random(7)
    vals = [0.125, 0.375, 2.675, 2.345, 1.005, 0.015, -0.125, -0.001, 0.045, 1.115, 0.0, -0.0, 4.5, 2.5, 1e-9, -1e-9, 123456.785]
    vals += [k / 1000 for k in range(-2000, 2001)]  # every decimal tie at the third place, and neighbours
    vals += [k / 8 for k in range(-80, 81)]  # exact binary ties
    vals += [rnd.uniform(-5, 5) for _ in range(3000)]
    vals += [rnd.randint(0, 5000) / 1000 + rnd.choice([-1, 1]) * 1e-12 for _ in range(1000)]
    return vals


@pytest.mark.parametrize("digits", [1, 2])
def test_py_fixed_equals_python(spark, digits):
    vals = _values()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = {r.i: r.s for r in df.select("i", py_fixed(df.x, digits).alias("s")).collect()}
    bad = [(v, got[i], f"{v:.{digits}f}") for i, v in enumerate(vals) if got[i] != f"{v:.{digits}f}"]
    assert not bad, bad[:10]


def test_py_fixed_special_values(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert [r.s for r in df.select(py_fixed(df.x, 2).alias("s")).collect()] == ["nan", "inf", "-inf", None]
