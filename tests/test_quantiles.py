"""Exact order statistics against NumPy, with few bins so that every step of the search runs."""

import math
import random

import numpy as np
import pytest

from tessera.plans import quantiles as plan

KIND = "g string, x double"


def sample():
    r = random.Random(5)
    rows = [("a", r.gauss(0, 1)) for _ in range(500)] + [("b", float(r.randint(0, 3))) for _ in range(300)]
    rows += [(None, 10.0 ** r.uniform(-300, 300)) for _ in range(400)] + [("c", 7.5)] * 250 + [("one", -3.0)]
    return rows


@pytest.mark.parametrize(("bins", "few"), [(64, 20), (1 << 12, 1 << 16)])
def test_against_numpy(spark, monkeypatch, bins, few):
    monkeypatch.setattr(plan, "BINS", bins)
    monkeypatch.setattr(plan, "FEW", few)
    rows = sample()
    asked = {f"q{int(100 * q)}_{m}": (q, m) for q in (0.0, 0.37, 0.5, 1.0) for m in plan.METHODS}
    got = {r["g"]: r.asDict() for r in plan.quantiles(spark.createDataFrame(rows, KIND).repartition(3), ["g"], "x", asked).collect()}
    assert got.keys() == {g for g, _ in rows}
    for g, found in got.items():
        v = np.array([x for k, x in rows if k == g])
        for name, (q, m) in asked.items():
            if m == "nearest":
                place = (len(v) - 1) * q
                want = np.sort(v)[math.floor(place) if place - math.floor(place) <= 0.5 else math.ceil(place)]
            else:
                want = np.quantile(v, q, method=m)
            assert found[name] == pytest.approx(want, rel=1e-12)


def test_odd_values(spark):
    rows = [("nan", float("nan")), ("nan", 1.0), ("nan", 2.0), ("none", float("nan")), ("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0), ("null", None), ("null", 4.0)]
    df = spark.createDataFrame(rows, KIND)
    kept = {r.g: r.m for r in plan.quantiles(df, ["g"], "x", {"m": (0.5, "linear")}).collect()}
    assert kept["nan"] == 2.0 and math.isnan(kept["none"]) and kept["inf"] == 0.0
    known = {r.g: r.m for r in plan.quantiles(df, ["g"], "x", {"m": (0.5, "linear")}, skip_nan=True).collect()}
    assert known["nan"] == 1.5 and math.isnan(known["none"]) and known["null"] == 4.0
    assert plan.quantiles(df.where("false"), ["g"], "x", {"m": (0.5, "linear")}).count() == 0


def test_whole_table(spark):
    df = spark.range(1001).selectExpr("id * 1.0 AS x")
    assert plan.quantiles(df, [], "x", {"m": (0.5, "linear"), "h": (0.9, "higher")}).collect() == [(500.0, 900.0)]
