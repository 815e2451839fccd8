import random

import pytest

from tessera.llm import common
from tessera.llm.common import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(1)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "random": [(r.randrange(90), r.randrange(90)) for _ in range(60)], "none": []}[kind]
    r.shuffle(edges)
    edges = [(a, b) for a, b in edges if a != b]
    got = components(spark.createDataFrame([*edges, *edges[:3], (5, 5), (None, 4)], "u long, v long"))
    assert {x.node: x.root for x in got.collect()} == brute(edges)


@pytest.mark.parametrize(("n", "slots"), [(0, 1 << 12), (1, 1 << 12), (5000, 1 << 12), (5000, 1)])
def test_among(spark, monkeypatch, n, slots):
    """No key is missed, few others pass unless the bitmap is at its limit, and no row is lost or doubled."""
    monkeypatch.setattr(common, "SLOTS", slots)
    r = random.Random(2)
    every = [r.randrange(-(1 << 63), 1 << 63) for _ in range(20000)]
    keys = spark.createDataFrame([(x,) for x in every[:n]], "t long")
    got = common.among(spark.createDataFrame([(x, i) for i, x in enumerate(every)], "t long, i long"), keys, "t").collect()
    assert sorted(x.i for x in got) == list(range(20000)) and all(every[x.i] == x.t for x in got)
    assert all(x.among for x in got if x.i < n)
    others = sum(x.among for x in got if x.i >= n) / (20000 - n)
    assert others <= (0.08 if slots > 1 or n < 2 else 0.2)
