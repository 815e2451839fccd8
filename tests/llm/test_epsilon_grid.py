import numpy as np
import pytest

from tessera.llm import epsilon_grid


def brute(rows):
    ids, root, links = [], {}, {}
    good = []
    for i, v, label in rows:
        ids.append(i)
        root[i] = i
        links[i] = 0
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good.append((i, x / np.linalg.norm(x), label))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x, a) in enumerate(good):
        for j, y, b in good[:k]:
            if a == b and len(x) == len(y) and x @ y >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in ids}


@pytest.mark.parametrize("interval", [16, 1024])
def test_against_all_pairs(spark, monkeypatch, interval):
    monkeypatch.setattr(epsilon_grid, "INTERVAL", interval)
    r = np.random.default_rng(interval)
    rows = []
    for label in (0, 1, 2, None):
        for _ in range(12):
            centre = r.normal(size=16)
            rows += [(centre + r.normal(size=16) * s, label) for s in r.choice([0.0, 0.05, 0.15, 0.25, 0.4], size=r.integers(1, 9))]
    rows = [(i, [float(np.float32(x)) for x in v * 10.0 ** r.integers(-3, 4)], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, [float("inf")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [], 0), (n + 6, [1.0, 0.0], 0), (n + 7, [2.0, 0.0], 0), (n + 8, rows[0][1], rows[0][2]), (n + 9, rows[0][1], 1)]
    df = spark.createDataFrame([(*x, "k") for x in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(5)
    got = {x.vec_id: x for x in epsilon_grid.near_groups(df).collect()}
    for i, (links, root) in brute(rows).items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, root, i == root), i


def test_one_cluster_gives_few_rows(spark):
    """A thousand vectors that are all near each other: counts are exact, links a forest."""
    r = np.random.default_rng(0)
    rows = [(i, (np.ones(8) + r.normal(size=8) * 0.01).tolist(), 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = epsilon_grid.near_groups(df).collect()
    assert all((x.n_links, x.component_id) == (999, 0) for x in got)


def test_empty_and_unfit_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert epsilon_grid.near_groups(spark.createDataFrame([], kind)).count() == 0
    got = epsilon_grid.near_groups(spark.createDataFrame([(1, None, 0), (None, [1.0], 0), (2, [1.0], None)], kind)).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component_id or 0, x.kept) for x in got) == [(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True)]
