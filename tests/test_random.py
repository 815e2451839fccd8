"""Draws: seeded, of the right moments."""

import numpy as np
import pytest

from tessera import api

N = 20_000
# name, arguments, mean, variance
CASES = [
    ("rand", (), 0.5, 1 / 12),
    ("randn", (), 0, 1),
    ("normal", (3.0, 2.0), 3, 4),
    ("uniform", (-1.0, 3.0), 1, 16 / 12),
    ("randint", (2, 8), 4.5, 35 / 12),
    ("exponential", (2.0,), 2, 4),
    ("geometric", (0.25,), 4, 12),
    ("lognormal", (0.0, 0.5), np.exp(0.125), (np.exp(0.25) - 1) * np.exp(0.25)),
    ("weibull", (2.0,), 0.886227, 0.2146),
    ("pareto", (5.0,), 0.25, 5 / (16 * 3)),
    ("rayleigh", (2.0,), 2 * np.sqrt(np.pi / 2), (4 - np.pi) / 2 * 4),
    ("triangular", (0.0, 1.0, 3.0), 4 / 3, (9 + 1 - 3) / 18),
    ("wald", (1.0, 3.0), 1, 1 / 3),
    ("poisson", (3.0,), 3, 3),
    ("binomial", (10, 0.3), 3, 2.1),
    ("negativeBinomial", (5, 0.5), 5, 10),
    ("hypergeometric", (10, 10, 6), 3, 6 * 0.25 * 14 / 19),
    ("beta", (2.0, 3.0), 0.4, 0.04),
    ("gamma", (3.0, 2.0), 6, 12),
    ("chisquare", (4.0,), 4, 8),
    ("standardT", (10.0,), 0, 1.25),
    ("f", (5.0, 20.0), 20 / 18, None),
    ("vonmises", (0.0, 4.0), 0, None),
    ("zipf", (4.0,), 1.1106, None),
]


@pytest.mark.parametrize(("name", "args", "mean", "var"), CASES, ids=[c[0] for c in CASES])
def test_moments(spark, name, args, mean, var):
    x = getattr(api, name)(spark, *args, (N,), seed=11).numpy()
    assert abs(x.mean() - mean) < 6 * x.std() / np.sqrt(N)
    if var is not None:
        assert x.var() == pytest.approx(var, rel=0.15)


def test_same_seed_same_draws(spark):
    a, b, c = (api.rand(spark, (50,), seed=s).numpy() for s in (1, 1, 2))
    assert (a == b).all() and (a != c).all() and ((a > 0) & (a < 1)).all()
    api.seed(5)
    x = api.randn(spark, (9,)).numpy(), api.randn(spark, (9,)).numpy()
    api.seed(5)
    y = api.randn(spark, (9,)).numpy(), api.randn(spark, (9,)).numpy()
    assert (x[0] == y[0]).all() and (x[1] == y[1]).all() and (x[0] != x[1]).any()


def test_vectors(spark):
    x = api.multinomial(spark, 20, [0.2, 0.8], 300, seed=1).numpy()
    assert (x.sum(1) == 20).all() and abs(x[:, 0].mean() - 4) < 0.6
    assert np.allclose(api.dirichlet(spark, [1.0, 2, 3], 50, seed=1).numpy().sum(1), 1)
    cov = np.array([[2.0, 0.6], [0.6, 1.0]])
    y = api.multivariateNormal(api.array(spark, [1.0, -1.0]), api.array(spark, cov), 5000, seed=2).numpy()
    assert np.abs(np.cov(y.T) - cov).max() < 0.2 and np.abs(y.mean(0) - [1, -1]).max() < 0.1


def test_permutations_and_choices(spark):
    p = api.permutation(40, spark, seed=3).numpy()
    assert sorted(p) == list(range(40)) and (p != np.arange(40)).any()
    t = api.array(spark, np.arange(20.0))
    assert sorted(api.shuffle(t, seed=1).numpy()) == list(range(20))
    assert len(set(api.choice(t, 20, False, seed=1).numpy())) == 20
    w = [0.0] * 18 + [1.0, 3.0]
    x = api.choice(t, 2000, True, w, seed=1).numpy()
    assert set(x) == {18.0, 19.0} and abs((x == 19).mean() - 0.75) < 0.06
    assert set(api.choice(t, 2, False, w, seed=1).numpy()) == {18.0, 19.0}
    assert api.choice(t, 500, seed=4).numpy().mean() == pytest.approx(9.5, abs=1.5)
    from tessera.operators import nn

    weights = api.array(spark, [[0.0, 1.0, 1.0], [1.0, 0.0, 0.0]])
    got = nn.multinomial(weights, 200, True, seed=1).numpy()
    assert set(got[0]) == {1.0, 2.0} and set(got[1]) == {0.0}
    assert set(nn.multinomial(api.array(spark, [0.0, 1, 2]), 2, False, seed=1).numpy()) == {1.0, 2.0}


def test_xorshift_sequences(spark, monkeypatch):
    """Jumps against steps one by one, over several blocks, and across draws."""
    from tessera.sources import xorshift

    monkeypatch.setattr(xorshift, "BLOCK", 16)
    x, want = 98765, []
    for _ in range(100):
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        want.append(x / 0xFFFFFFFF)
    assert xorshift.jumped(98765, 100) == x
    far = xorshift.jumped(98765, (1 << 32) - 1)  # the period
    assert far == 98765
    api.seed(98765, sequence=True)
    try:
        got = api.rand(spark, (7, 5)).numpy().ravel().tolist() + api.rand(spark, (40,)).numpy().tolist()
        assert got == want[:75] and api.randint(spark, 0, 10, (3,)).numpy().tolist() == [int(v * 10) for v in want[75:78]]
    finally:
        api.seed(0)
    api.seed(0, sequence=True)
    assert api.rand(spark, (1,)).item() == xorshift.run(1, 0)[0] / 0xFFFFFFFF
    api.seed(0)


def test_same_seed_in_any_order_of_sums(spark, monkeypatch):
    """Rows of the draws query that compare two draws of one seed, with sums of doubles that are added up in other orders."""
    from tessera import listings
    from tessera.plans.tensor import Tensor

    plain, parts = api.rand, iter(range(1, 99, 6))

    def dealt(spark, shape, *args, **kinds):
        t = plain(spark, shape, *args, **kinds)
        return Tensor(t.df.repartition(next(parts)), t.shape)

    monkeypatch.setattr(api, "rand", dealt)
    api.seed(5)
    sums = {api.checksum(api.rand(spark, (100,), seed=5)).item() for _ in range(6)}
    assert len(sums) > 1
    got = listings.draws(listings.Given(spark, "/root/testdata/sf0.001"))
    assert got["seed"] and got["random_seed"] and got["repeatable"]
