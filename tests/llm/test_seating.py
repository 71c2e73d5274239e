"""The seating sampler against exact distributions."""

import math

import numpy as np
import pytest

from lexharbor.llm import seating


def exact_weights(c, a, p, d):
    """Weights of t for one dish by the recursion of S."""
    t = np.arange(1, c + 1)
    s = np.full(c, -np.inf)
    s[0] = 0.0
    with np.errstate(divide="ignore"):
        for n in range(1, c):
            s = np.logaddexp(np.where(t <= n, s + np.log(np.maximum(n - t * d, 1e-300)), -np.inf), np.concatenate([[-np.inf], s[:-1]]))
    logs = s + np.cumsum(np.log(d * p * (a + np.arange(c))))
    w = np.exp(logs - logs.max())
    return w / w.sum()


@pytest.mark.parametrize("c,others,p", [(2, 0, 0.3), (5, 10, 0.05), (40, 300, 0.02), (256, 50, 0.2), (700, 5, 0.01), (700, 2000, 0.3), (1500, 40, 0.9)])
def test_tables_have_the_exact_distribution(c, others, p):
    d, strength, n = 0.7, 5.0, 20_000
    u = (np.random.default_rng(1).permutation(n) + 0.5) / n
    got = seating.tables(np.full(n, c), np.full(n, float(others)), np.full(n, p), strength, d, u)
    w = exact_weights(c, strength / d + others, p, d)
    t = np.arange(1, c + 1)
    mean, sd = (w * t).sum(), math.sqrt((w * t * t).sum() - (w * t).sum() ** 2)
    near = 0.02 if c <= seating.SMALL or mean + 8 * sd < seating.MANY else 0.25  # a normal distribution at the mode
    assert abs(got.mean() - mean) < near * sd + 0.02 and abs(got.std() - sd) < max(0.05, near / 2) * sd + 0.02


def test_block_step_equals_one_customer_at_a_time():
    """A dish's tables by re-seating single customers, many times over, have the distribution that the block step draws."""
    r, d, a, p, c = np.random.default_rng(2), 0.7, 9.0, 0.06, 12
    seats, seen = [1] * c, []
    for step in range(60_000):
        k = r.choice(len(seats), p=np.array(seats) / c)
        seats[k] -= 1
        seats = [x for x in seats if x]
        w = np.array([x - d for x in seats] + [d * (a + len(seats)) * p])
        k = r.choice(len(w), p=w / w.sum())
        seats = seats + [1] if k == len(seats) else [x + (i == k) for i, x in enumerate(seats)]
        seen.append(len(seats))
    w = exact_weights(c, a, p, d)
    assert abs(np.mean(seen[500:]) - (w * np.arange(1, c + 1)).sum()) < 0.05


def corpus(words=60, cells=16, seed=0):
    r = np.random.default_rng(seed)
    word, cell = (x.reshape(-1) for x in np.meshgrid(np.arange(words), np.arange(cells), indexing="ij"))
    c = np.where(r.random(len(word)) < 0.5, 0, r.geometric(0.1, len(word)))
    c[word < 5] = 0  # words that training doesn't hold
    name = np.sort(r.integers(0, 1 << 62, words).astype(np.uint64))
    return name, word, cell, c


def totals(x, cells, parents):
    n = lambda at, v, size: np.bincount(at, v, size)
    return seating.Totals(n(x.cell, x.c2, cells), n(x.cell, x.t2, cells), n(x.par, x.c1, parents), n(x.par, x.t1, parents), int(x.c0.sum()), int(x.t0.sum()), int((x.c0 > 0).sum()))


def test_probabilities_of_a_context_sum_to_one():
    name, word, cell, c = corpus()
    x = seating.Seating(name, word, cell, c, (4, 2))
    for i in range(5):
        x.sweep(totals(x, 16, 4), i)
        assert ((x.t2 <= x.c2) & (x.t2 >= np.minimum(x.c2, 1))).all() and ((x.t1 <= x.c1) & (x.t0[x.word1] <= x.c0[x.word1])).all()
    p = x.predict(totals(x, 16, 4))
    known = x.c0 > 0
    for k in range(16):
        own = p[cell == k]
        assert math.isclose(own[known].sum() + own[~known][0], 1.0, rel_tol=1e-12)  # the unseen words are one class


def test_seating_does_not_depend_on_how_words_are_dealt():
    name, word, cell, c = corpus(seed=3)
    whole = seating.Seating(name, word, cell, c, (4, 2))
    s = totals(whole, 16, 4)
    parts = [seating.Seating(name[lo:hi], word[(word >= lo) & (word < hi)] - lo, cell[(word >= lo) & (word < hi)], c[(word >= lo) & (word < hi)], (4, 2)) for lo, hi in ((0, 13), (13, 60))]
    for i in range(4):
        for x in (whole, *parts):
            x.sweep(s, i)
    assert np.array_equal(whole.predict(s), np.concatenate([x.predict(s) for x in parts]))


def test_contexts_have_the_exact_joint_distribution():
    """A restaurant's dishes, swept with its gamma variable, against all states of three dishes."""
    c, p, d, strength = np.array([2, 3, 4]), np.array([0.2, 0.05, 0.4]), 0.6, 1.5
    n = 4000  # restaurants that differ by name alone
    x = seating.Contexts(seating.mix(np.arange(1, n + 1).astype(np.uint64)), np.ones(n, np.int64), np.repeat(np.arange(n), 3), np.tile(np.arange(7, 10), n).astype(np.uint64), np.tile(c, n))
    seen = []
    for i in range(12):
        x.sweep(np.tile(p, n), d, strength, i)
        if i > 3:
            seen.append(x.t.reshape(n, 3).mean(0))
    want, total = np.zeros(3), 0.0
    for t in np.ndindex(*c):
        t = np.array(t) + 1
        w = math.prod(strength + d * j for j in range(1 + t.sum())) * math.prod(math.exp(seating.stirling(d)[a, b - 1]) * q**b for a, b, q in zip(c, t, p))
        want, total = want + w * t, total + w
    assert np.allclose(np.mean(seen, 0), want / total, atol=0.02)


def test_parameters_are_learned():
    """Discount and strength come out near those that a restaurant's customers were seated with."""
    r, d, strength, seats = np.random.default_rng(5), 0.62, 2.0**2.5, []
    for i in range(4000):
        k = r.random() * (strength + i)
        if k < strength + d * len(seats):
            seats.append(1)
        else:
            seats[r.choice(len(seats), p=(np.array(seats) - d) / (i - d * len(seats)))] += 1
    one = np.ones(1, np.int64)
    c = np.array(seats)  # every table is a dish
    logs = np.array([sum(math.lgamma(n - x) - math.lgamma(1 - x) for n in c) for x in seating.DISCOUNTS])
    got = seating.drawn_parameters(logs, seating.restaurant_logs(one * c.sum(), one * len(c), one), 1)
    assert abs(got[0] - d) < 0.1 and strength / 8 < got[1] < strength * 8


def test_log_stirling_of_many_customers():
    for d in (0.3, 0.7, 0.9):
        s = np.full(600, -np.inf)
        s[0], t = 0.0, np.arange(1, 601)
        with np.errstate(divide="ignore"):
            for n in range(1, 600):
                s = np.logaddexp(np.where(t <= n, s + np.log(np.maximum(n - t * d, 1e-300)), -np.inf), np.concatenate([[-np.inf], s[:-1]]))
        few = t[: int(0.7 * 600**d)]
        assert np.allclose(seating.log_stirling(np.full(len(few), 600), few, d), s[few - 1], atol=1e-6)
        assert np.abs(seating.log_stirling(np.full(600, 600), t, d) - s).max() < 0.8
