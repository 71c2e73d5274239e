"""Chinese-restaurant seating of a Pitman-Yor hierarchy, and its discounts and strengths.

A dish's customers are seated at tables; only how many tables they take matters for predictions.  With everything else
fixed, the number of tables t of c customers of a dish has the weight

    S(c, t) * product over j < t of (strength + discount * (other tables + j)) * P(dish at the parent)

with S the generalised Stirling numbers of the discount.  So a Gibbs step seats all customers of a dish anew at once, by
drawing t from that distribution; a sweep does so for all dishes of the contexts, then of the parents, then of the root.
A dish's own customers are first taken out of the levels above it; those levels' other seats and the table totals of
whole restaurants stay as they are during a sweep.

S is exact up to SMALL customers.  Above, it is taken at a grid of c (exact up to EXACT) and interpolated in log c where few tables are likely
(t up to MANY), and otherwise t is drawn from the normal distribution at the mode of the saddle-point form of S.

Random numbers are hashes of the word, the restaurant and the sweep, so a draw doesn't depend on how words are dealt.

The language model (module pylm) has two levels, the contexts and the root, and takes its steps as exact conditionals:

- The rising factorial above couples the dishes of a restaurant.  A gamma variable y of shape strength / discount + tables,
  drawn for the restaurant first, takes its place (the gamma function is an integral over y): given y the dishes are
  independent, with weights S(c, t) * (discount * y * P)^t, so all are drawn at once (`Contexts.sweep`, `root_tables`).
- The root's measure is drawn from its seats (`root_weights`), and contexts are independent of each other given it.
- Discount and strength of a level are drawn together from their posterior over a grid (`drawn_parameters`), whose
  logarithm adds up over restaurants and dishes: sum of log (strength | discount)_t - log (strength)_c over restaurants and
  of log S(c, t) over dishes.

Seating holds three levels with the block step of the first paragraphs, for totals that are given from outside.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .common import U64, mix

#: Discounts and strengths of root, parents and contexts.
DISCOUNT, STRENGTH = (0.75, 0.7, 0.7), (1.0, 5.0, 20.0)
SMALL, MANY, EXACT = 256, 128, 2048
BLOCK = 1 << 21
#: The grid of discounts and strengths, all equally likely before the data; the values that the language model starts with.
DISCOUNTS, STRENGTHS = np.round(np.arange(0.02, 0.99, 0.04), 2), 2.0 ** (np.arange(-6, 21) / 2)
START = (0.7, 4.0)


@lru_cache(32)
def stirling(d: float) -> np.ndarray:
    """Logarithms of S(c, t) for 1 <= t <= c <= SMALL, at [c, t - 1]; minus infinity elsewhere."""
    out = np.full((SMALL + 1, SMALL), -np.inf)
    out[1, 0] = 0.0
    t = np.arange(1, SMALL + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, SMALL):
            stay = np.where(t <= c, out[c] + np.log(np.maximum(c - t * d, 1e-300)), -np.inf)
            out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


@lru_cache(32)
def stirling_grid(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of c (a grid from SMALL up) and of S(c, t) / S(c, 1) for t up to MANY; by the recursion up to EXACT."""
    at = np.unique(np.round(SMALL * 2 ** (np.arange(0, 37) / 4)).astype(int))
    row, t, rows, want = stirling(d)[SMALL, :MANY].copy(), np.arange(1, MANY + 1), [], set(at.tolist())
    for c in range(SMALL, EXACT + 1):
        if c in want:
            rows.append(row - row[0])
        row = np.logaddexp(row + np.log(c - t * d), np.concatenate([[-np.inf], row[:-1]]))
    more = at[at > EXACT]
    far = log_stirling(np.repeat(more, MANY), np.tile(t, len(more)), d).reshape(-1, MANY)
    rows.extend(far - far[:, :1])
    return np.log(at), np.array(rows)


def _drawn(logs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """1 + index drawn from each row's weights by one uniform number."""
    p = np.exp(logs - logs.max(1, keepdims=True))
    np.cumsum(p, 1, out=p)
    return 1 + (p < (u * p[:, -1])[:, None]).sum(1)


def _mode(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, grow: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Mode and deviation of t by the saddle-point form of S; c customers, a = strength / discount + other tables, to
    which own tables are added (grow = 1), or a gamma variable (grow = 0)."""
    lo, hi = np.full(len(c), -60.0), np.full(len(c), -1e-9)  # log(1 - z)
    for _ in range(50):
        at = (lo + hi) / 2
        u = np.exp(at)
        ud = np.exp(d * at)
        phi = (1 - u) * d * ud / u / (1 - ud)
        t = c / phi
        up = (1 - ud) * p * (a + grow * t) > t  # more tables are likelier
        hi, lo = np.where(up, hi, at), np.where(up, at, lo)
    u = np.exp((lo + hi) / 2)
    z, ud = 1 - u, u**d
    phi = z * d * ud / u / (1 - ud)
    t = np.clip(c / phi, 1, c)
    curve = (c / t**2) / np.maximum(1 + z * (1 - d) / u - phi, 1e-12) + 1 / t - grow / (a + t)
    return t, 1 / np.sqrt(np.maximum(curve, 1e-12))


def tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, strength: float, d: float, u: np.ndarray, mass: np.ndarray | None = None) -> np.ndarray:
    """A number of tables for every dish of c customers.  others: the restaurant's tables of other dishes; p: the dish's
    probability at the parent; u: uniform numbers; mass: the restaurant's gamma variable, which replaces the tables."""
    t = np.minimum(c, 1)
    many = np.flatnonzero(c > 1)
    if not len(many):
        return t
    a, grow = (strength / d + others, 1) if mass is None else (mass, 0)
    lp = np.log(d * p)
    small = many[c[many] <= SMALL]
    small = small[np.argsort(c[small], kind="stable")]
    exact = stirling(d)
    for rows in np.split(small, np.flatnonzero(np.diff(c[small])) + 1) if len(small) else []:
        n = int(c[rows[0]])
        for i in range(0, len(rows), max(1, BLOCK // n)):
            r = rows[i : i + max(1, BLOCK // n)]
            steps = np.log(a[r, None] + grow * np.arange(n)) + lp[r, None]
            t[r] = _drawn(exact[n, :n] + np.cumsum(steps, 1), u[r])
    big = many[c[many] > SMALL]
    for i in range(0, len(big), BLOCK // MANY):
        r = big[i : i + BLOCK // MANY]
        mode, deviation = _mode(c[r].astype(float), a[r], p[r], d, grow)
        few = mode + 8 * deviation < MANY
        f = r[few]
        if len(f):
            grid, logs = stirling_grid(d)
            x = np.clip(np.log(c[f]), grid[0], grid[-1])
            k = np.clip(np.searchsorted(grid, x, "right") - 1, 0, len(grid) - 2)
            w = ((x - grid[k]) / (grid[k + 1] - grid[k]))[:, None]
            steps = np.log(a[f, None] + grow * np.arange(MANY)) + lp[f, None]
            t[f] = _drawn((1 - w) * logs[k] + w * logs[k + 1] + np.cumsum(steps, 1), u[f])
        o = r[~few]
        if len(o):
            second = ((mix((u[o] * 2.0**53).astype(U64)) >> U64(11)).astype(float) + 0.5) / 2.0**53
            normal = np.sqrt(-2 * np.log(np.maximum(u[o], 1e-16))) * np.cos(2 * np.pi * second)
            t[o] = np.clip(np.round(mode[~few] + deviation[~few] * normal), 1, c[o]).astype(np.int64)
    return t


class Totals:
    """Sums over whole restaurants: customers of contexts (c2), tables of contexts (t2), customers and tables of parents
    (c1, t1) and of the root (c0, t0), and the number of known words."""

    def __init__(self, c2, t2, c1, t1, c0, t0, words):
        self.c2, self.t2, self.c1, self.t1, self.c0, self.t0, self.words = c2, t2, c1, t1, c0, t0, words


class Seating:
    """The dishes of some words.  word, cell: the pairs, sorted; c: their customers (0: none); name: the words' hashes.
    bits: those of a context's number and of its parent's, which are the leading ones."""

    def __init__(self, name: np.ndarray, word: np.ndarray, cell: np.ndarray, c: np.ndarray, bits: tuple[int, int]):
        self.name, self.word, self.cell, self.c2 = name, word, cell, c
        low = bits[0] - bits[1]
        key = word << bits[1] | cell >> low
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.up = np.cumsum(new) - 1
        self.word1, self.par = word[new], (cell >> low)[new]
        self.t2 = np.minimum(c, 1)
        self._rise()
        self.t1 = np.minimum(self.c1, 1)
        self._root()
        self.t0 = np.minimum(self.c0, 1)

    def _rise(self) -> None:
        self.c1 = np.bincount(self.up, self.t2, len(self.par)).astype(np.int64)

    def _root(self) -> None:
        self.c0 = np.bincount(self.word1, self.t1, len(self.name)).astype(np.int64)

    def _uniform(self, level: int, word: np.ndarray, place, sweep: int) -> np.ndarray:
        salt = mix(np.asarray(place, dtype=np.int64).astype(U64) + U64(level << 40) + U64(sweep << 44))
        return ((mix(self.name[word] ^ salt) >> U64(11)).astype(float) + 0.5) / 2.0**53

    def root(self, s: Totals, c0, t0) -> np.ndarray:
        """Probabilities at the root; the base measure is even over the known words and the class of all unseen ones."""
        return (c0 - DISCOUNT[0] * t0 + (STRENGTH[0] + DISCOUNT[0] * s.t0) / (s.words + 1)) / (STRENGTH[0] + s.c0)

    def parent(self, s: Totals, par, c1, t1, p0) -> np.ndarray:
        return (c1 - DISCOUNT[1] * t1 + (STRENGTH[1] + DISCOUNT[1] * s.t1[par]) * p0) / (STRENGTH[1] + s.c1[par])

    def sweep(self, s: Totals, number: int) -> None:
        """Seats all customers of all dishes anew."""
        busy = np.flatnonzero(self.c2 > 1)
        if len(busy):
            q = self.up[busy]
            w, par, cell = self.word1[q], self.par[q], self.cell[busy]
            c1 = self.c1[q] - self.t2[busy]
            t1 = np.minimum(self.t1[q], c1)
            c0 = self.c0[w] - (self.t1[q] - t1)
            p = self.parent(s, par, c1, t1, self.root(s, c0, np.minimum(self.t0[w], c0)))
            others = np.maximum(s.t2[cell] - self.t2[busy], 0)
            self.t2[busy] = tables(self.c2[busy], others, p, STRENGTH[2], DISCOUNT[2], self._uniform(2, w, cell, number))
        self._rise()
        self.t1 = np.minimum(np.maximum(self.t1, 1), self.c1)
        busy = np.flatnonzero(self.c1 > 1)
        if len(busy):
            w, par = self.word1[busy], self.par[busy]
            c0 = self.c0[w] - self.t1[busy]
            p = self.root(s, np.maximum(c0, 0), np.minimum(self.t0[w], np.maximum(c0, 0)))
            others = np.maximum(s.t1[par] - self.t1[busy], 0)
            self.t1[busy] = tables(self.c1[busy], others, p, STRENGTH[1], DISCOUNT[1], self._uniform(1, w, par, number))
        self._root()
        self.t0 = np.minimum(np.maximum(self.t0, 1), self.c0)
        busy = np.flatnonzero(self.c0 > 1)
        if len(busy):
            others = np.full(len(busy), float(s.t0)) - self.t0[busy]
            self.t0[busy] = tables(self.c0[busy], np.maximum(others, 0), np.full(len(busy), 1 / (s.words + 1)), STRENGTH[0], DISCOUNT[0], self._uniform(0, busy, np.zeros(len(busy)), number))

    def predict(self, s: Totals) -> np.ndarray:
        """Predictive probability of every pair's word in its context; s: the totals of this very state."""
        p0 = self.root(s, self.c0, self.t0)
        p1 = self.parent(s, self.par, self.c1, self.t1, p0[self.word1])
        return (self.c2 - DISCOUNT[2] * self.t2 + (STRENGTH[2] + DISCOUNT[2] * s.t2[self.cell]) * p1[self.up]) / (STRENGTH[2] + s.c2[self.cell])


def uniforms(key: np.ndarray, draw: int) -> np.ndarray:
    """Uniform numbers between 0 and 1 by the hash of a key and the number of the draw."""
    return ((mix(key ^ mix(np.full(1, draw + 1, U64))) >> U64(11)).astype(float) + 0.5) / 2.0**53


def gammas(shape: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Gamma variables by Marsaglia and Tsang's rejection; shapes below one by way of one more."""
    low = shape < 1
    d = shape + low - 1 / 3
    out, left, draw = np.empty(len(d)), np.arange(len(d)), 1
    while len(left):
        u, v, w = (uniforms(key[left], draw + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        y = (1 + x / np.sqrt(9 * d[left])) ** 3
        fit = (y > 0) & (np.log(w) < 0.5 * x * x + d[left] * (1 - y + np.log(np.maximum(y, 1e-300))))
        out[left[fit]] = (d[left] * y)[fit]
        left, draw = left[~fit], draw + 3
    return np.where(low, out * uniforms(key, 0) ** (1 / shape), out)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithms of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    low = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def _few(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of S(c, t) by the expansion of its generating function, ((1 - (1 - z)^d) / d)^t / t!, in powers of
    (1 - z)^d: for t well below c^d, where the terms fall fast."""
    total, lead = np.zeros(len(c)), log_gamma(c - d)
    factorial = np.append(0.0, np.cumsum(np.log(np.arange(1, int(t.max(initial=0)) + 1))))
    for j in range(1, min(64, int(t.max(initial=0))) + 1):
        size = factorial[t] - factorial[np.maximum(t - j, 0)] + log_gamma(c - d * j) - lead + math.lgamma(1 + d * j) - math.lgamma(j + 1)
        term = np.where(t >= j, np.sin(np.pi * d * j) / np.pi * np.exp(size), 0.0)
        total += (-1) ** (j + 1) * term
        if (np.exp(size) <= 1e-13 * total).all():
            break
    return lead - factorial[t] - t * np.log(d) + np.log(total)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """Logarithms of S(c, t) for 1 <= t <= c: exact up to SMALL customers, else by an expansion for few tables or by the
    saddle point."""
    out = np.zeros(len(c))
    small = c <= SMALL
    out[small] = stirling(d)[c[small], t[small] - 1]
    few = ~small & (t < (2 if d < 0.75 else 0.75) * c**d)  # beyond, the terms fall too slowly
    out[few] = _few(c[few].astype(float), t[few], d)
    at = np.flatnonzero(~small & ~few & (t < c))
    c, t = c[at].astype(float), t[at].astype(float)
    lo, hi = np.full(len(c), -60.0), np.full(len(c), -1e-9)  # log(1 - z)
    for _ in range(50):
        mid = (lo + hi) / 2
        u, ud = np.exp(mid), np.exp(d * mid)
        far = (1 - u) * d * ud / u / (1 - ud) > c / t
        lo, hi = np.where(far, mid, lo), np.where(far, hi, mid)
    u = np.exp((lo + hi) / 2)
    z, ud = 1 - u, u**d
    wide = np.maximum(1 + z * (1 - d) / u - c / t, 1e-12)
    out[at] = log_gamma(c + 1) - log_gamma(t + 1) + t * np.log((1 - ud) / d) - c * np.log(z) - 0.5 * np.log(2 * np.pi * c * wide)
    return out


def dish_logs(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The dishes' part of the logarithm of the posterior, for every discount of the grid."""
    many = c > 1  # a single customer has one way to sit
    key, n = np.unique(c[many] << 32 | t[many], return_counts=True)
    return np.array([log_stirling(key >> 32, key & (1 << 32) - 1, float(d)) @ n for d in DISCOUNTS])


def restaurant_logs(c: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The restaurants' part, for every discount and strength of the grid; n: how many have c customers and t tables."""

    def added(v, f):
        v, at = np.unique(v, return_inverse=True)
        return f(v[None].astype(float)) @ np.bincount(at, n, len(v))

    c, t, n = c[c > 0], t[c > 0], n[c > 0]
    out = np.empty((len(DISCOUNTS), len(STRENGTHS)))
    s = STRENGTHS[:, None]
    seated = added(c, lambda v: log_gamma(s + v) - log_gamma(s)) if len(c) else 0.0
    for i, d in enumerate(DISCOUNTS):
        out[i] = (added(t, lambda v: v * np.log(d) + log_gamma(s / d + v) - log_gamma(s / d)) if len(c) else 0.0) - seated
    return out


def drawn_parameters(dishes: np.ndarray, restaurants: np.ndarray, key: int) -> tuple[float, float]:
    """Discount and strength of a level, drawn from their posterior over the grid."""
    logs = (dishes[:, None] + restaurants).ravel()
    p = np.cumsum(np.exp(logs - logs.max()))
    i = int((p < uniforms(np.full(1, key, U64), 0)[0] * p[-1]).sum())
    return float(DISCOUNTS[i // len(STRENGTHS)]), float(STRENGTHS[i % len(STRENGTHS)])


class Contexts:
    """Whole restaurants of some contexts: the dishes with more than one customer (the others have a table a customer).
    name, dish: hashes of the contexts and of the dishes' words; place: the dish's context; c: its customers; single: the
    contexts' customers of all other dishes."""

    def __init__(self, name: np.ndarray, single: np.ndarray, place: np.ndarray, dish: np.ndarray, c: np.ndarray):
        self.name, self.single, self.place, self.dish, self.c = name, single, place, dish, c
        self.t = np.ones(len(c), np.int64)

    def customers(self) -> np.ndarray:
        return self.single + np.bincount(self.place, self.c, len(self.name)).astype(np.int64)

    def tables(self) -> np.ndarray:
        return self.single + np.bincount(self.place, self.t, len(self.name)).astype(np.int64)

    def sweep(self, above: np.ndarray, discount: float, strength: float, number: int) -> None:
        """Seats all customers anew.  above: the words' probabilities in the root's drawn measure."""
        mass = gammas(strength / discount + self.tables(), mix(self.name) ^ mix(np.full(1, number << 8 | 1, U64)))
        u = uniforms(mix(self.dish) ^ mix(self.name[self.place] ^ U64(number << 8 | 2)), 0)
        self.t = tables(self.c, self.c, above, strength, discount, u, mass[self.place])


def root_tables(name: np.ndarray, c: np.ndarray, mass: float, words: int, discount: float, strength: float, number: int) -> np.ndarray:
    """Tables of the root's dishes; the base measure is even over the known words and the class of all others."""
    u = uniforms(mix(name) ^ mix(np.full(1, number << 8 | 3, U64)), 0)
    return tables(c, c, np.full(len(c), 1 / (words + 1)), strength, discount, u, np.full(len(c), mass))


def root_weights(name: np.ndarray, c: np.ndarray, t: np.ndarray, discount: float, number: int) -> np.ndarray:
    """Gamma variables whose shares are the known words' weights in the root's measure; 0 for unknown words."""
    out = np.zeros(len(c))
    known = np.flatnonzero(c)
    out[known] = gammas(c[known] - discount * t[known], mix(name[known]) ^ mix(np.full(1, number << 8 | 4, U64)))
    return out
