"""Tails of distributions as vectorised functions: what Spark's built-ins lack.

Each works on NumPy arrays and comes wrapped as a pandas UDF.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

_LG = np.array([0.0, 0.0, *np.cumsum(np.log(np.arange(2, 4097)))])

#: Terms of tables that are worked out at a time.
TERMS = 1 << 18


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n!, from a table and beyond it from Stirling's series."""
    n = np.asarray(n, float)
    small = _LG[np.clip(n, 0, 4096).astype(int)]
    x = np.maximum(n, 1) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n <= 4096, small, series)


def _fisher_two_by_two(a, b, c, d, greater: bool) -> np.ndarray:
    """p of 2x2 tables: each different table once, many tables at a time."""
    tables, back = np.unique(np.stack([np.asarray(v, float).astype(int) for v in (a, b, c, d)]), axis=1, return_inverse=True)
    w, x, y, z = tables
    r1, c1, n = w + x, w + y, w + x + y + z
    low, high = w if greater else np.maximum(0, r1 + c1 - n), np.minimum(r1, c1)
    count = np.maximum(high - low + 1, 0)
    base = log_factorial(r1) + log_factorial(n - r1) + log_factorial(c1) + log_factorial(n - c1) - log_factorial(n)
    out = np.zeros(len(w))
    group = np.cumsum(count) // TERMS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(w)]
    for i, j in zip(cuts, cuts[1:]):
        each = np.repeat(np.arange(i, j), count[i:j])
        first = np.cumsum(count[i:j]) - count[i:j]
        k = low[each] + np.arange(len(each)) - first[each - i]
        p = np.exp(base[each] - log_factorial(k) - log_factorial(r1[each] - k) - log_factorial(c1[each] - k) - log_factorial(n[each] - r1[each] - c1[each] + k))
        if not greater:
            own = p[first + w[i:j] - low[i:j]] if len(p) else p
            p = np.where(p <= own[each - i] * (1 + 1e-7), p, 0)
        out[i:j] = np.bincount(each - i, p, j - i)
    return np.minimum(out, 1.0)[back.reshape(-1)]


def fisher_two_sided(a, b, c, d) -> np.ndarray:
    """Two-tailed p of 2x2 tables: the tables with the same margins that are no likelier."""
    return _fisher_two_by_two(a, b, c, d, False)


def fisher_greater(a, b, c, d) -> np.ndarray:
    """One-tailed p: first cell as large or larger."""
    return _fisher_two_by_two(a, b, c, d, True)


def fisher_table(rows: list[list[int]], method: str = "auto", most: int | None = None, draws: int = 4_000, seed: int = 1) -> tuple[float, str]:
    """(p, method) of an r x c table (T9): all tables with its margins that are no likelier.

    ``exact`` meets in the middle: the columns are split in two halves, each half's fillings
    are listed by the row sums that they use, and for each filling of one half the
    fillings of the other that complete it are a prefix of those sorted by likelihood.
    Cells further from their mean than the table's own chance over 1e17 are left out, which
    changes p by no digit that counts. Tables of two rows (or columns) by three are exact at any
    size, a line of cells at a time. ``drawn`` is the share of seeded draws and can't be less than 1 / (draws + 1).
    ``auto`` is exact unless the caller sets ``most`` and a half has more fillings; the method tells which it was.
    """
    t = np.asarray(rows, int)
    t = t[:, t.sum(0) > 0][t.sum(1) > 0]
    if t.size == 0 or min(t.shape) < 2:
        return 1.0, "exact"
    if t.shape[0] > t.shape[1]:
        t = t.T
    r, c = t.sum(1), t.sum(0)
    const = float(log_factorial(r).sum() + log_factorial(c).sum() - log_factorial(int(t.sum())))
    own = const - float(log_factorial(t).sum())
    if method != "drawn" and t.shape == (2, 3):
        return _fisher_two_by_three(t, r, c), "exact"
    if method != "drawn":
        order = np.argsort(c, kind="stable")
        halves = [_fillings(r, c[order[i::2]].tolist(), int(t.sum()), math.sqrt(80 - 2 * own), most if method == "auto" else None) for i in (0, 1)]
        if None not in halves:
            return min(1.0, _met(*halves, r, own - const + 1e-7, const)), "exact"
    return _fisher_drawn(t, own, const, draws, seed), "drawn"


def _fisher_two_by_three(t: np.ndarray, r: np.ndarray, c: np.ndarray) -> float:
    """p of a 2 x 3 table from all its likely fillings: memory of one line, time of their number.

    A filling's log weight is a sum of one term for each column. The terms are told by their
    distance from the column's likeliest cell, in long doubles, as factorials of large sums
    have no digits left behind the point in doubles.
    """
    n, row = int(t.sum()), int(r[0])
    ordered = np.argsort(c, kind="stable")
    c, cells = c[ordered].tolist(), t[0, ordered].tolist()  # lines run along the middle column, which is longer than the least

    def lf(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.longdouble) + 1
        lift = np.where(x < 64, 64, 0)  # Stirling's series wants a large x: ln of the factors between
        low = np.zeros(x.shape, np.longdouble)
        for k in range(64):
            low += np.where(lift > 0, np.log(x + k), 0)
        x = x + lift
        half = np.longdouble(0.5)
        return (x - half) * np.log(x) - x + half * np.log(2 * np.pi * np.longdouble(1)) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) - low

    const = lf(row) + lf(n - row) - lf(n) + sum(lf(k) for k in c)
    term = lambda k, x: -lf(x) - lf(c[k] - x)
    own = const + sum(term(k, np.array(cells[k])) for k in range(3))
    reach = math.sqrt(80 - 2 * float(own))
    (a, b), (d, e) = (_likely_range(c[k], row, n, reach) for k in (0, 1))
    third = np.arange(max(0, row - b - e), min(c[2], row - a - d) + 1)
    if not len(third):
        return 1.0
    terms = [term(0, np.arange(a, b + 1)), term(1, np.arange(d, e + 1)), term(2, third)]
    tops = [x.max() for x in terms]
    first, second, last = (np.asarray(x - m, float) for x, m in zip(terms, tops, strict=True))
    const = float(const + sum(tops))
    limit = float(own) + 1e-7 - const
    total = 0.0
    for i, w in zip(range(a, b + 1), first.tolist(), strict=True):
        lo, hi = max(d, row - i - int(third[-1])), min(e, row - i - int(third[0]))
        if lo > hi:
            continue
        at = row - i - lo - int(third[0])
        line = second[lo - d : hi - d + 1] + last[at - (hi - lo) : at + 1][::-1]
        line = line[line <= limit - w]
        # what lies this far below the table's own chance adds to no digit of the sum
        line = line[line > limit - w - 60]
        total += float(np.exp(line + (w - limit)).sum())
    return min(1.0, total * math.exp(limit + const))


def _fillings(r: np.ndarray, columns: list[int], n: int, reach: float, most: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(row sums used by all rows but the last, log weight) of each filling of some columns; None if they are more than ``most``."""
    used, logs = np.zeros((1, len(r) - 1), np.int64), np.zeros(1)
    for total in columns:
        cells, left = np.zeros((1, 0), np.int64), np.array([total])
        for i in range(len(r) - 1):
            lo, hi = _likely_range(int(r[i]), total, n, reach)
            x = np.arange(lo, hi + 1)
            if most is not None and len(cells) * len(x) > most:
                return None
            grid = np.repeat(np.arange(len(cells)), len(x))
            each = np.tile(x, len(cells))
            ok = each <= left[grid]
            cells, left = np.column_stack([cells[grid[ok]], each[ok]]), left[grid[ok]] - each[ok]
        lo, hi = _likely_range(int(r[-1]), total, n, reach)
        ok = (left >= lo) & (left <= hi)
        cells, left = cells[ok], left[ok]
        weight = -log_factorial(cells).sum(1) - log_factorial(left)
        if most is not None and len(used) * len(cells) > most:
            return None
        used = (used[:, None, :] + cells[None, :, :]).reshape(-1, len(r) - 1)
        logs = (logs[:, None] + weight[None, :]).ravel()
        ok = (used <= r[:-1]).all(1)
        used, logs = used[ok], logs[ok]
    return used, logs


def _likely_range(row: int, column: int, n: int, reach: float) -> tuple[int, int]:
    """Cells within ``reach`` standard deviations of their mean, given both sums."""
    lo, hi = max(0, row + column - n), min(row, column)
    mean, sd = row * column / n, math.sqrt(max(row * column / n * (1 - row / n) * (1 - column / n), 0.25))
    return max(lo, math.floor(mean - reach * sd - 20)), min(hi, math.ceil(mean + reach * sd + 20))


def _met(a: tuple, b: tuple, r: np.ndarray, limit: float, const: float) -> float:
    """Sum of the chances of all pairs of fillings that use each row up and whose log weight is at most ``limit``."""
    base = np.concatenate([[1], np.cumprod(r[:-2] + 1)]).astype(np.int64) if len(r) > 1 else np.ones(0, np.int64)
    key_a, key_b = (r[:-1] - a[0]) @ base, b[0] @ base
    order = np.lexsort((b[1], key_b))
    key_b, logs = key_b[order], b[1][order]
    first, end = np.searchsorted(key_b, key_a, "left"), np.searchsorted(key_b, key_a, "right")
    total = 0.0
    some = np.flatnonzero(end > first)
    some = some[np.argsort(first[some], kind="stable")]
    for rows in np.split(some, np.flatnonzero(np.diff(first[some])) + 1) if len(some) else []:
        lo, hi = first[rows[0]], end[rows[0]]
        top = logs[hi - 1]
        upto = np.concatenate([[0.0], np.cumsum(np.exp(logs[lo:hi] - top))])
        stop = np.searchsorted(logs[lo:hi], limit - a[1][rows], "right")
        total += float((np.exp(a[1][rows] + const + top) * upto[stop]).sum())
    return total


def _fisher_drawn(t: np.ndarray, own: float, const: float, draws: int, seed: int) -> float:
    draw = np.random.Generator(np.random.PCG64(seed))
    columns = np.repeat(np.arange(t.shape[1]), t.sum(0))
    rows = np.repeat(np.arange(t.shape[0]), t.sum(1))
    hit = 0
    for _ in range(draws):
        draw.shuffle(columns)
        table = np.zeros(t.shape, int)
        np.add.at(table, (rows, columns), 1)
        hit += const - float(log_factorial(table).sum()) <= own + 1e-7
    return (hit + 1) / (draws + 1)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 300):
        k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + k * d or 1e-300)
        c = 1 + k / c or 1e-300
        h *= d * c
        k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or 1e-300)
        c = 1 + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if not 0 < x < 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    """Two-tailed p of Student's t; NaN in, NaN out."""
    return math.nan if math.isnan(t) or not df > 0 else beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def poisson_cdf(k: float, mean: float) -> float:
    """P(X <= k) of a Poisson variable."""
    return 1.0 if mean <= 0 else 0.0 if k < 0 else gamma_q(math.floor(k) + 1, mean)


def qfast(ps: list[float], compat: bool = False) -> float:
    """p of a product of uniform p-values (T20; Q21: the whole series, or ``compat`` that stops a term early)."""
    n = len(ps)
    if not n:
        return math.nan
    if min(ps) <= 0:
        return 0.0
    if n == 1:
        return ps[0]
    x = -math.fsum(map(math.log, ps))
    if x <= 0:
        return 1.0
    terms = [-x]  # logarithms: the product of many p-values is below the least double
    for i in range(1, n - 1 if compat else n):
        terms.append(terms[-1] + math.log(x / i))
    most = max(terms)
    return min(1.0, math.exp(most) * math.fsum(math.exp(y - most) for y in terms))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided(a, b, c, d))


@F.pandas_udf(DoubleType())
def fisher_p_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_greater(a, b, c, d))


@F.pandas_udf(StructType([StructField("p", DoubleType()), StructField("method", StringType())]))
def fisher_p_table(cells: pd.Series, width: pd.Series) -> pd.DataFrame:
    got = [fisher_table(np.asarray(x, int).reshape(-1, int(w)).tolist(), "exact") for x, w in zip(cells, width, strict=True)]
    return pd.DataFrame(got, columns=["p", "method"])


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(x), float(n)) if x is not None and n is not None else math.nan for x, n in zip(t, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def chi_square_p(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(x) else gamma_q(float(n) / 2, float(x) / 2) for x, n in zip(stat, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def poisson_p(k: pd.Series, mean: pd.Series) -> pd.Series:
    return pd.Series([poisson_cdf(float(x), float(m)) for x, m in zip(k, mean, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def qfast_p(ps: pd.Series) -> pd.Series:
    return pd.Series([qfast([float(p) for p in x]) if x is not None else math.nan for x in ps], dtype=float)
