"""Exact null distribution of the Mann-Whitney U of two samples without ties.

Under the null hypothesis every arrangement of the m + n ranks is equally likely, and
the number of arrangements with U = u is the coefficient of q^u in the Gaussian binomial

    prod over i = 1..m of (1 - q^(n + i)) / (1 - q^i),        m <= n.

The numerator has few terms and depends on n, the denominator depends on m alone. The
denominator's series is found once by dynamic programming over one period (the least
common multiple of 1..m) and continued by binomial coefficients, so the work is bounded
by m (at most ``EXACT_SIZE``) and does not grow with n. All counts are Python integers;
only the final ratio is rounded.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

# Fixed value: the exact distribution is used if either sample has at most so many values
# and there are no ties.
EXACT_SIZE = 8


def exact_applies(n1: int, n2: int, has_ties: bool) -> bool:
    """Whether the exact distribution is the one to use for samples of these sizes."""
    return min(n1, n2) >= 1 and min(n1, n2) <= EXACT_SIZE and not has_ties


@lru_cache(maxsize=None)
def _one_period(m: int) -> tuple[int, list[int]]:
    """(period, A) with 1 / ((1 - q) prod (1 - q^i)) = A(q) / (1 - q^period)^(m + 1)."""
    period = math.lcm(*range(1, m + 1))
    poly = [1]
    for part in (1, *range(1, m + 1)):
        wider = [0] * (len(poly) + period - part)  # times 1 + q^part + q^(2 part) + ...
        for at in range(len(wider)):
            wider[at] = (poly[at] if at < len(poly) else 0) + (wider[at - part] if at >= part else 0)
            if period <= at < len(poly) + period:
                wider[at] -= poly[at - period]
        poly = wider
    return period, poly


def _sums_up_to(k: int, m: int) -> int:
    """Partitions of the numbers 0..k into parts of at most m."""
    if k < 0:
        return 0
    period, poly = _one_period(m)
    return sum(poly[j] * math.comb((k - j) // period + m, m) for j in range(k % period, min(k + 1, len(poly)), period))


def arrangements_up_to(u: int, n1: int, n2: int) -> int:
    """The number of arrangements of n1 + n2 distinct values with U <= u."""
    m, n = min(n1, n2), max(n1, n2)
    if u >= m * n:
        return math.comb(m + n, m)
    terms = {0: 1}  # exponent -> coefficient of the numerator
    for i in range(1, m + 1):
        step = dict(terms)
        for e, c in terms.items():
            step[e + n + i] = step.get(e + n + i, 0) - c
        terms = step
    return sum(c * _sums_up_to(u - e, m) for e, c in terms.items())


def exact_tail(u: int, n1: int, n2: int) -> float:
    """P(U >= u) under the null hypothesis; the distribution is symmetric about n1 n2 / 2."""
    return float(Fraction(arrangements_up_to(n1 * n2 - u, n1, n2), math.comb(n1 + n2, n1)))
