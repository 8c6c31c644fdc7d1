"""p-value of the two-sample Kolmogorov-Smirnov statistic from (D, n1, n2).

Small samples: the exact share of lattice paths leaving the band. Larger ones: the
distribution of the one-sample statistic at n = n1*n2/(n1+n2), by the matrix-power method
of Marsaglia, Tsang and Wang (2003) or the expansion of Pelz and Good (1976).
"""

from __future__ import annotations

import math

import numpy as np

EXACT_LIMIT = 10_000
MATRIX_LIMIT = 1_000


def two_sample_p(statistic: float, n1: int, n2: int) -> float:
    if n1 < 1 or n2 < 1 or statistic <= 0:
        return 1.0
    if max(n1, n2) <= EXACT_LIMIT:
        value = _outside_band(statistic, n1, n2)
    else:
        value = _one_sample_sf(statistic, max(1, round(n1 * n2 / (n1 + n2))))
    return min(1.0, max(0.0, value))


def _outside_band(statistic: float, n1: int, n2: int) -> float:
    """Share of merge orders of the two samples whose CDF gap reaches ``statistic``.

    Works along anti-diagonals s = i + j. The chance that a random path through (i, j) came
    from (i-1, j) is i/s, so no term grows or shrinks out of range.
    """
    lcm = n1 // math.gcd(n1, n2) * n2
    height = round(statistic * lcm)
    if height == 0:
        return 1.0
    i = np.arange(n1 + 1)
    gap_i = i * (lcm // n1)
    inside = np.zeros(n1 + 1)
    outside = np.zeros(n1 + 1)
    inside[0] = 1.0
    for s in range(1, n1 + n2 + 1):
        from_i = i / s
        stay = 1.0 - from_i
        new_in = inside * stay
        new_in[1:] += inside[:-1] * from_i[1:]
        new_out = outside * stay
        new_out[1:] += outside[:-1] * from_i[1:]
        j = s - i
        valid = (j >= 0) & (j <= n2)
        leaves = np.abs(gap_i - j * (lcm // n2)) >= height
        crossed = leaves & valid
        new_out[crossed] += new_in[crossed]
        new_in[leaves | ~valid] = 0.0
        new_out[~valid] = 0.0
        inside, outside = new_in, new_out
    return float(outside[n1])


def _one_sample_sf(d: float, n: int) -> float:
    if d >= 1:
        return 0.0
    if n * d * d > 18:
        return 2 * math.exp(-2 * n * d * d)
    if n <= MATRIX_LIMIT:
        return 1 - _matrix_cdf(d, n)
    return 1 - _expansion_cdf(d, n)


def _matrix_cdf(d: float, n: int) -> float:
    k = math.ceil(n * d)
    m = 2 * k - 1
    h = k - n * d
    matrix = np.zeros((m, m))
    rows, cols = np.indices((m, m))
    matrix[rows - cols + 1 >= 0] = 1.0
    powers = h ** np.arange(1, m + 1)
    matrix[:, 0] -= powers
    matrix[m - 1, :] -= powers[::-1]
    if 2 * h - 1 > 0:
        matrix[m - 1, 0] += (2 * h - 1) ** m
    order = rows - cols + 1
    table = np.cumsum([0.0] + [math.log(g) for g in range(1, m + 1)])
    matrix *= np.exp(-table[np.clip(order, 0, m)])
    result, exponent = np.eye(m), 0
    base, base_exponent, left = matrix, 0, n
    while left:
        if left & 1:
            result, exponent = result @ base, exponent + base_exponent
            result, exponent = _rescaled(result, exponent)
        base, base_exponent = base @ base, 2 * base_exponent
        base, base_exponent = _rescaled(base, base_exponent)
        left >>= 1
    log_factorial = math.lgamma(n + 1) - n * math.log(n)
    value = result[k - 1, k - 1]
    return 0.0 if value <= 0 else math.exp(math.log(value) + exponent * math.log(10) + log_factorial)


def _rescaled(matrix: np.ndarray, exponent: int) -> tuple[np.ndarray, int]:
    top = np.abs(matrix).max()
    if top > 1e140 or 0 < top < 1e-140:
        shift = int(math.log10(top))
        return matrix / 10.0**shift, exponent + shift
    return matrix, exponent


def _expansion_cdf(d: float, n: int) -> float:
    z = math.sqrt(n) * d
    if z <= 0:
        return 0.0
    z2, z4, z6 = z**2, z**4, z**6
    # the series run over all integers; each half is summed and doubled
    half = math.pi**2 * (np.arange(40) + 0.5) ** 2
    whole = math.pi**2 * np.arange(1, 41) ** 2
    at_half = 2 * np.exp(-half / (2 * z2))
    at_whole = 2 * np.exp(-whole / (2 * z2))
    root = math.sqrt(math.pi / 2)
    k0 = root / z * at_half.sum()
    k1 = root / (6 * z4) * ((half - z2) * at_half).sum()
    k2 = root / (72 * z**7) * (
        (6 * z6 + 2 * z4 + half * (2 * z4 - 5 * z2) + half**2 * (1 - 2 * z2)) * at_half
    ).sum() - root / (36 * z**3) * (whole * at_whole).sum()
    cubic = (
        half**3 * (5 - 30 * z2)
        + half**2 * (212 * z4 - 60 * z2)
        + half * (135 * z4 - 96 * z6)
        - 30 * z6
        - 90 * z**8
    )
    k3 = root / (6480 * z**10) * (cubic * at_half).sum() + root / (108 * z6) * (
        (3 * z2 * whole - whole**2) * at_whole
    ).sum()
    return float(k0 + k1 / math.sqrt(n) + k2 / n + k3 / n**1.5)
