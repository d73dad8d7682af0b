"""Bandwidths of kernel densities, from counts of bins."""

from __future__ import annotations

import math

import numpy as np

SQRT_2PI = math.sqrt(2 * math.pi)


def pair_counts(counts: np.ndarray) -> np.ndarray:
    """For each distance of bins, how many pairs of values lie so far apart; a bin's own pairs are at 0."""
    counts = np.asarray(counts, float)
    size = 1 << (2 * len(counts) - 1).bit_length()
    spectrum = np.fft.rfft(counts, size)
    out = np.rint(np.fft.irfft(spectrum * spectrum.conj(), size)[: len(counts)])
    out[0] = (counts * (counts - 1)).sum() / 2
    return out


def sheather_jones(counts: np.ndarray, width: float, sd: float, iqr: float) -> float:
    """The bandwidth that solves Sheather and Jones' equation for values in bins of a width.

    It is the h with h = (R / (n psi4(g(h))))^(1/5), where R is that of the
    normal kernel, psi4 an estimate of the integral of the density times its
    fourth derivative, and g(h) grows as h^(5/7).  Where no h solves it, the
    rule of thumb is taken.
    """
    n = float(np.sum(counts))
    spread = min(sd, iqr / 1.349) if iqr > 0 else sd
    rule = 0.9 * spread * n**-0.2
    if n < 2 or not spread > 0:
        return rule
    pairs, apart = pair_counts(counts), np.arange(len(counts)) * width

    def psi(order: int, h: float) -> float:
        z = (apart / h) ** 2
        hermite = z * z - 6 * z + 3 if order == 4 else z**3 - 15 * z**2 + 45 * z - 15
        each = float((np.exp(-z / 2) * hermite * pairs).sum())
        own = 3 if order == 4 else -15
        return (2 * each + n * own) / (n * (n - 1) * h ** (order + 1) * SQRT_2PI)

    psi6 = -psi(6, 1.23 * spread * n ** (-1 / 9))
    if not psi6 > 0:
        return rule
    psi4 = psi(4, 1.24 * spread * n ** (-1 / 7))
    if not psi4 > 0:
        return rule
    scale = 1.357 * (psi4 / psi6) ** (1 / 7)

    def off(h: float) -> float:
        at = psi(4, scale * h ** (5 / 7))
        return (1 / (2 * math.sqrt(math.pi) * n * at)) ** 0.2 - h if at > 0 else math.inf

    high = 1.144 * spread * n**-0.2
    low, tries = 0.1 * high, 0
    while off(low) * off(high) > 0:
        if tries == 60:
            return rule
        low, high = (low, high * 1.2) if tries % 2 else (low / 1.2, high)
        tries += 1
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if off(mid) * off(low) > 0 else (low, mid)
    return (low + high) / 2


def normal_density(mass: np.ndarray, step: float, width: float) -> np.ndarray:
    """Density at the points of a grid from the mass at each of them, which sums to 1."""
    n = len(mass)
    kernel = np.exp(-0.5 * (np.arange(-n + 1, n) * step / width) ** 2) / (width * SQRT_2PI)
    size = 1 << (3 * n).bit_length()
    both = np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(kernel, size), size)
    return np.maximum(both[n - 1 : 2 * n - 1], 0.0)
