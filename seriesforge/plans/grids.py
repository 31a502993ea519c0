"""Parameter grids and named classifiers of the 1-NN suite."""

from __future__ import annotations

import math
import re

import numpy as np

# Exponents of the cost function, and tables of MSM and TWE parameters.
PLUS_EXPONENTS = [1, 1.5, 0.666666, 2, 0.5]
AMERCED_EXPONENTS = [1, 2, 0.5]
TWE_NU = [1e-5, 1e-4, 5e-4, 1e-3, 5e-3, 0.01, 0.05, 0.1, 0.5, 1]
TWE_LAMBDA = [i * 0.1 / 9 for i in range(10)]
MSM_COSTS = [float(x) for lo, hi, n in ((0.01, 0.1, 25), (0.1, 1, 26), (1, 10, 26), (10, 100, 26)) for x in np.linspace(lo, hi, n)[lo > 0.01:]]


def cdtw_grid(length: int, n: int = 100, exponents=(2.0,)) -> list[dict]:
    return [{"cfe": float(e), "window": math.ceil(p / 100 * length)} for e in exponents for p in range(n)]


def adtw_penalties(mean_directa: float) -> list[float]:
    return [mean_directa * (0.01 * i) ** 5 for i in range(1, 101)]


def adtw_grid(mean_directa: dict[float, float]) -> list[dict]:
    return [{"cfe": float(e), "penalty": w} for e, m in mean_directa.items() for w in adtw_penalties(m)]


def lcss_grid(length: int, sigma: float) -> list[dict]:
    windows = [int(x) for x in np.linspace(0, (length + 1) / 4, 10)]
    eps = np.linspace(0.2 * sigma, sigma, 10)
    return [{"window": windows[p % 10], "epsilon": float(eps[p // 10])} for p in range(100)]


def minkowski_grid() -> list[dict]:
    return [{"cfe": e} for e in PLUS_EXPONENTS]


def random_window(rng: np.random.Generator, length: int) -> int:
    return int(rng.integers(0, (length + 1) // 4 + 1))


def random_epsilon(rng: np.random.Generator, sigma: float) -> float:
    return float(rng.uniform(sigma / 5, sigma))


_FAMILY = {"ED": ("directa", {}), "Minkowski": ("directa", {}), "CDTW": ("dtw", {}), "CDTW+": ("dtw", {}), "ADTW": ("adtw", {}), "ADTW+": ("adtw", {}), "LCSS": ("lcss", {})}


def by_name(name: str) -> dict:
    """`[dN-]FAMILY1NN[-EXPONENT]` -> transform (default, or the N-th derivative), distance, fixed parameters; unknown names raise."""
    found = re.match(r"(?:d([123])-)?([A-Za-z]+\+?)1NN(?:-([0-9.]+))?\Z", name)
    if not found or found[2] not in _FAMILY:
        raise ValueError(f"unknown classifier {name!r}")
    distance, params = _FAMILY[found[2]]
    return {"transform": f"derivative{found[1]}" if found[1] else "default", "distance": distance, "params": params | ({"cfe": float(found[3])} if found[3] else {}), "family": found[2]}
