"""Seeded operators: noise and noise padding, one generator for each series id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _per_series(make):
    """make(values, generator) for each row, as a pandas UDF of (id, values)."""
    @F.pandas_udf("array<double>")
    def run(ids: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([make(np.asarray(v, float), i) for i, v in zip(ids, values)])
    return run


def add_noise(series_id: Column, values: Column, delta: float, seed: int = 0) -> Column:
    """x + delta * N(0, sample standard deviation of x)."""
    def make(v, i):
        s = v.std(ddof=1) if len(v) > 1 else 0.0
        return v + delta * np.random.default_rng([seed, int(i) & 0xFFFFFFFFFFFF]).normal(0.0, s or 0.0, len(v))
    return _per_series(make)(series_id, values)


def pad_suffix_noise(series_id: Column, values: Column, length: int, seed: int = 0) -> Column:
    """Missing tail (to `length`) becomes U(0, 1) / 1000."""
    def make(v, i):
        v = v[~np.isnan(v)] if np.isnan(v).any() else v
        return np.concatenate([v, np.random.default_rng([seed, int(i)]).random(max(0, length - len(v))) / 1000])
    return _per_series(make)(series_id, values)


def pad_both_noise(series_id: Column, values: Column, length: int, seed: int = 0) -> Column:
    """The series in the middle of `length` points, U(0, 1) / 1000 around it."""
    def make(v, i):
        extra = max(0, length - len(v))
        r = np.random.default_rng([seed, int(i)]).random(extra) / 1000
        return np.concatenate([r[:extra // 2], v, r[extra // 2:]])
    return _per_series(make)(series_id, values)


#: Ways to give all series one length, by name.
PADDERS = {"none": None, "suffix_noise": pad_suffix_noise, "prefix_suffix_noise": pad_both_noise}
