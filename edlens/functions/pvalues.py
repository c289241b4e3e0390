"""p-value columns for small tables of test statistics (one row per test, not per data row)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edlens.functions import tails


def _over(fn):
    def batch(*cols: pd.Series) -> list:
        return [None if any(pd.isna(v) for v in vs) else fn(*vs) for vs in zip(*cols)]

    return batch


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_over(tails.chi2_sf)(x, df), dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_over(tails.student_t_two_sided)(x, df), dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(_over(tails.f_sf)(x, d1, d2), dtype="float64")


@F.pandas_udf(T.DoubleType())
def _tq(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_over(tails.student_t_quantile)(p, df), dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    return pd.Series(_over(lambda v: 2 * tails.normal_sf(abs(v)))(z), dtype="float64")


@F.pandas_udf(T.DoubleType())
def _ks(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(_over(tails.kolmogorov_sf)(d, n, m), dtype="float64")


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def chi2_p(x: Column | str, df: Column | str) -> Column:
    return _chi2(_d(x), _d(df))


def t_p(x: Column | str, df: Column | str) -> Column:
    return _t(_d(x), _d(df))


def f_p(x: Column | str, d1: Column | str, d2: Column | str) -> Column:
    return _f(_d(x), _d(d1), _d(d2))


def t_quantile(p: float, df: Column | str) -> Column:
    return _tq(F.lit(p).cast("double"), _d(df))


def normal_p(z: Column | str) -> Column:
    """Two-sided."""
    return _normal(_d(z))


def ks_p(d: Column | str, n: Column | str, m: Column | str) -> Column:
    return _ks(_d(d), _d(n), _d(m))
