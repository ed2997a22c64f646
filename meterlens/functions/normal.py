"""Normal distribution as vectorised column functions (Spark SQL has no erf)."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _logcdf(z: float) -> float:
    if z > -10.0:
        return math.log1p(-0.5 * math.erfc(z / math.sqrt(2))) if z > 0 else math.log(0.5 * math.erfc(-z / math.sqrt(2)))
    # Far tail: asymptotic expansion of the Mills ratio.
    s = 1.0 / (z * z)
    series = 1 - s * (1 - 3 * s * (1 - 5 * s * (1 - 7 * s)))
    return -0.5 * z * z - math.log(-z) - 0.5 * math.log(2 * math.pi) + math.log(series)


def normal_logcdf(z: Column) -> Column:
    """log of the standard normal distribution function, also far out in the tail."""

    @F.pandas_udf("double")
    def logcdf(x: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((_logcdf(v) for v in x), dtype=float, count=len(x)))

    return logcdf(z)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""

    @F.pandas_udf("double")
    def quantile(x: pd.Series) -> pd.Series:
        normal = NormalDist()
        return x.map(normal.inv_cdf)

    return quantile(p)
