"""The normal tail, which neither Spark SQL nor its function library offers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """``2 * (1 - Phi(|z|))``; applied to aggregated rows only (one per metric or segment)."""
    return z.map(lambda v: None if v is None or v != v else 2 * (1 - 0.5 * (1 + math.erf(abs(v) / math.sqrt(2)))))
