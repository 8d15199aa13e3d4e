"""Tail probabilities as columns, for small tables of aggregated statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from specula.functions.probability import (
    chi2_sf, f_sf, fisher_two_sided, ks_sf, normal_two_sided, studentized_range_sf, t_two_sided)


def _tail(function):
    """A vectorised column function over aggregated statistics; missing input gives null."""
    @F.pandas_udf(DoubleType())
    def apply(*series: pd.Series) -> pd.Series:
        frame = pd.concat(series, axis=1).astype(float)
        out = [None if any(math.isnan(v) for v in row) else function(*row)
               for row in frame.itertuples(index=False, name=None)]
        return pd.Series(out, dtype="float64")
    return lambda *cols: apply(*cols)


p_normal = _tail(normal_two_sided)
p_chi2 = _tail(chi2_sf)
p_t = _tail(t_two_sided)
p_f = _tail(f_sf)
p_ks = _tail(ks_sf)
p_studentized_range = _tail(studentized_range_sf)
p_fisher = _tail(lambda a, b, c, d: fisher_two_sided(int(a), int(b), int(c), int(d)))
