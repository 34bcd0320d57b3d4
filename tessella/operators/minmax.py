"""Min-max scaling in float32 over columns or over array positions.

Fit is one global aggregate (partial per task, one row per task shuffled).  Only the
statistics, two numbers a column, reach the driver; transform puts them into one projection
as literals, so it needs no join and no shuffle.  NaN and null are left out of the fit;
NaN stays NaN and null stays null.  A constant column scales to 0, values out of the
fitted range are not clipped unless asked for, and a column without values has the
statistics (+inf, -inf).  Columns or array positions that were not fitted raise.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
STATS = "feature string, data_min double, data_max double"
INF = float("inf")


def _as_float(c: Column) -> Column:
    return c.cast("float")


def _known(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def _extremes(c: Column) -> tuple[Column, Column]:
    v = _known(_as_float(c))
    return F.coalesce(F.min(v).cast("double"), F.lit(INF)), F.coalesce(F.max(v).cast("double"), F.lit(-INF))


def _need(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing or not cols or len(set(cols)) != len(cols):
        raise ValueError(f"columns {list(cols)} do not fit; missing: {missing}")


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, data_min, data_max), one row per column."""
    _need(df, cols)
    aggregates = []
    for k, c in enumerate(cols):
        low, high = _extremes(F.col(f"`{c}`"))
        aggregates += [low.alias(f"lo{k}"), high.alias(f"hi{k}")]
    one = df.agg(*aggregates)
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"lo{k}").alias("data_min"), F.col(f"hi{k}").alias("data_max")) for k, c in enumerate(cols)))
    return one.select(F.inline(rows))


def merge_stats(*stats: DataFrame) -> DataFrame:
    """Statistics of the union of what was fitted: an incremental fit."""
    whole = stats[0]
    for more in stats[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("feature").agg(F.min("data_min").alias("data_min"), F.max("data_max").alias("data_max"))


def _table(stats: DataFrame, cols: Sequence[str]) -> dict[str, tuple[np.float32, np.float32]]:
    known = {r["feature"]: (np.float32(r["data_min"]), np.float32(r["data_max"])) for r in stats.collect()}
    missing = [c for c in cols if c not in known]
    if missing:
        raise ValueError(f"not fitted: {missing}")
    return known


def inverse_range(low: np.float32, high: np.float32) -> np.float32:
    with np.errstate(all="ignore"):
        span = np.float32(high - low)
        return np.float32(0) if span == 0 else np.float32(np.float32(1) / span)


def _lit(x) -> Column:
    return F.lit(float(x)).cast("float")


def _clip(c: Column, low: float, high: float) -> Column:
    """NaN and null stay: ``least`` and ``greatest`` would order or skip them."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.least(F.greatest(c, _lit(low)), _lit(high)))


def _ranged(c: Column, feature_range: tuple[float, float], clip: bool) -> Column:
    low, high = feature_range
    if low >= high:
        raise ValueError("feature_range must ascend")
    if (low, high) != (0, 1):
        c = (c * _lit(high - low) + _lit(low)).cast("float")
    return _clip(c, low, high) if clip else c


def minmax_transform(df: DataFrame, stats: DataFrame, cols: Sequence[str], feature_range=(0, 1), clip: bool = False) -> DataFrame:
    """``df`` with ``cols`` scaled, as float."""
    _need(df, cols)
    known = _table(stats, cols)
    scaled = {}
    for c in cols:
        low, high = known[c]
        value = (_as_float(F.col(f"`{c}`")) - _lit(low)) * _lit(inverse_range(low, high))
        scaled[c] = _ranged(value, feature_range, clip)
    return df.withColumns(scaled)


def minmax_fit_transform(df: DataFrame, cols: Sequence[str], **options) -> DataFrame:
    return minmax_transform(df, minmax_fit(df, cols), cols, **options)


def minmax_inverse(df: DataFrame, stats: DataFrame, cols: Sequence[str], feature_range=(0, 1)) -> DataFrame:
    """Scaled values back in the fitted range; a constant column gives its constant."""
    _need(df, cols)
    known = _table(stats, cols)
    low, high = feature_range
    back = {}
    for c in cols:
        lo, hi = known[c]
        with np.errstate(all="ignore"):
            span = np.float32(hi - lo)
        unit = (_as_float(F.col(f"`{c}`")) - _lit(low)) * _lit(1 / (high - low))
        back[c] = (unit * _lit(span) + _lit(lo)).cast("float")
    return df.withColumns(back)


def array_fit(df: DataFrame, col: str) -> DataFrame:
    """(pos, data_min, data_max) per position of an array column."""
    at = df.select(F.posexplode(F.col(f"`{col}`")).alias("pos", "v"))
    low, high = _extremes(F.col("v"))
    return at.groupBy("pos").agg(low.alias("data_min"), high.alias("data_max"))


def array_transform(df: DataFrame, stats: DataFrame, col: str) -> DataFrame:
    """``df`` with the array column scaled in place, position by position; rows stay whole.  An
    array that is longer or shorter than the fitted ones raises, a null array stays null."""
    rows = sorted(stats.collect(), key=lambda r: r["pos"])  # one row per position
    lows = [np.float32(r["data_min"]) for r in rows]
    inverses = [inverse_range(np.float32(r["data_min"]), np.float32(r["data_max"])) for r in rows]
    factors = F.array(*(F.struct(_lit(a).alias("lo"), _lit(b).alias("inv")) for a, b in zip(lows, inverses)))
    value = lambda v, k: (v.cast("float") - F.get(factors, k)["lo"]) * F.get(factors, k)["inv"]
    given = F.col(f"`{col}`")
    message = F.concat(F.lit(f"array of {col}: {len(rows)} positions were fitted, given "), F.size(given).cast("string"))
    misfit = F.raise_error(message).cast("array<float>")
    scaled = F.transform(given, value) if rows else given.cast("array<float>")
    return df.withColumn(col, F.when(given.isNull() | (F.size(given) == len(rows)), scaled).otherwise(misfit))


class MinMaxScaler:
    """Estimator form: fit, transform, fit_transform, partial_fit and inverse_transform.

    ``copy`` is accepted and changes nothing: a DataFrame is never changed in place.  ``n_jobs``
    bounds the tasks of a scan that has more of them; rows are not reshuffled.  ``metrics_`` holds
    the row count that Spark observed while fitting."""

    PARAMETERS = ("cols", "feature_range", "copy", "clip", "n_jobs")

    def __init__(self, cols: Sequence[str], feature_range=(0, 1), copy: bool = True, clip: bool = False, n_jobs: int | None = None):
        self.set_params(cols=list(cols), feature_range=feature_range, copy=copy, clip=clip, n_jobs=n_jobs)
        self.stats_: DataFrame | None = None
        self.metrics_: dict[str, int] = {}

    def get_params(self, deep: bool = True) -> dict:
        return {name: getattr(self, name) for name in self.PARAMETERS}

    def set_params(self, **params) -> MinMaxScaler:
        unknown = set(params) - set(self.PARAMETERS)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        if params.get("n_jobs") is not None and params["n_jobs"] < 1:
            raise ValueError("n_jobs must be at least 1")
        self.__dict__.update(params)
        return self

    def set_output(self, transform: str | None = None) -> MinMaxScaler:
        """Results are DataFrames; None and "default" are the only containers."""
        if transform not in (None, "default"):
            raise ValueError(f"unknown container {transform!r}")
        return self

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.coalesce(self.n_jobs) if self.n_jobs else df

    def _stats(self) -> DataFrame:
        if self.stats_ is None:
            raise ValueError("not fitted")
        return self.stats_

    def _fitted(self, df: DataFrame, sample_weight=None) -> DataFrame:
        if sample_weight is not None:
            LOG.debug("sample_weight does not change extremes and is ignored")
        seen = Observation()
        rows = minmax_fit(self._dealt(df).observe(seen, F.count(F.lit(1)).alias("rows")), self.cols).collect()  # one row a column
        self.metrics_ = {"rows": seen.get["rows"]}
        LOG.debug("fitted %d columns on %d rows", len(rows), self.metrics_["rows"])
        return df.sparkSession.createDataFrame(rows, STATS)

    def fit(self, df: DataFrame, y=None, sample_weight=None) -> MinMaxScaler:
        self.stats_ = self._fitted(df, sample_weight)
        return self

    def partial_fit(self, df: DataFrame, y=None, sample_weight=None) -> MinMaxScaler:
        new = self._fitted(df, sample_weight)
        whole = new if self.stats_ is None else merge_stats(self.stats_, new)
        self.stats_ = df.sparkSession.createDataFrame(whole.collect(), STATS)
        return self

    @property
    def data_min_(self) -> list[float]:
        known = {r["feature"]: r["data_min"] for r in self._stats().collect()}
        return [known[c] for c in self.cols]

    @property
    def data_max_(self) -> list[float]:
        known = {r["feature"]: r["data_max"] for r in self._stats().collect()}
        return [known[c] for c in self.cols]

    def transform(self, df: DataFrame) -> DataFrame:
        return minmax_transform(df, self._stats(), self.cols, self.feature_range, self.clip)

    def fit_transform(self, df: DataFrame, y=None, **fit_params) -> DataFrame:
        return self.fit(df, y, **fit_params).transform(df)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return minmax_inverse(df, self._stats(), self.cols, self.feature_range)

    def get_feature_names_out(self, input_features: Sequence[str] | None = None) -> list[str]:
        if input_features is not None and list(input_features) != self.cols:
            raise ValueError("input_features are not the fitted columns")
        return list(self.cols)
