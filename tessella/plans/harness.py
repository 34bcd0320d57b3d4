"""Result-table operators of the benchmark harness, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which one of the conditions holds."""
    whole = conditions[0]
    for c in conditions[1:]:
        whole = whole | c
    return df.filter(whole)


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def config_grid(*axes: DataFrame) -> DataFrame:
    """Every combination of the rows of small configuration tables."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)
    return grid


def repeated(df: DataFrame, times: int, key: str = "copy") -> DataFrame:
    """``df`` concatenated with itself ``times`` times; ``key`` numbers the copies."""
    return df.withColumn(key, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def label_column(df: DataFrame, col: str, labels: dict[str, str], other: str, name: str = "label") -> DataFrame:
    out = F.lit(other)
    for value, text in labels.items():
        out = F.when(F.col(col) == value, text).otherwise(out)
    return df.withColumn(name, out)


def group_mean(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.avg(c).alias(c) for c in cols))


def reindexed(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` for each key of ``order``; keys without a row get nulls."""
    return order.join(df, key, "left")


def paired_ratio(df: DataFrame, config: Sequence[str], version: str, base: str, other: str, value: str) -> DataFrame:
    """value of ``base`` over value of ``other`` per configuration, by one aggregate."""
    of = lambda name: F.avg(F.when(F.col(version) == name, F.col(value)))
    return df.groupBy(*config).agg(of(base).alias("base"), of(other).alias("other")).withColumn("ratio", F.try_divide("base", "other"))


def lookup(df: DataFrame, keys: DataFrame, on: Sequence[str], value: str, order: str | None = None) -> DataFrame:
    """The value of each key, NaN where there is none; of several the first by ``order``, else the
    least."""
    first = F.min_by(value, order) if order else F.min(value)
    one = df.groupBy(*on).agg(first.alias(value))
    return keys.join(one, list(on), "left").withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))))


def relative_columns(df: DataFrame, total: str, cols: Sequence[str]) -> DataFrame:
    """``<col>_rel``: share of ``total``, rounded half to even to three places."""
    return df.withColumns({f"{c}_rel": F.bround(F.try_divide(F.col(c), F.col(total)), 3) for c in cols})


def overhead_columns(df: DataFrame, outer: str, inner: str, total: str) -> DataFrame:
    """``outer_overhead``: what ``outer`` takes above ``total``; its share of ``outer``; and
    ``call_overhead``: the share of ``outer`` that it takes above ``inner``."""
    o = F.col(outer)
    share = lambda c: F.bround(F.try_divide(o - F.col(c), o), 3)
    return df.withColumns({"outer_overhead": o - F.col(total), "call_overhead": share(inner), "outer_overhead_share": share(total)})


def with_affixes(df: DataFrame, prefix: str = "", suffix: str = "", without: str | None = None) -> list[str]:
    """Names of columns with a prefix and suffix, and not with another suffix."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and not (without and c.endswith(without))]


def stacked(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "stage", value: str = "value") -> DataFrame:
    """Long form of ``cols`` with the running sum of each row's stack."""
    parts, base = [], F.lit(0.0)
    for k, c in enumerate(cols):
        parts.append(F.struct(F.lit(k).alias("at"), F.lit(c).alias(name), F.col(c).cast("double").alias(value), (base + F.col(c)).alias("top")))
        base = base + F.col(c)
    return df.select(*keys, F.inline(F.array(*parts)))


def vocabulary_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(token, side): tokens of one vocabulary only, in both directions."""
    left = a.select("token").join(b.select("token"), "token", "left_anti").withColumn("side", F.lit("left"))
    right = b.select("token").join(a.select("token"), "token", "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def sparse_unequal(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "count") -> DataFrame:
    """(n,): cells in which two triplet tables differ, absent cells being 0."""
    both = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), list(keys), "full")
    return both.agg(F.count(F.when(F.coalesce("_a", F.lit(0)) != F.coalesce("_b", F.lit(0)), 1)).alias("n"))


def close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal within absolute and relative tolerance; NaN equals NaN."""
    near = (a == b) | (F.abs(a - b) <= tolerance + tolerance * F.abs(b))
    return F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(near)  # NaN compares as the largest number


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)
