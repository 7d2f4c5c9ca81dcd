"""Models of root architecture over sets of axes: how an axis is measured, how a set is
fitted, what it is worth, and what it is worth once two axes have become one.

All are columns and aggregates, so every item and every state of a search is fitted at
once.  Smaller values are better.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootweave.operators import stats


def growth_ratio(length: Column, parent_length: Column) -> Column:
    """Share of its parent's length by which a lateral's whole way, from the seed on, is
    shorter: the same for all laterals where growth is constant and they start at one
    distance from the parent's tip."""
    return F.when(parent_length > 0, (parent_length - length) / parent_length)


def spread(state: Column) -> Column:
    """Standard deviation of a mergeable normal, 0 for an empty one."""
    return F.sqrt(F.greatest(F.coalesce(stats.variance(state), F.lit(0.0)), F.lit(0.0)))


@dataclass(frozen=True)
class Model:
    """Spread of the growth ratios times ``growth``, plus ``branching`` for every branching
    beyond the first on one segment."""

    growth: float = 1.0
    branching: float = 1.0

    def fit(self, axes: DataFrame, keys: list[str]) -> DataFrame:
        """``keys, s, extra, value`` of laterals ``axes(keys, v, base)``: ``v`` the growth ratio,
        ``base`` the segment they branch at.  Null values count in neither."""
        spots = axes.where("base is not null").groupBy(*keys, "base").agg((F.count("*") - 1).alias("more")).groupBy(*keys).agg(F.sum("more").alias("extra"))
        fitted = axes.groupBy(*keys).agg(stats.fit_normal(F.col("v")).alias("s")).join(spots, keys, "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
        return fitted.withColumn("value", self.value(F.col("s"), F.col("extra")))

    def value(self, s: Column, extra: Column) -> Column:
        return F.lit(self.growth) * spread(s) + F.lit(self.branching) * extra

    def merged(self, s: Column, v1: Column, v2: Column, v12: Column) -> Column:
        """The growth state where the axes of ``v1`` and ``v2`` became one of ``v12``."""
        for v in (v1, v2):
            s = F.when(v.isNull(), s).otherwise(stats.remove_value(s, v))
        return F.when(v12.isNull(), s).otherwise(stats.add_value(s, v12))


ARABIDOPSIS = Model(1.0, 1.0)
