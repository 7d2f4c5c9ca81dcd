"""Statistics over groups of rows: trimmed summaries, histograms, thresholds,
mixtures, outliers, mergeable normals.  Every operator handles all groups in one job."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from rootweave.iterate import rounds, settle, ship


def placed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, v, n, before, c``: the distinct values of every group, how many rows have
    each, how many have a smaller one, and the rows of the group.

    Rows are counted by value before anything is put in order; values are dealt into
    ranges over all groups, numbered within a range, and the ranges' totals added up, so
    no task sorts a whole group."""
    counts = settle(rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n")))
    ranged = settle(counts.repartitionByRange(*[F.col(k) for k in keys], F.col("v")).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "part").agg(F.sum("n").alias("rows"))
    total = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "part", F.coalesce(F.sum("rows").over(total), F.lit(0)).alias("earlier"), F.sum("rows").over(Window.partitionBy(*keys)).alias("c"))
    within = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("b", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, [*keys, "part"])
    return out.select(*keys, "v", "n", (F.col("b") + F.col("earlier")).alias("before"), "c")


def trimmed_summary(rows: DataFrame, keys: list[str], value: str, outliers: float = 0.05) -> DataFrame:
    """``keys, n, mean, std`` (population) after dropping ``int(n * outliers)`` rows at
    both ends of each group.  Null values don't count; a group without any has no row."""
    at = placed(rows, keys, value)
    cut = F.floor(F.col("c") * F.lit(outliers))
    kept = at.withColumn("n", F.least(F.col("before") + F.col("n"), F.col("c") - cut) - F.greatest("before", cut)).where("n > 0")
    mean = F.sum(F.col("v") * F.col("n")) / F.sum("n")
    means = kept.groupBy(*keys).agg(mean.alias("mean"))
    spread = F.sqrt(F.sum((F.col("v") - F.col("mean")) ** 2 * F.col("n")) / F.sum("n"))
    return kept.join(means, keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), spread.alias("std"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``keys, q``: an array of the groups' quantiles, between neighbouring values in
    proportion."""
    at = placed(rows, keys, value)
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("c") - 1)).alias("r")) for i, s in enumerate(shares)])).alias("k")
    each = at.select(*keys, "v", "before", "n", k)
    has = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n"))
    low, high = F.floor("k.r"), F.ceil("k.r")
    found = each.groupBy(*keys, "k").agg(F.max(F.when(has(low), F.col("v"))).alias("lo"), F.max(F.when(has(high), F.col("v"))).alias("hi"))
    value_at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k.r") - F.floor("k.r"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k.i", value_at.alias("v")))), lambda x: x["v"]).alias("q"))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin from 0, the last closed on the right; null outside."""
    at = F.floor((v - low) / (high - low) * bins)
    at = F.when(high == low, F.lit(0)).otherwise(F.least(at, F.lit(bins - 1)))
    return F.when((v >= low) & (v <= high), at.cast("int"))


def histogram_compare(a: DataFrame, b: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``bin, a, b``: two normalised histograms on the bins of the first."""
    low, high = a.agg(F.min(value), F.max(value)).first()
    edge = lambda df, name: df.groupBy(bin_of(F.col(value), F.lit(low), F.lit(high), bins).alias("bin")).agg(F.count("*").alias(name)).where("bin is not null")
    both = edge(a, "a").join(edge(b, "b"), "bin", "full").na.fill(0)
    totals = both.agg(F.sum("a"), F.sum("b")).first()
    share = lambda c, t: (F.col(c) / F.lit(float(t or 1))).alias(c)
    return both.select("bin", share("a", totals[0]), share("b", totals[1]))


def correlation(a: Column, b: Column) -> Column:
    return F.corr(a, b)


def chi_square(reference: Column, test: Column) -> Column:
    return F.sum(F.when(reference != 0, (reference - test) ** 2 / reference))


def box_summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, q1, median, q3, low, high``: quartiles and whiskers at 1.5 ranges."""
    quartiles = quantiles(rows, keys, value, [0.25, 0.5, 0.75])
    span = (F.col("q")[2] - F.col("q")[0]) * 1.5
    inside = rows.join(quartiles, keys).where((F.col(value) >= F.col("q")[0] - span) & (F.col(value) <= F.col("q")[2] + span))
    return inside.groupBy(*keys).agg(
        F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.min(value).alias("low"), F.max(value).alias("high")
    )


def norm(rows: DataFrame, keys: list[str], value: str, p: float = 2.0) -> DataFrame:
    """``keys, norm``: p-norm of each group."""
    return rows.groupBy(*keys).agg(F.pow(F.sum(F.pow(F.abs(F.col(value)), F.lit(p))), F.lit(1 / p)).alias("norm"))


def normalise(rows: DataFrame, keys: list[str], value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``rows`` with ``value`` mapped to [low, high] within its group; the bounds are
    joined, so a large group is not gathered."""
    from rootweave.functions.numbers import linear_map

    bounds = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return rows.join(bounds, keys).withColumn(value, linear_map(F.col(value), F.col("__lo"), F.col("__hi"), low, high)).drop("__lo", "__hi")


def otsu(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, threshold, between``: the value with the largest variance between the
    rows up to it and the rows above; the smallest of equal ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    both = Window.partitionBy(*keys)
    rows = counts.select(
        *keys, "v", F.sum("n").over(up).alias("n1"), F.sum(F.col("n") * F.col("v")).over(up).alias("s1"), F.sum("n").over(both).alias("n"), F.sum(F.col("n") * F.col("v")).over(both).alias("s")
    )
    n2, s2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    variance = F.when(n2 > 0, F.col("n1") / F.col("n") * (n2 / F.col("n")) * (F.col("s1") / F.col("n1") - s2 / n2) ** 2).otherwise(0.0)
    rows = rows.select(*keys, "v", variance.alias("b"))
    best = rows.groupBy(*keys).agg(F.max_by("v", F.struct("b", F.negate("v"))).alias("threshold"), F.max("b").alias("between"))
    return best


def normal_pdf(v: Column, mean: Column, std: Column) -> Column:
    return F.exp(-((v - mean) ** 2) / (2 * std * std)) / (std * F.lit(math.sqrt(2 * math.pi)))


def normal_distance(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """Stop measure of the mixture: squared gap of the means over the spreads."""
    return (m1 - m2) ** 2 / (4 * s1**2 + s2**2)


def hard_mixture(v: np.ndarray, n: np.ndarray, lo: float, hi: float, classes: int, width: float, most: int, threshold: float) -> tuple[np.ndarray, bool]:
    """Hard EM over the bins of one histogram: rows ``(class, weight, mean, std)`` of the
    classes that have any, and whether it settled: the classes hardly move, or the bins are
    dealt as in an earlier round."""
    span, seen = hi - lo, set()
    fit = np.array([(k, 1 / classes, lo + span * (k + 0.5) / classes, max(span / (2 * classes), 1e-12)) for k in range(classes)])
    for _ in range(most):
        score = np.log(np.maximum(fit[:, 1], 1e-300)) - (v[:, None] - fit[:, 2]) ** 2 / (2 * fit[:, 3] ** 2) - np.log(fit[:, 3])
        chosen = score.argmax(axis=1)
        m, s1, s2 = (np.bincount(chosen, w, len(fit)) for w in (n, n * v, n * v * v))
        own = m > 0
        mean = s1[own] / m[own]
        spread = np.maximum(np.sqrt(np.maximum(s2[own] / m[own] - mean**2, 0.0)), width / 2)
        gap = ((mean - fit[own, 2]) ** 2 / (4 * spread**2 + fit[own, 3] ** 2)).max()
        fit = np.column_stack([fit[own, 0], m[own] / n.sum(), mean, spread])
        if gap <= threshold or chosen.tobytes() in seen:
            return fit, True
        seen.add(chosen.tobytes())
    return fit, False


def gaussian_mixture(rows: DataFrame, keys: list[str], value: str, classes: int = 2, bins: int = 256, most: int = 1000, threshold: float = 1e-10) -> DataFrame:
    """``keys, class, weight, mean, std``: hard EM of a 1-D mixture on a histogram of
    ``bins`` bins a group, from evenly spaced means; of equally likely classes the first
    takes a bin.  Classes that lose all bins are left out.

    A histogram has ``bins`` rows at most whatever the group's size, so each is fitted in
    one grouped pass.  A group not settled after ``most`` rounds raises.  Null values
    don't count, groups without any other have no row."""
    ship(rows.sparkSession)
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = bin_of(F.col(value), F.col("lo"), F.col("hi"), bins)
    hist = rows.join(bounds, keys).where(F.col(value).isNotNull()).groupBy(*keys, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("hi") - F.col("lo")) / bins
    hist = hist.select(*keys, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "n", (F.col("lo") + (F.col("bin") + 0.5) * width).cast("double").alias("v"), F.greatest(width, F.lit(1e-12)).cast("double").alias("width"))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v", kind="stable")
        first = group.iloc[0]
        fit, done = hard_mixture(group["v"].to_numpy(float), group["n"].to_numpy(float), first["lo"], first["hi"], classes, first["width"], most, threshold)
        if not done:
            raise RuntimeError(f"a mixture has not settled in {most} rounds: {first[keys].to_dict()}")
        out = group[keys].iloc[[0] * len(fit)].reset_index(drop=True)
        return out.assign(**{"class": fit[:, 0].astype("int32"), "weight": fit[:, 1], "mean": fit[:, 2], "std": fit[:, 3]})

    schema = T.StructType([hist.schema[k] for k in keys]).add("class", "integer").add("weight", "double").add("mean", "double").add("std", "double")
    return hist.groupBy(*keys).applyInPandas(fitted, schema)


def cluster_values(rows: DataFrame, keys: list[str], value: str, params: DataFrame) -> DataFrame:
    """``rows`` with ``class``: the component with the largest weighted density."""
    choice = F.array_max(F.transform("__p", lambda p: F.struct((p["weight"] * normal_pdf(F.col(value), p["mean"], p["std"])).alias("w"), F.negate(p["class"]).alias("c"))))
    packed = params.groupBy(*keys).agg(F.collect_list(F.struct("class", "weight", "mean", "std")).alias("__p"))
    return rows.join(packed, keys).withColumn("class", F.negate(choice["c"])).drop("__p")


def expectation(rows: DataFrame, keys: list[str], row_id: str, value: str, params: DataFrame, normalised: bool = True) -> DataFrame:
    """``keys, row_id, class, e``: weighted density of every component, by default as
    shares that add up to 1 for a row."""
    e = F.col("weight") * normal_pdf(F.col(value), F.col("mean"), F.col("std"))
    out = rows.join(params, keys).select(*keys, row_id, "class", e.alias("e"))
    if normalised:
        total = F.sum("e").over(Window.partitionBy(*keys, row_id))
        out = out.withColumn("e", F.when(total > 0, F.col("e") / total).otherwise(0.0))
    return out


def outliers(rows: DataFrame, keys: list[str], value: str, most: int | None = None) -> DataFrame:
    """``rows`` with ``outlier``: density times count below 0.5 under the normal of the
    rows that are none; refitted until no more are found."""
    state = settle(rows.withColumn("outlier", F.lit(False)))
    count = 0
    for _ in rounds(most):
        fit = state.where("not outlier").groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count(value).alias("__n"))
        dense = F.when(F.col("__s") > 0, normal_pdf(F.col(value), F.col("__m"), F.col("__s")) * F.col("__n") < 0.5).otherwise(F.col(value) != F.col("__m"))
        state = settle(state.drop("outlier").join(fit, keys, "left").withColumn("outlier", F.coalesce(dense, F.lit(False))).drop("__m", "__s", "__n"))
        found = state.where("outlier").count()
        if found <= count:
            break
        count = found
    return state


def fit_normal(v: Column) -> Column:
    """``struct(n, mean, m2)`` as an aggregate; ``m2`` is the sum of squared deviations."""
    return F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_normal(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    d = b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))


def add_value(a: Column, v: Column) -> Column:
    n = a["n"] + 1
    d = v - a["mean"]
    mean = a["mean"] + d / n
    return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + d * (v - mean)).alias("m2"))


def remove_value(a: Column, v: Column) -> Column:
    n = a["n"] - 1
    mean = F.when(n > 0, (a["mean"] * a["n"] - v) / n).otherwise(F.lit(0.0))
    return F.struct(n.alias("n"), mean.alias("mean"), F.when(n > 0, a["m2"] - (v - mean) * (v - a["mean"])).otherwise(F.lit(0.0)).alias("m2"))


def variance(a: Column) -> Column:
    return F.when(a["n"] > 0, a["m2"] / a["n"])


def time_source_table(rows: DataFrame, keys: list[str], value: str, long: float) -> DataFrame:
    """``keys, n, total, n_long``: per plant, time and source the number, sum and how many
    are longer than ``long``."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count_if(F.col(value) > long).alias("n_long"))


def multiplicity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of ``columns`` with how often each stands."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def label_histogram(rows: DataFrame, label: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``label, bin, w``: histogram of a measurement in which every label weighs 1."""
    total = rows.where(F.col(value).isNotNull()).groupBy(label).agg(F.count("*").alias("__t"))
    at = bin_of(F.col(value), F.lit(low), F.lit(high), bins)
    return rows.join(total, label).select(label, at.alias("bin"), (1 / F.col("__t")).alias("w")).where("bin is not null").groupBy(label, "bin").agg(F.sum("w").alias("w"))


def sequence_correlation(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``plant, time, corr, total``: correlation of the histograms of two sources of every
    plant and time; rows are ``(plant, time, source, value)`` with sources ``a`` and ``b``,
    bins that one source lacks count 0."""
    at = bin_of(F.col(value), F.lit(low), F.lit(high), bins)
    counts = rows.select("plant", "time", "source", at.alias("bin")).where("bin is not null").groupBy("plant", "time", "bin").agg(
        F.count_if(F.col("source") == "a").alias("a"), F.count_if(F.col("source") == "b").alias("b")
    )
    n, s = F.lit(float(bins)), lambda c: F.sum(c)
    sums = counts.groupBy("plant", "time").agg(
        s("a").alias("sa"), s("b").alias("sb"), s(F.col("a") * F.col("a")).alias("saa"), s(F.col("b") * F.col("b")).alias("sbb"), s(F.col("a") * F.col("b")).alias("sab")
    )
    va, vb = n * F.col("saa") - F.col("sa") ** 2, n * F.col("sbb") - F.col("sb") ** 2
    corr = F.when((va > 0) & (vb > 0), (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb))
    return sums.select("plant", "time", corr.alias("corr"), (F.col("sa") + F.col("sb")).alias("total"))


def mean_by_property(rows: DataFrame, keys: list[str], value: str, sequence: str, plants: int) -> DataFrame:
    """``keys, mean``: sum of a length over the number of plants of the sequences present."""
    return rows.groupBy(*keys).agg((F.sum(value) / (F.countDistinct(sequence) * F.lit(plants))).alias("mean"))
