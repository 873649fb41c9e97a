"""Grouped distributions, cluster-level means, funnels, pivots and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.operators.joins import share_of
from quarryline.operators.running import joined, running


def distribution(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys, of rows in which none is null."""
    present = rows
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, *keys: str, by: Sequence[str] = ()) -> DataFrame:
    return share_of(distribution(rows, *by, *keys), "n", "share", by)


def rates(rows: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """Rows, and for each condition how many meet it and their share in percent."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{k}") for k, c in conditions.items()))
    for k in conditions:
        counts = counts.withColumn(f"pct_{k}", F.try_divide(F.col(f"n_{k}") * 100.0, F.col("n")))
    return counts


def mean_in_any_order(value: str, kind: str) -> Column:
    """The mean, of doubles the same in any order of the rows if all have ten decimal places at most: equal means are ties."""
    if kind not in ("double", "float"):
        return F.avg(value)
    number = F.col(value).cast("double")
    exact = number.try_cast("decimal(28,10)")
    whole = F.every(F.coalesce(exact.cast("double") == number, F.col(value).isNull()))
    return F.coalesce(F.when(whole, F.try_avg(exact).cast("double")), F.avg(value))


def cluster_means(rows: DataFrame, unit: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One mean of each value for each unit, so that a prolific unit counts once in what follows."""
    kinds = dict(rows.select(*values).dtypes)
    return rows.groupBy(*by, unit).agg(*(mean_in_any_order(v, kinds[v]).alias(f"mean_{v}") for v in values))


def mean_of_means(rows: DataFrame, unit: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    means = cluster_means(rows, unit, values, by)
    return means.groupBy(*by).agg(F.count("*").alias("units"), *(F.avg(f"mean_{v}").alias(f"mean_{v}") for v in values))


def cluster_proportions(rows: DataFrame, unit: str, category: str, by: Sequence[str] = ()) -> DataFrame:
    """The share of each category in each unit that has rows, 0 where it has none of it."""
    counts = distribution(rows, *by, unit, category)
    totals = counts.groupBy(*by, unit).agg(F.sum("n").alias("total"))
    grid = with_kinds(totals, counts, category)
    full = grid.join(counts, [*by, unit, category], "left")
    return full.select(*by, unit, category, (F.coalesce("n", F.lit(0)) / F.col("total")).alias("proportion"))


#: Categories in one row at most, about.
KINDS = 1024


def with_kinds(rows: DataFrame, counts: DataFrame, category: str) -> DataFrame:
    """``rows``, each with every category of ``counts``: that grid is the result. Categories are arrays of about KINDS; one such
    row is sent to all tasks, several are joined by their number."""
    parts = max(1, -(-counts.select(category).distinct().count() // KINDS))
    part = F.pmod(F.xxhash64(category), F.lit(parts)).cast("int")
    kinds = counts.groupBy(part.alias("__part")).agg(F.array_sort(F.collect_set(category)).alias("__kinds"))
    if parts == 1:
        met = rows.crossJoin(F.broadcast(kinds.select("__kinds")))
    else:
        met = rows.withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(kinds, F.col("__p") == F.col("__part")).drop("__p", "__part")
    return met.withColumn(category, F.explode("__kinds")).drop("__kinds")


def quantiles(rows: DataFrame, value: str, by: Sequence[str], points: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each group under the given names, null values left out.

    Values are counted first, and places come from running sums over distinct values in ranges, so no task holds a group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    sizes = counts.groupBy(*by).agg(F.sum("__c").alias("__n"))
    placed = joined(running(counts, "__v", {"__below": "__c"}, by=by, inclusive=False), sizes, by)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__below") <= place) & (place < F.col("__below") + F.col("__c")), F.col("__v")))

    def exact(q: float) -> Column:
        return F.lit(q) * (F.col("__n") - 1)

    found = placed.groupBy(*by).agg(
        F.max("__n").alias("__size"),
        *(at(F.floor(exact(q))).alias(f"__low_{name}") for name, q in points.items()),
        *(at(F.ceil(exact(q))).alias(f"__high_{name}") for name, q in points.items()),
    )
    part = lambda q: F.lit(q) * (F.col("__size") - 1) - F.floor(F.lit(q) * (F.col("__size") - 1))
    return found.select(*by, *((F.col(f"__low_{name}") * (1 - part(q)) + F.col(f"__high_{name}") * part(q)).alias(name) for name, q in points.items()))


def described(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation (0 of one value), minimum, quartiles and maximum; quartiles are interpolated."""
    out = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    out = joined(out, quantiles(rows, value, by, {"q25": 0.25, "median": 0.5, "q75": 0.75}), by)
    sd = F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd"))
    return out.select(*by, "n", "mean", sd.alias("sd"), "min", "q25", "median", "q75", "max")


def most_common(rows: DataFrame, by: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group; of several the least."""
    counts = distribution(rows, *by, value)
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(name))


def funnel(rows: DataFrame, by: str, bucket: str, buckets: Sequence[str], total: str = "Total") -> DataFrame:
    """Counts by bucket in columns, with their share of the row, for each group and for all together."""
    counts = rows.rollup(by).agg(F.grouping(by).alias("__g"), F.count("*").alias("n"), *(F.count_if(F.col(bucket) == b).alias(f"n_{b}") for b in buckets))
    label = F.when(F.col("__g") == 1, total).otherwise(F.col(by)).alias(by)
    return counts.select(label, "n", *(f"n_{b}" for b in buckets), *(F.try_divide(F.col(f"n_{b}") * 100.0, F.col("n")).alias(f"pct_{b}") for b in buckets))


def pivot_percent(rows: DataFrame, by: str, category: str, categories: Sequence[str]) -> DataFrame:
    """The share in percent of each category in each group, one column each."""
    counts = rows.groupBy(by).agg(*(F.count_if(F.col(category) == c).alias(f"__{k}") for k, c in enumerate(categories)))
    total = sum((F.col(f"__{k}") for k in range(1, len(categories))), F.col("__0"))
    return counts.select(by, *(F.try_divide(F.col(f"__{k}") * 100.0, total).alias(c) for k, c in enumerate(categories)))


def leakage(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Of each source: rows, those of another target, and their share in percent."""
    return rows.groupBy(source).agg(F.count("*").alias("n"), F.count_if(F.col(source) != F.col(target)).alias("leaked")).withColumn("pct", F.col("leaked") * 100.0 / F.col("n"))


def grouped_sets(rows: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """Aggregates for several sets of keys in one pass; a key outside a row's set is null."""
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(*aggregates)


def lorenz(rows: DataFrame, value: str, key: str) -> DataFrame:
    """For each row the share of units and of the value that rows up to it have, from the least on."""
    one = rows.select(key, value).withColumn("__one", F.lit(1).cast("long"))
    sums = one.agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    return running(one, value, {"rank": "__one", "cumulative": value}, ties=[key]).crossJoin(F.broadcast(sums)).select(
        key, value, (F.col("rank") / F.col("__n")).alias("unit_share"), F.try_divide(F.col("cumulative").cast("double"), F.nullif(F.col("__s"), F.lit(0))).alias("value_share")
    )


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, width: int = 40) -> DataFrame:
    """Counts in equal bins with bars; values outside go to the edge bins, the upper edge to the last; empty bins count 0."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    full = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    top = full.agg(F.max("n").alias("__m"))
    bar = F.repeat(F.lit("#"), F.bround(F.try_divide(F.col("n") * F.lit(float(width)), F.nullif(F.col("__m"), F.lit(0)))).cast("int"))
    return full.crossJoin(F.broadcast(top)).select("bin", F.lit(low) + F.col("bin") * F.lit((high - low) / bins), "n", F.coalesce(bar, F.lit(""))).toDF("bin", "low_edge", "n", "bar")


def timeline(rows: DataFrame, step: str, category: str) -> DataFrame:
    """Counts by step and category, 0 for those between the first and the last step that don't occur."""
    counts = distribution(rows, step, category)
    ends = counts.agg(F.min(step).alias("lo"), F.max(step).alias("hi"))
    steps = ends.filter("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(step))
    grid = with_kinds(steps, counts, category)
    return grid.join(counts, [step, category], "left").select(step, category, F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group_union(rows: DataFrame, side: str, category: str, k: int) -> DataFrame:
    """The k most frequent categories of each side, joined into one list, with each side's share of each of them."""
    table = shares(rows, category, by=[side])
    by = W.partitionBy(side).orderBy(F.col("n").desc(), F.col(category))
    chosen = table.withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= k).select(category).distinct()
    grid = table.select(side).distinct().crossJoin(chosen)
    return grid.join(table, [side, category], "left").select(side, category, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("share", F.lit(0.0)).alias("share"))


def trend(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson's correlation, and the line of y over log10(x + 1)."""
    lx = F.log10(F.col(x) + 1)
    return rows.groupBy(*by).agg(F.corr(x, y).alias("corr"), F.regr_slope(F.col(y), lx).alias("slope"), F.regr_intercept(F.col(y), lx).alias("intercept"))


def capped(rows: DataFrame, value: str, p: float, name: str) -> DataFrame:
    """``rows`` with a value cut to a percentile of all."""
    limit = quantiles(rows, value, [], {"__p": p})
    return rows.crossJoin(F.broadcast(limit)).withColumn(name, F.least(F.col(value), F.col("__p"))).drop("__p")


def kernel_density(rows: DataFrame, value: str, grid: Sequence[float], bandwidth: float) -> DataFrame:
    """A Gaussian density at the points of a grid: each row meets the few points, and sums are made before the shuffle."""
    scale = bandwidth * (2 * 3.141592653589793) ** 0.5
    at = F.explode(F.array(*map(F.lit, grid))).alias("x")
    each = rows.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), at)
    return each.groupBy("x").agg((F.sum(F.exp(-F.pow((F.col("x") - F.col("v")) / bandwidth, F.lit(2)) / 2)) / (F.count("*") * scale)).alias("density"))
