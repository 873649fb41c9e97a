"""Tests between two groups: rank sums, contingency tables, effect sizes, false-discovery control, modality."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions.scalars import cliffs_magnitude, cramers_magnitude
from quarryline.operators.aggregate import distribution
from quarryline.operators.running import joined, running


def exact_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided probability of a rank-sum statistic at least as extreme, without ties, by counting arrangements."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    # The counts are those of a Gaussian binomial coefficient: a product of (1 - q^(n2 + k)) / (1 - q^k).
    for k in range(1, n1 + 1):
        up = counts.copy()
        if n2 + k <= n1 * n2:
            up[n2 + k :] -= counts[: len(counts) - n2 - k]
        for j in range(k, len(up)):
            up[j] += up[j - k]
        counts = up
    top = max(u, n1 * n2 - u)
    return min(1.0, 2 * counts[int(math.ceil(top)) :].sum() / counts.sum())


def rank_sum_p(u: float, n1: int, n2: int, ties: float) -> float:
    """The two-sided p of U: exact for small samples without ties, else normal with tie and continuity corrections."""
    if min(n1, n2) <= 8 and ties == 0:
        return exact_tail(u, n1, n2)
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if sd == 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    return min(1.0, math.erfc(z / math.sqrt(2)))


def chi_square_p(x: float, dof: int) -> float:
    """The upper tail of the chi-square distribution: the regularised upper incomplete gamma function."""
    a, t = dof / 2, x / 2
    if t <= 0:
        return 1.0
    if t < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= t / k
            total += term
        return max(0.0, 1 - total * math.exp(-t + a * math.log(t) - math.lgamma(a)))
    # A continued fraction, from its front.
    b = t + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(-t + a * math.log(t) - math.lgamma(a)) * h


@F.pandas_udf(T.DoubleType())
def _rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_p(a, int(b), int(c), d) if b > 0 and c > 0 else 1.0 for a, b, c, d in zip(u, n1, n2, ties, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_p(a, int(b)) if b >= 1 and a == a else 1.0 for a, b in zip(x, dof, strict=True)], dtype=float)


def mann_whitney(rows: DataFrame, value: str, group: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """U of the first group, Cliff's delta (positive if the first is larger), p, and a reason where there is no test.

    Rows are first counted by value, so ranks come from running sums over distinct values. Nulls are left out. An empty side
    gives insufficient_data with p = 1; one value all through gives identical_distributions with U = 0 and p = 1.
    """
    used = rows.filter(F.col(value).isNotNull() & F.col(group).isin(first, second))
    counts = used.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    return rank_sums(counts, by)


def rank_sums(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same of values that are counted: v, a in the first group, b in the second, each v once in a stratum."""
    counts = counts.withColumn("t", F.col("a") + F.col("b"))
    ranked = running(counts, "v", {"below": "t"}, by=by, inclusive=False)
    rank = F.col("below") + (F.col("t") + 1) / 2
    tests = ranked.groupBy(*by).agg(
        F.sum("a").alias("n1"),
        F.sum("b").alias("n2"),
        F.sum(F.col("a") * rank).alias("r1"),
        F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"),
        F.count("*").alias("values"),
    )
    reason = F.when((F.col("n1") == 0) | (F.col("n2") == 0), "insufficient_data").when(F.col("values") == 1, "identical_distributions")
    tests = tests.withColumn("reason", reason)
    u = F.when(F.col("reason").isNull(), F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).when(F.col("reason") == "identical_distributions", 0.0)
    tests = tests.withColumn("u", u)
    delta = F.when(F.col("reason").isNull(), 2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1).when(F.col("reason") == "identical_distributions", 0.0)
    p = F.when(F.col("reason").isNull(), _rank_sum_p(F.coalesce("u", F.lit(0.0)), "n1", "n2", "ties")).otherwise(1.0)
    return tests.select(*by, "n1", "n2", "u", delta.alias("cliffs_delta"), cliffs_magnitude(delta).alias("magnitude"), p.alias("p"), "reason")


def cluster_rank_tests(rows: DataFrame, unit: str, category: str, group: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """A rank test for each category between the units' shares of it in the two groups, 0 where a unit has none of it.

    A category that no unit of a stratum has isn't tested there.
    """
    cells = distribution(rows.filter(F.col(group).isin(first, second)), *by, group, unit, category)
    totals = cells.groupBy(*by, group, unit).agg(F.sum("n").alias("__total"))
    sides = F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b")
    some = cells.join(totals, [*by, group, unit]).groupBy(*by, category, (F.col("n") / F.col("__total")).alias("v")).agg(*sides)
    units = totals.groupBy(*by).agg(*(s.alias(n) for s, n in zip(sides, ("__a", "__b"), strict=True)))
    # Units without the category have a share of 0; they are counted, not made.
    have = joined(some.groupBy(*by, category).agg(F.sum("a").alias("a"), F.sum("b").alias("b")), units, by)
    none = have.select(*by, category, F.lit(0.0).alias("v"), (F.col("__a") - F.col("a")).alias("a"), (F.col("__b") - F.col("b")).alias("b"))
    return rank_sums(some.unionByName(none.filter("a + b > 0")), [*by, category])


def chi_square(rows: DataFrame, category: str, group: str, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Chi-square of a two-row table with Cramér's V; with two categories Yates' correction applies.

    Categories that neither group has don't count. Fewer than two, or an empty side, give insufficient_data with p = 1.
    """
    used = rows.filter(F.col(category).isNotNull() & F.col(group).isin(first, second))
    cells = used.groupBy(*by, category).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b"))
    sums = cells.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.count("*").alias("k"))
    joined = cells.join(sums, list(by)) if by else cells.crossJoin(F.broadcast(sums))
    n = F.col("n1") + F.col("n2")

    def part(seen: str, side: str) -> Column:
        e = (F.col("a") + F.col("b")) * F.col(side) / n
        off = F.abs(F.col(seen) - e)
        off = off - F.when(F.col("k") == 2, F.least(F.lit(0.5), off)).otherwise(0.0)
        return F.when(e > 0, off * off / e).otherwise(0.0)

    tests = joined.groupBy(*by, "n1", "n2", "k").agg(F.sum(part("a", "n1") + part("b", "n2")).alias("x"))
    enough = (F.col("k") >= 2) & (F.col("n1") > 0) & (F.col("n2") > 0)
    v = F.when(enough, F.sqrt(F.col("x") / n))
    return tests.select(
        *by, "n1", "n2", F.when(enough, F.col("x")).alias("chi2"), F.when(enough, F.col("k") - 1).alias("dof"), v.alias("cramers_v"), cramers_magnitude(v).alias("magnitude"),
        F.when(enough, _chi_square_p("x", (F.col("k") - 1).cast("int"))).otherwise(1.0).alias("p"), F.when(~enough, "insufficient_data").alias("reason"),
    )


def false_discovery(tests: DataFrame, family: Sequence[str], key: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """``tests`` with p adjusted by Benjamini and Hochberg in each family, and the verdict; tests with a reason are skipped."""
    used = tests.filter(F.col("reason").isNull() | (F.col("reason") == "identical_distributions"))
    up = W.partitionBy(*family).orderBy("p", *key)
    m = F.count("*").over(W.partitionBy(*family))
    ranked = used.withColumn("__r", F.row_number().over(up)).withColumn("__q", F.col("p") * m / F.col("__r"))
    adjusted = F.least(F.lit(1.0), F.min("__q").over(up.rowsBetween(0, W.unboundedFollowing)))
    done = ranked.withColumn("p_adjusted", adjusted).drop("__r", "__q").withColumn("significant", F.col("p_adjusted") < alpha)
    skipped = tests.filter(F.col("reason").isNotNull() & (F.col("reason") != "identical_distributions"))
    return done.unionByName(skipped.withColumn("p_adjusted", F.lit(None).cast("double")).withColumn("significant", F.lit(None).cast("boolean")))


def _gap(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """How far ``high`` rises above the largest convex curve that stays under ``low``."""
    xs, ys = x.tolist(), low.tolist()
    hull: list[int] = []
    for i in range(len(xs)):
        while len(hull) > 1 and (ys[hull[-1]] - ys[hull[-2]]) * (xs[i] - xs[hull[-2]]) >= (ys[i] - ys[hull[-2]]) * (xs[hull[-1]] - xs[hull[-2]]):
            hull.pop()
        hull.append(i)
    return float((high - np.interp(x, x[hull], low[hull])).max()) if hull else 0.0


def dip(values: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The largest distance of an empirical distribution from the nearest one with a single mode.

    That has a convex curve up to some point and a concave one from there. Half the larger of both sides' gaps suffices; the
    left one grows with the point and the right one shrinks, so the best point is found by bisection. ``weights`` counts how
    often each value occurs.
    """
    x, at = np.unique(np.asarray(values, float), return_inverse=True)
    if len(x) < 2:
        return 0.0
    counts = np.bincount(at, weights)
    high = np.cumsum(counts) / counts.sum()
    low = high - counts / counts.sum()

    def sides(i: int) -> tuple[float, float]:
        return _gap(x[:i], low[:i], high[:i]), _gap(-x[i:][::-1], 1 - high[i:][::-1], 1 - low[i:][::-1])

    first, last = 0, len(x)
    while last - first > 1:
        i = (first + last) // 2
        left, right = sides(i)
        first, last = (first, i) if left >= right else (i, last)
    return min(max(sides(first)), max(sides(last))) / 2


#: Sizes for which uniform samples are drawn; between two of them quantiles are interpolated.
SIZES = (4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 75, 100, 150, 200, 300, 500, 750, 1024, 2048)
_null_tables: dict[tuple, np.ndarray] = {}


def null_table(spark: SparkSession, draws: int, seed: int) -> np.ndarray:
    """For each of SIZES the dips of ``draws`` uniform samples times the root of the size, in order: drawn by tasks, once."""
    key = (spark.sparkContext.applicationId, draws, seed)
    if key not in _null_tables:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                size = [SIZES[i // draws] for i in frame["id"]]
                scaled = [math.sqrt(n) * dip(np.random.default_rng([seed, int(i)]).random(n)) for n, i in zip(size, frame["id"], strict=True)]
                yield pd.DataFrame({"place": frame["id"] // draws, "scaled": scaled})

        # Samples of all sizes lie next to each other in every part.
        numbers = spark.range(len(SIZES) * draws).repartition(64, F.col("id") % 64)
        rows = numbers.mapInPandas(run, "place long, scaled double").collect()
        table = [sorted(r.scaled for r in rows if r.place == k) for k in range(len(SIZES))]
        _null_tables[key] = np.array(table)
    return _null_tables[key]


def dip_p(table: np.ndarray, n: int, found: float) -> float:
    """The share of uniform samples of ``n`` values with as large a dip: quantiles times the root of the size change little with
    it, so those of both neighbouring sizes are interpolated, and larger samples have those of the largest size."""
    k = min(int(np.searchsorted(SIZES, n, side="right")) - 1, len(SIZES) - 1)
    quantiles = table[k]
    if k + 1 < len(SIZES):
        quantiles = quantiles + (n - SIZES[k]) / (SIZES[k + 1] - SIZES[k]) * (table[k + 1] - quantiles)
    return float((quantiles >= math.sqrt(n) * found - 1e-12).mean())


def dip_tests(rows: DataFrame, value: str, by: Sequence[str], draws: int = 500, seed: int = 7) -> DataFrame:
    """The dip of each group with a p from a table of uniform samples; null for groups of three values or fewer.

    The dip is that of all values, counted by distinct value first; one task holds a group's distinct values. The table has the
    sizes SIZES, and all groups take their p from it in the same way.
    """
    table = null_table(rows.sparkSession, draws, seed)
    names = [f"k{i}" for i in range(len(by))]
    used = rows.filter(F.col(value).isNotNull()).select(*(F.col(b).alias(k) for b, k in zip(by, names, strict=True)), F.col(value).cast("double").alias("v"))
    counts = used.groupBy(*names, "v").agg(F.count("*").alias("c"))

    def test(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        n = int(group["c"].sum())
        found = p = None
        if n > 3:
            found = dip(group["v"].to_numpy(), group["c"].to_numpy())
            p = dip_p(table, n, found)
        return pd.DataFrame({**{k: [x] for k, x in zip(names, key, strict=True)}, "n": [n], "dip": pd.array([found], "Float64"), "p": pd.array([p], "Float64")})

    keys = counts.select(*names).schema.fields
    out = T.StructType([*keys, T.StructField("n", T.LongType()), T.StructField("dip", T.DoubleType()), T.StructField("p", T.DoubleType())])
    tested = counts.groupBy(*names).applyInPandas(test, out)
    return tested.select(*(F.col(k).alias(b) for b, k in zip(by, names, strict=True)), "n", "dip", "p")
