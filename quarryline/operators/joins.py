"""Joins by role: enrichment, reconciliation, snapshots, coverage, pairs and subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def enrich(left: DataFrame, right: DataFrame, on: Sequence[str], fallbacks: dict[str, object]) -> DataFrame:
    """``left`` with columns of ``right``, of which one row counts for a key; a missing or blank value has a fallback."""
    keys = list(on)
    values = list(fallbacks)
    one = right.groupBy(*keys).agg(F.min(F.struct(*values)).alias("__v"))
    out = left.join(one, keys, "left")
    for name, default in fallbacks.items():
        found = F.col(f"__v.{name}")
        if dict(right.dtypes)[name] == "string":
            found = F.when(F.trim(found) != "", found)
        out = out.withColumn(name, F.coalesce(found, F.lit(default)))
    return out.drop("__v")


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], expected: str, actual: str) -> DataFrame:
    """``left`` with a reason: missing on the right, mismatch of two columns, or ok."""
    other = right.select(*on, F.col(actual), F.lit(True).alias("__there")).distinct()
    joined = left.join(other, list(on), "left")
    reason = F.when(F.col("__there").isNull(), "missing").when(~F.col(expected).eqNullSafe(F.col(actual)), "mismatch").otherwise("ok")
    return joined.withColumn("reason", reason).drop("__there", actual)


def latest_before(events: DataFrame, keys: Sequence[str], time: str, cutoff: Column, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """For each key the values of the last row at or before the cutoff; ties go by ``order``, smallest first."""
    tied = F.struct(F.col(time), *[(-o).alias(f"__o{k}") for k, o in enumerate(order)])
    chosen = F.max_by(F.struct(F.col(time), *values), tied)
    return events.filter(F.col(time) <= cutoff).groupBy(*keys).agg(chosen.alias("__v")).select(*keys, f"__v.{time}", *(f"__v.{v}" for v in values))


def covered(spans: DataFrame, points: DataFrame, on: Sequence[str], first: str, last: str, point: str) -> DataFrame:
    """``spans`` with whether each whole number from first to last is a point of its key; spans with last < first aren't.

    Spans are unfolded into numbers, so this is an equi-join: no comparison of all spans with all points.
    """
    keys = [*on, first, last]
    wanted = spans.filter(F.col(first) <= F.col(last)).select(*keys).distinct().withColumn(point, F.explode(F.sequence(F.col(first), F.col(last))))
    met = wanted.join(points.select(*on, point).distinct(), [*on, point], "left_semi").groupBy(*keys).agg(F.count("*").alias("__n"))
    return spans.join(met, keys, "left").withColumn("is_covered", F.coalesce(F.col("__n") == F.col(last) - F.col(first) + 1, F.lit(False))).drop("__n")


def with_partner(rows: DataFrame, partners: DataFrame, on: Sequence[tuple[str, str]], name: str) -> DataFrame:
    """``rows`` with whether a partner has equal values in all pairs of columns, null being equal to null."""
    other = partners.select(*(F.col(b).alias(f"__p{k}") for k, (_, b) in enumerate(on))).distinct().withColumn("__hit", F.lit(True))
    condition = F.lit(True)
    for k, (a, _) in enumerate(on):
        condition = condition & F.col(a).eqNullSafe(F.col(f"__p{k}"))
    return rows.join(other, condition, "left").withColumn(name, F.col("__hit").isNotNull()).drop("__hit", *(f"__p{k}" for k in range(len(on))))


def share_of(frame: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``frame`` with each value's share of the sum of its group; by an aggregate and a join, so large groups are summed in parts."""
    if not by:
        total = frame.agg(F.sum(value).alias("__t"))
        return frame.crossJoin(F.broadcast(total)).withColumn(name, F.try_divide(F.col(value).cast("double"), F.nullif(F.col("__t"), F.lit(0)))).drop("__t")
    total = frame.groupBy(*by).agg(F.sum(value).alias("__t"))
    return frame.join(total, list(by)).withColumn(name, F.try_divide(F.col(value).cast("double"), F.nullif(F.col("__t"), F.lit(0)))).drop("__t")


def merged_with(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, whose keys are distinct, and _merge: both, or left_only where the key isn't there."""
    out = left.join(right.withColumn("__there", F.lit(True)), list(on), "left")
    return out.withColumn("_merge", F.when(F.col("__there"), "both").otherwise("left_only")).drop("__there")


def firsts(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that must be total."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
