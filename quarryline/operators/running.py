"""Running sums over rows in order, in ranges: no task sorts more than a range's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.session import stored

#: Rows of sums that are sent to all tasks at most.
FEW = 100_000


def running(frame: DataFrame, order: str, values: dict[str, str], by: Sequence[str] = (), ties: Sequence[str] = (), descending: bool = False, inclusive: bool = True) -> DataFrame:
    """``frame`` with the sums, for each new name, of a column over the rows of the group up to each row.

    ``order`` is a number; ``ties`` makes the order total. Rows are dealt by ranges of the order and stored, once: rows of one
    value lie in several ranges if they are many. Ranges get sums of their own, whose running sums are those of few rows;
    inside a range a window goes on from there.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    # Rows that are equal in all of it are in no order, and may lie on both sides of a range's end.
    spread = frame.withColumn("__any", F.rand(1))
    ranged = stored(spread.repartitionByRange(key, *ties, "__any").drop("__any").withColumn("__range", F.spark_partition_id()), "ranges")
    keys = [*by, "__range"]
    sums = ranged.groupBy(*keys).agg(*(F.sum(v).alias(f"__{k}") for k, v in values.items()))
    ahead = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, *(F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in values))
    inside = W.partitionBy(*keys).orderBy(key, *ties).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    own = ranged.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"__own_{k}") for k, v in values.items()))
    sums = sums.withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(keys)})
    # One row for each group and range: sent to all tasks where these are few.
    few = not by or ranged.select(*keys).distinct().count() <= FEW
    met = own.join(F.broadcast(sums) if few else sums, _same(keys))
    return met.select(*frame.columns, *((F.col(f"__{k}") + F.col(f"__own_{k}")).alias(k) for k in values))


def _same(keys: Sequence[str]):
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__j{i}"))
    return condition


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key; null keys meet, and without keys its one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    return left.join(right.withColumnsRenamed({k: f"__j{i}" for i, k in enumerate(keys)}), _same(keys)).drop(*(f"__j{i}" for i in range(len(keys))))


def numbered(frame: DataFrame, order: str, name: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """``frame`` with dense numbers from 1."""
    return running(frame.withColumn("__one", F.lit(1).cast("long")), order, {name: "__one"}, by, ties).drop("__one")
