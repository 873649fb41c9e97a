"""Multi-step corpus work: gates, funnels, discovery rounds, audits and table exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.dedup import resynced
from quarryline.session import stored


def gated(rows: DataFrame, floors: dict[str, float], reasons: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the first floor that each misses as its skip_reason, null where it passes all; unknown values miss."""
    reason = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit(float("-inf"))) < v, (reasons or {}).get(c, f"low_{c}")) for c, v in floors.items()))
    return rows.withColumn("skip_reason", reason)


def reason_counts(rows: DataFrame, order: Sequence[str], column: str = "skip_reason", passed: str = "passed") -> DataFrame:
    """Counts by reason in a fixed order, 0 for those that don't occur; others follow under their names."""
    counts = rows.groupBy(F.coalesce(column, F.lit(passed)).alias("reason")).agg(F.count("*").alias("n"))
    listed = rows.sparkSession.createDataFrame([(r, k) for k, r in enumerate(order)], "reason string, place int")
    return counts.join(F.broadcast(listed), "reason", "full").select("reason", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("place", F.lit(len(order))).alias("place"))


def purity(rows: DataFrame, accepted: str, rejected: str, by: str, unset: str = "(not set)") -> DataFrame:
    """Accepted and rejected items by an attribute, units of each kind, and the rejection rate; no rate without items."""
    key = F.when(F.trim(F.coalesce(F.col(by), F.lit(""))) == "", unset).otherwise(F.col(by)).alias(by)
    a, r = F.coalesce(F.col(accepted), F.lit(0)), F.coalesce(F.col(rejected), F.lit(0))
    out = rows.groupBy(key).agg(F.count("*").alias("units"), F.sum(a).alias("accepted"), F.sum(r).alias("rejected"), F.count_if((r == 0) & (a > 0)).alias("units_pure"), F.count_if((a == 0) & (r > 0)).alias("units_impure"))
    return out.withColumn("pct_rejected", F.try_divide(F.col("rejected") * 100.0, F.nullif(F.col("accepted") + F.col("rejected"), F.lit(0))))


def contaminated(rows: DataFrame, by: str, column: str, allowed: Column) -> DataFrame:
    """Rows of each group, and those whose value isn't allowed there."""
    odd = ~F.coalesce(allowed, F.lit(False))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(odd).alias("foreign"), F.countDistinct(F.when(odd, F.col(column))).alias("foreign_values"))


def mismatches(rows: DataFrame, recorded: str, computed: Column, by: Sequence[str]) -> DataFrame:
    """How often a recorded value differs from what is computed again."""
    off = ~F.col(recorded).eqNullSafe(computed)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(off).alias("mismatched")).withColumn("pct_mismatched", F.col("mismatched") * 100.0 / F.col("n"))


def expanded(candidates: DataFrame, order: Sequence[Column], check: Callable[[DataFrame], DataFrame], target: int, first: int, rounds: int = 3) -> DataFrame:
    """The first ``target`` checked candidates, if the rounds suffice: a round takes as many more as the survival so far asks
    for, and looks at new ones only.

    A round without survivors doubles the number looked at, as looking is what costs. ``check`` keeps the columns of
    ``order``, which must be total.
    """
    limit, seen, kept = first, 0, 0
    found: DataFrame | None = None
    for _ in range(rounds):
        part = stored(check(candidates.orderBy(*order).offset(seen).limit(limit - seen)), "checked")
        kept += part.count()
        found = part if found is None else found.unionByName(part)
        if kept >= target:
            break
        seen, limit = limit, limit * 2 if not kept else max(limit + 1, -(-target * limit // kept))
    return found.orderBy(*order).limit(target)


def since(log: DataFrame, time: str, begin: Column, merged: Column | None = None) -> DataFrame:
    """Entries from a moment on, without merges."""
    out = log.filter(F.col(time) >= begin)
    return out if merged is None else out.filter(~F.coalesce(merged, F.lit(False)))


def exported(tables: dict[str, tuple[DataFrame, str | None, str | None]], roots: DataFrame, root: str) -> dict[str, DataFrame]:
    """Parts of tables that belong to chosen roots: {name: (rows, column with the parent's key, own key)}, from the top down.

    A table that has nothing left keeps its columns.
    """
    out: dict[str, DataFrame] = {}
    keys = roots.select(F.col(root).alias("__k")).distinct()
    for name, (rows, parent, own) in tables.items():
        part = rows.join(keys, F.col(parent or root) == F.col("__k"), "left_semi")
        out[name] = part
        if own:
            keys = part.select(F.col(own).alias("__k")).distinct()
    return out


def nested_to_tables(rows: DataFrame, key: str, array: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an array of structs as a parent table with the array's size, and a child table with the parent's key."""
    children = rows.select(key, F.posexplode(array).alias("place", "__c")).select(key, "place", "__c.*")
    parents = resynced(rows.drop(array), children, key, key, {f"num_{array}": F.count("*")})
    return parents, children


def regression(rows: DataFrame, target: str, numbers: Sequence[str], labels: Sequence[str]) -> dict:
    """Ordinary least squares on numbers and on label numbers (in alphabetical order): coefficients, intercept and R²."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = [f"__{c}" for c in labels]
    used = rows.select(target, *numbers, *labels).dropna()
    if labels:
        used = StringIndexer(inputCols=list(labels), outputCols=names, stringOrderType="alphabetAsc").fit(used).transform(used)
    ready = VectorAssembler(inputCols=[*numbers, *names], outputCol="__x").transform(used)
    model = LinearRegression(featuresCol="__x", labelCol=target, solver="normal").fit(ready)
    return {"intercept": model.intercept, "r2": model.summary.r2} | dict(zip([*numbers, *labels], map(float, model.coefficients), strict=True))
