"""Deterministic samples: sizes, quotas, whole units and strata. Draws are ordered by a seeded hash of the key."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.operators.running import FEW, _same, joined, numbered, running
from quarryline.session import stored


def draw(key: Column | str, seed: int) -> Column:
    """The place of a row in a seeded shuffle, whatever order it comes in."""
    return F.md5(F.concat(F.col(key).cast("string") if isinstance(key, str) else key, F.lit(f":{seed}")))


def place_of(digest: Column) -> Column:
    """The first 48 bits of a hexadecimal digest as a number in the same order."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")


#: Places are below this.
PLACES = float(1 << 48)


def _below(want: Column, size: Column) -> Column:
    """The place below which ``want`` of ``size`` evenly placed rows lie almost surely; all places where that is most of them."""
    share = (want + 6 * F.sqrt(want) + 12) / size
    return F.when(share >= 1, F.lit(PLACES)).otherwise(share * PLACES)


def first_by_hash(rows: DataFrame, place: str, wants: Sequence[tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """Enough of ``rows`` to hold the first rows of each group by ``place``, in one pass and without sorting all of them.

    ``wants`` are pairs of a group's columns and a table of these with __want and __n, the rows wanted and those there are. A
    bound on the place follows from both; only rows below the bound of one of their groups go on. Groups of the last pair that
    have fewer rows below their bound than wanted go on whole: the last pair's columns are among those of the others.
    """
    limits, names = rows, []
    for i, (by, table) in enumerate(wants):
        own = table.select(*by, F.least("__want", "__n").alias(f"__w{i}"), _below(F.col("__want"), F.col("__n")).alias(f"__b{i}"))
        few = not by or own.count() <= FEW
        limits = joined(limits, F.broadcast(own) if few else own, by)
        names += [f"__w{i}", f"__b{i}"]
    bound = F.greatest(*(F.col(f"__b{i}") for i in range(len(wants)))) if len(wants) > 1 else F.col("__b0")
    near = stored(limits.filter(F.col(place) < bound), "near")
    last = wants[-1][0]
    short = None
    for i, (by, table) in enumerate(wants):
        met = near.filter(F.col(place) < F.col(f"__b{i}")).groupBy(*by).agg(F.count("*").alias("__met"))
        wanted = table.filter("__want > 0").select(*by, F.least("__want", "__n").alias("__least"))
        lacking = wanted.crossJoin(met) if not by else wanted.join(met.withColumnsRenamed({k: f"__j{j}" for j, k in enumerate(by)}), _same(by), "left")
        lacking = lacking.filter(F.coalesce("__met", F.lit(0)) < F.col("__least")).select(F.lit(1).alias("__lacks"), *last)
        short = lacking if short is None else short.unionByName(lacking)
    short = stored(short.distinct(), "short")
    out = near.drop(*names)
    if short.isEmpty():
        return out
    if not last:
        return rows
    keys = short.drop("__lacks").withColumnsRenamed({k: f"__j{j}" for j, k in enumerate(last)})
    return out.join(keys, _same(last), "left_anti").unionByName(rows.join(keys, _same(last), "left_semi"))


def content_order(columns: Sequence[str], seed: int) -> Column:
    return F.sha2(F.concat(F.to_json(F.struct(*sorted(columns))), F.lit(f":{seed}")), 256)


def sample_size(population: Column, margin: float = 0.05, confidence: float = 0.95, p: float = 0.5) -> Column:
    """Cochran's size for a proportion with the finite correction, rounded up; 0 of nothing."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    n0 = z * z * p * (1 - p) / (margin * margin)
    return F.when(population <= 0, 0).otherwise(F.least(population, F.ceil(n0 / (1 + (n0 - 1) / population)))).cast("long")


def largest_remainder(strata: DataFrame, size: str, key: str, total: int) -> DataFrame:
    """``strata`` with whole quotas in proportion to their sizes that add up to ``total`` (or all there is)."""
    sums = strata.agg(F.sum(size).alias("__s"))
    shared = strata.crossJoin(F.broadcast(sums))
    target = F.least(F.lit(total), F.col("__s"))
    exact = F.col(size) * target / F.col("__s")
    shared = shared.withColumn("__f", F.floor(exact)).withColumn("__r", exact - F.floor(exact)).withColumn("__t", target)
    left = F.col("__t") - F.sum("__f").over(W.partitionBy())
    by = W.partitionBy().orderBy(F.col("__r").desc(), F.col(key))
    return shared.withColumn("quota", (F.col("__f") + F.when(F.row_number().over(by) <= left, 1).otherwise(0)).cast("long")).drop("__s", "__f", "__r", "__t")


def water_filling(strata: DataFrame, cap: str, weight: str, key: str, target: float, levels: int | None = None) -> DataFrame:
    """``strata`` with quotas in proportion to weights, none above its cap; what caps hold back goes to the others.

    In the order of cap / weight a stratum is full while that ratio is below the level that the rest then has. With ``levels``
    the level is the highest k / levels whose quotas don't exceed the target together, for whole k.
    """
    by = W.partitionBy().orderBy(F.col(cap) / F.col(weight), key)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    filled = strata.withColumn("__c", F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn("__w", F.sum(weight).over(W.partitionBy()) - F.coalesce(F.sum(weight).over(before), F.lit(0)))
    filled = filled.withColumn("__level", F.greatest(F.lit(float(target)) - F.col("__c"), F.lit(0.0)) / F.col("__w"))
    filled = filled.withColumn("__full", F.col(cap) / F.col(weight) < F.col("__level"))
    level = F.max(F.when(~F.col("__full"), F.col("__level"))).over(W.partitionBy())
    first = F.min(F.when(~F.col("__full"), F.struct((F.col(cap) / F.col(weight)).alias("r"), F.col(key), F.col("__level").alias("l")))).over(W.partitionBy())
    below = lambda x: F.least(F.col(cap).cast("double"), x * F.col(weight))
    quota = F.when(F.col("__full"), F.col(cap).cast("double")).otherwise(below(first["l"]))
    if levels:
        filled = filled.withColumn("__k", F.floor(first["l"] * levels))
        # Division may have rounded the level over a step: the sums of the steps around it decide.
        steps = [(F.col("__k") + up) / F.lit(float(levels)) for up in (1, 0, -1)]
        fits = [F.when(F.sum(below(x)).over(W.partitionBy()) <= F.lit(float(target)), x) for x in steps]
        filled = filled.withColumn("__step", F.coalesce(*fits))
        quota = below(F.col("__step"))
    return filled.withColumn("quota", F.when(level.isNull(), F.col(cap).cast("double")).otherwise(quota)).drop("__c", "__w", "__level", "__full", "__k", "__step")


def whole_units(units: DataFrame, key: str, size: str, quotas: DataFrame, by: str, quota: str, seed: int) -> DataFrame:
    """Units of each stratum, in seeded order, as long as each brings the total closer to the stratum's quota."""
    order = place_of(draw(key, seed))
    listed = units.join(quotas.select(by, quota), by).withColumn("__o", order)
    summed = running(listed, "__o", {"__after": size}, by=[by], ties=[key])
    before = F.col("__after") - F.col(size)
    good = (before < F.col(quota)) & (F.abs(F.col("__after") - F.col(quota)) < F.abs(before - F.col(quota)))
    marked = summed.withColumn("__bad", F.when(good, 0).otherwise(1))
    # Units stop at the first that doesn't help: those before the least bad place stay.
    stop = marked.filter("__bad = 1").groupBy(by).agg(F.min(F.struct("__o", key)).alias("__stop"))
    kept = marked.join(stop, by, "left").filter(F.col("__stop").isNull() | (F.struct("__o", key) < F.col("__stop")))
    return kept.drop("__o", "__after", "__bad", "__stop", quota)


def stratified(rows: DataFrame, key: str, strata: str, target: int, seed: int) -> DataFrame:
    """Rows of each stratum in proportion to its size, to exactly ``target`` rows or all there are.

    Quotas are rounded half to even; rows are topped up or cut by the seeded order.
    """
    sizes = stored(rows.groupBy(strata).agg(F.count("*").alias("__n")), "sizes")
    total = sizes.agg(F.sum("__n").alias("__s"))
    quotas = stored(sizes.crossJoin(F.broadcast(total)).select(strata, "__n", F.bround(F.col("__n") * F.lit(float(target)) / F.col("__s")).cast("long").alias("__q")), "quotas")
    # What rounding leaves to fill comes from any stratum.
    rest = max(0, target - (quotas.agg(F.sum(F.least("__q", "__n"))).first()[0] or 0))
    ordered = rows.withColumn("__d", draw(key, seed)).withColumn("__o", place_of(F.col("__d")))
    near = first_by_hash(ordered.filter(F.col(strata).isNotNull()), "__o", [([strata], quotas.select(strata, (F.col("__q") + rest).alias("__want"), "__n"))])
    ranked = numbered(near.join(quotas.drop("__n"), strata), "__o", "__r", by=[strata], ties=["__d", key])
    chosen = ranked.withColumn("__extra", F.col("__r") > F.col("__q"))
    return chosen.orderBy("__extra", "__d", key).limit(target).drop("__d", "__o", "__q", "__r", "__extra")


def quota_per_unit(rows: DataFrame, key: str, unit: str, by: str, targets: DataFrame, target: str, seed: int) -> DataFrame:
    """For each stratum its target of rows, the same floor from each unit first, then the rest by the seeded order."""
    sizes = stored(rows.groupBy(by, unit).agg(F.count("*").alias("__n")), "sizes")
    units = sizes.groupBy(by).agg(F.count(unit).alias("__u"), F.sum("__n").alias("__n"))
    plan = stored(targets.select(by, target).join(units, by).select(by, target, F.floor(F.col(target) / F.col("__u")).alias("__floor"), "__n"), "plan")
    wants = [
        ([by, unit], sizes.join(plan.select(by, "__floor"), by).select(by, unit, F.coalesce("__floor", F.lit(0)).alias("__want"), "__n")),
        ([by], plan.select(by, F.col(target).alias("__want"), "__n")),
    ]
    ordered = rows.join(plan.select(by), by, "left_semi").withColumn("__d", draw(key, seed)).withColumn("__o", place_of(F.col("__d")))
    drawn = first_by_hash(ordered, "__o", wants).join(plan.select(by, target, "__floor"), by)
    ranked = numbered(drawn, "__o", "__r", by=[by, unit], ties=["__d", key])
    # Rows beyond their unit's floor come after all others.
    late = ranked.withColumn("__o", F.when(F.col("__r") > F.col("__floor"), F.col("__o") + PLACES).otherwise(F.col("__o")))
    return numbered(late, "__o", "__n", by=[by], ties=["__d", key]).filter(F.col("__n") <= F.col(target)).drop("__d", "__o", "__r", "__n", "__floor", target)


def sample_check(rows: DataFrame, sample: DataFrame, by: str, tolerance: float) -> DataFrame:
    """Shares of each stratum in all rows and in the sample, and whether they are close."""
    from quarryline.operators.aggregate import shares

    full, part = shares(rows, by).select(by, F.col("share").alias("share_all")), shares(sample, by).select(by, F.col("share").alias("share_sample"))
    out = full.join(part, by, "left").fillna(0.0, ["share_sample"]).withColumn("deviation", F.abs(F.col("share_all") - F.col("share_sample")))
    return out.withColumn("ok", F.col("deviation") <= tolerance)


def balanced_pairs(rows: DataFrame, unit: str, role: str, roles: tuple[str, str], order: Sequence[Column], cap: int) -> DataFrame:
    """Of each unit equally many first rows of both roles, at most ``cap``."""
    counts = rows.groupBy(unit).agg(*(F.count_if(F.col(role) == r).alias(f"__{k}") for k, r in enumerate(roles)))
    take = counts.select(unit, F.least("__0", "__1", F.lit(cap)).alias("__take")).filter("__take > 0")
    ranked = rows.filter(F.col(role).isin(*roles)).join(take, unit).withColumn("__n", F.row_number().over(W.partitionBy(unit, role).orderBy(*order)))
    return ranked.filter("__n <= __take").drop("__n", "__take")


def relaxed(rows: DataFrame, attempts: Sequence[Column]) -> DataFrame:
    """The rows of the strictest attempt that any row passes, and its number."""
    passed = F.coalesce(*(F.when(c, k + 1) for k, c in enumerate(attempts)))
    marked = rows.withColumn("attempt", passed).filter("attempt is not null")
    least = marked.agg(F.min("attempt").alias("__least"))
    return marked.crossJoin(F.broadcast(least)).filter(F.col("attempt") == F.col("__least")).drop("__least")
