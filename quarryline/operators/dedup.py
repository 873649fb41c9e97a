"""Duplicates by content key: clusters, survivors, audits, cascades and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.operators.joins import firsts


def duplicate_clusters(rows: DataFrame, key: Column, unit: str, order: Sequence[Column]) -> DataFrame:
    """One row for each loser of a cluster of equal keys: removed, kept, key and cluster size.

    The first by ``order``, which must be total, survives; ``unit`` names rows. Null and blank keys never make a cluster.
    """
    keyed = rows.withColumn("__key", key.cast("string")).filter(F.col("__key").isNotNull() & (F.trim("__key") != ""))
    sizes = keyed.groupBy("__key").agg(F.count("*").alias("cluster_size")).filter("cluster_size > 1")
    # The first of each key is found with a limit before the shuffle; the others meet it in a join, however many they are.
    kept = firsts(keyed.join(sizes, "__key"), ["__key"], order).select(F.col("__key").alias("__k"), F.col(unit).alias("kept"), "cluster_size")
    losers = keyed.join(kept, F.col("__key") == F.col("__k")).filter(~F.col(unit).eqNullSafe(F.col("kept")))
    return losers.select(F.col(unit).alias("removed"), "kept", F.col("__key").alias("content_key"), "cluster_size")


def cross_owner(rows: DataFrame, key: str, owner: str, meta: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One row for each (key, owner) that loses a key which several owners have: key, owner_removed, owner_kept, owners.

    Owners without a row in ``meta`` come last; further by ``order``, then by name.
    """
    pairs = rows.select(key, owner).filter(F.col(key).isNotNull()).distinct()
    several = pairs.groupBy(key).agg(F.count("*").alias("owners")).filter("owners > 1")
    known = pairs.join(several, key).join(meta.withColumn("__known", F.lit(1)), owner, "left")
    kept = firsts(known, [key], [F.col("__known").desc_nulls_last(), *order, F.col(owner)]).select(F.col(key).alias("__k"), F.col(owner).alias("owner_kept"))
    losers = pairs.join(several, key).join(kept, F.col(key) == F.col("__k")).filter(F.col(owner) != F.col("owner_kept"))
    return losers.select(key, F.col(owner).alias("owner_removed"), "owner_kept", "owners")


def excluded(rows: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*on).distinct(), list(on), "left_anti")


def cascade(parents: DataFrame, children: Sequence[tuple[DataFrame, str, str]], gone: DataFrame, key: str) -> list[DataFrame]:
    """Parents without those in ``gone``, and each level of children without those whose parent went.

    ``children`` are (rows, their own key, the column with the parent's key), from the top down.
    """
    out = [parents.join(gone.select(key).distinct(), key, "left_anti")]
    lost = gone.select(F.col(key).alias("__k")).distinct()
    for rows, own, parent in children:
        went = rows.join(lost, F.col(parent) == F.col("__k"), "left_semi")
        out.append(rows.join(lost, F.col(parent) == F.col("__k"), "left_anti"))
        lost = went.select(F.col(own).alias("__k")).distinct()
    return out


def resynced(parents: DataFrame, children: DataFrame, key: str, parent: str, counts: dict[str, Column]) -> DataFrame:
    """``parents`` with counts made anew from their children, 0 where there are none."""
    made = children.groupBy(F.col(parent).alias("__k")).agg(*(c.alias(n) for n, c in counts.items()))
    out = parents.drop(*counts).join(made, F.col(key) == F.col("__k"), "left").drop("__k")
    return out.fillna(0, list(counts))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], updates: Sequence[str]) -> DataFrame:
    """Rows of both; where a key is in both, ``updates`` come from the new row and the rest from the old. is_new marks others."""
    fresh = new.select(*keys, F.struct(*(c for c in new.columns if c not in keys)).alias("__new"))
    had = old.select(*keys, F.struct(*(c for c in old.columns if c not in keys)).alias("__old"))
    both = had.join(fresh, list(keys), "full")
    columns = [F.when(F.col("__old").isNull() | (F.col("__new").isNotNull() & F.lit(c in updates)), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in old.columns if c not in keys]
    return both.select(*keys, *columns, F.col("__old").isNull().alias("is_new"))


def inserted(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Old rows, and of new rows with a key that isn't there the first by ``order``."""
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return old.unionByName(first)


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children whose parent isn't there; a load that must not have any fails if this isn't empty."""
    return children.join(parents.select(F.col(key).alias("__k")).distinct(), F.col(foreign) == F.col("__k"), "left_anti")
