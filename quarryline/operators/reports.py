"""Report frames: comparisons overall and by stratum with their cells, balance, yields, distributions, and their Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import stats
from quarryline.operators.aggregate import cluster_means
from quarryline.sources.files import markdown_table


def _number(value: Column, digits: int) -> Column:
    return F.when(value.isNull(), "--").otherwise(F.format_string(f"%.{digits}f", value))


def continuous_cells(tests: DataFrame) -> DataFrame:
    """Rank tests (n1, n2, u, cliffs_delta, magnitude, p, reason) with the cells of a comparison row."""
    return tests.withColumn("statistic", F.when(F.col("u").isNull(), "--").otherwise(F.concat(F.lit("U="), F.format_string("%.1f", F.col("u"))))).withColumn("effect", _number(F.col("cliffs_delta"), 3))


def categorical_cells(tests: DataFrame) -> DataFrame:
    """Contingency tests (n1, n2, chi2, dof, cramers_v, magnitude, p, reason) with the cells of a comparison row."""
    cell = F.format_string("chi2=%.1f (df=%d)", F.col("chi2"), F.col("dof"))
    return tests.withColumn("statistic", F.when(F.col("chi2").isNull(), "--").otherwise(cell)).withColumn("effect", _number(F.col("cramers_v"), 3))


def comparison(overall: DataFrame, strata: DataFrame | None, by: str) -> DataFrame:
    """One table from tests with cells: Overall first, with its raw p, then each stratum with raw and adjusted p.

    The family of the adjustment is this variable's strata alone. A test that couldn't run says so and has no cells.
    """
    head = overall.select(F.lit(0).alias("place"), F.lit("Overall").alias("label"), "n1", "n2", "statistic", "effect", "magnitude", "p", F.lit(None).cast("double").alias("p_adjusted"), "reason")
    rows = head
    if strata is not None:
        adjusted = stats.false_discovery(strata, [], [by])
        rows = head.unionByName(adjusted.select(F.lit(1).alias("place"), F.col(by).cast("string").alias("label"), "n1", "n2", "statistic", "effect", "magnitude", "p", "p_adjusted", "reason"))
    lacks = F.col("reason") == "insufficient_data"
    blank = lambda c: F.when(lacks, "--").otherwise(F.coalesce(F.col(c), F.lit("--"))).alias(c)
    p = F.when(lacks, "insufficient data").otherwise(S.formatted_p("p")).alias("p")
    return rows.select("place", "label", "n1", "n2", blank("statistic"), blank("effect"), blank("magnitude"), p, F.when(lacks, "--").otherwise(S.formatted_p("p_adjusted")).alias("p_adjusted"))


def continuous_comparison(rows: DataFrame, value: str, group: str, first: str, second: str, by: str | None = None, unit: str | None = None) -> DataFrame:
    """A continuous value in two groups, by row or, with a unit, by the units' means; by stratum too if one is given."""
    column = value
    if unit:
        column = f"mean_{value}"
        pooled, split = cluster_means(rows, unit, [value], [group]), cluster_means(rows, unit, [value], [group, by]) if by else None
    else:
        pooled, split = rows, rows if by else None
    overall = continuous_cells(stats.mann_whitney(pooled, column, group, first, second))
    return comparison(overall, None if split is None else continuous_cells(stats.mann_whitney(split, column, group, first, second, [by])), by or "")


def categorical_comparison(rows: DataFrame, category: str, group: str, first: str, second: str, by: str | None = None) -> DataFrame:
    overall = categorical_cells(stats.chi_square(rows, category, group, first, second))
    return comparison(overall, categorical_cells(stats.chi_square(rows, category, group, first, second, [by])) if by else None, by or "")


def presence_comparison(rows: DataFrame, has: Column, unit: str, group: str, first: str, second: str, by: str) -> DataFrame:
    """Whether something is there: a contingency test by row, and for each stratum a rank test of the units' shares of it."""
    marked = rows.withColumn("__has", F.when(has, "yes").otherwise("no"))
    overall = categorical_cells(stats.chi_square(marked, "__has", group, first, second))
    shares = stats.cluster_rank_tests(marked, unit, "__has", group, first, second, [by]).filter("__has = 'yes'").drop("__has")
    return comparison(overall, continuous_cells(shares), by)


def paired_balance(rows: DataFrame, category: str, group: str, first: str, second: str, least: int = 5) -> DataFrame:
    """Chi-square of all categories of either side, with a verdict; too few categories or rows give insufficient_data."""
    test = stats.chi_square(rows, category, group, first, second)
    lacks = (F.col("n1") < least) | (F.col("n2") < least) | F.col("reason").isNotNull()
    status = F.when(lacks, "insufficient_data").when(F.col("p") >= 0.05, "balanced").otherwise("imbalanced")
    hide = lambda c: F.when(~lacks, F.col(c)).alias(c)
    return test.select("n1", "n2", hide("chi2"), hide("dof"), hide("p"), status.alias("status"))


def rates_per(rows: DataFrame, group: str, items: str, units: str) -> DataFrame:
    """Items and units of each group, and items per unit, 0 without units."""
    out = rows.groupBy(group).agg(F.sum(items).alias("items"), F.sum(units).alias("units"))
    return out.withColumn("per_unit", F.coalesce(F.try_divide(F.col("items").cast("double"), F.nullif(F.col("units"), F.lit(0))), F.lit(0.0)))


def rejection_distribution(units: DataFrame, accepted: str, rejected: str) -> DataFrame:
    """Over units with items: how many there are, those that lose nothing or everything, and the mean share that is rejected."""
    share = F.col(rejected) / (F.col(accepted) + F.col(rejected))
    used = units.filter(F.col(accepted) + F.col(rejected) > 0)
    return used.agg(F.count("*").alias("units"), F.count_if(share == 0).alias("none_rejected"), F.count_if(share == 1).alias("all_rejected"), F.avg(share).alias("mean_rejected"))


def counters(rows: DataFrame, reason: str, by: str, values: Sequence[str]) -> DataFrame:
    """Counts by skip reason and stratum, with the means of values; the reason of what passed is null."""
    return rows.groupBy(by, reason).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def language_table(rows: DataFrame, source: str, language: str, languages: Sequence[str]) -> DataFrame:
    """Counts by source in one column for each language, with their sum; rows without a source are under N/A."""
    label = F.coalesce(F.col(source), F.lit("N/A")).alias(source)
    return rows.groupBy(label).agg(*(F.count_if(F.col(language) == x).alias(x) for x in languages)).withColumn("Total", sum((F.col(x) for x in languages[1:]), F.col(languages[0])))


def report(title: str, sections: Sequence[tuple[str, str, DataFrame]], digits: int = 3) -> str:
    """Markdown of (heading, note, small result) sections; a result of more rows than a report bears is an error."""
    parts = [f"# {title}"]
    for heading, note, frame in sections:
        parts += [f"## {heading}", *([note] if note else []), markdown_table(frame, digits)]
    return "\n\n".join(parts) + "\n"
