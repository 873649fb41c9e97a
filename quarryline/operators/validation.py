"""Rows for review by hand: one canonical shape for several kinds, and samples of a size that a margin of error asks for."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import sampling as M
from quarryline.operators.running import joined, numbered
from quarryline.sources.files import write_summary

CANONICAL = ("validation_type", "language", "repo_full_name", "item_id", "item_url", "detection_signal", "evidence")


def _text(rows: DataFrame, name: str) -> Column:
    """A column as text, empty where it is null or not there."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")


def _commit_url(rows: DataFrame) -> Column:
    repo, sha = _text(rows, "repo_name"), _text(rows, "commit_sha")
    made = F.when((repo != "") & (sha != ""), F.concat(F.lit("https://github.com/"), repo, F.lit("/commit/"), sha)).otherwise("")
    return F.when(_text(rows, "commit_url") != "", _text(rows, "commit_url")).otherwise(made)


def _shape(rows: DataFrame, kind: str, item: Column, url: Column, signal: Column, evidence: Column) -> DataFrame:
    values = (F.lit(kind), _text(rows, "language"), _text(rows, "repo_name"), item, url, signal, evidence)
    return rows.select("*", F.struct(*(v.alias(n) for n, v in zip(CANONICAL, values, strict=True))).alias("__row")).select("__row.*")


def repo_rows(rows: DataFrame) -> DataFrame:
    signal = F.coalesce(S.blank_to_null(_text(rows, "matched_config_file")), F.lit("agent_config_present"))
    return _shape(rows, "repo", _text(rows, "repo_name"), F.concat(F.lit("https://github.com/"), _text(rows, "repo_name")), signal, signal)


def commit_rows(rows: DataFrame) -> DataFrame:
    evidence = F.concat(
        F.lit("agent_type="), _text(rows, "agent_type"), F.lit("; commit_date="), _text(rows, "commit_date"), F.lit("; author="), _text(rows, "author_name"), F.lit(" <"), _text(rows, "author_email"), F.lit(">")
    )
    return _shape(rows, "commit", _text(rows, "commit_sha"), _commit_url(rows), _text(rows, "agent_type"), evidence)


def fixture_rows(rows: DataFrame) -> DataFrame:
    item = F.concat_ws(":", *(_text(rows, c) for c in ("repo_name", "commit_sha", "file_path", "start_line")))
    return _shape(rows, "fixture", item, _text(rows, "github_url"), _text(rows, "fixture_type"), _text(rows, "raw_source"))


def human_commit_rows(rows: DataFrame) -> DataFrame:
    evidence = F.concat(F.lit("commit_role="), _text(rows, "commit_role"), F.lit("; commit_date="), _text(rows, "commit_date"), F.lit("; test_file_count="), _text(rows, "test_file_count"))
    return _shape(rows, "human_commit", _text(rows, "commit_sha"), _commit_url(rows), F.lit("classified_as_human"), evidence)


def human_test_commit_rows(rows: DataFrame) -> DataFrame:
    signal = F.concat(F.lit("test_file_count="), _text(rows, "test_file_count"))
    return _shape(rows, "human_test_commit", _text(rows, "commit_sha"), _commit_url(rows), signal, _text(rows, "test_file_paths"))


#: How each kind takes the canonical shape, and which of its rows count; kinds can be added.
NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "repo": repo_rows,
    "commit": commit_rows,
    "fixture": fixture_rows,
    "human_commit": human_commit_rows,
    "human_test_commit": human_test_commit_rows,
}
FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"repo": lambda rows: rows.filter(S.flag("has_agent_config")) if "has_agent_config" in rows.columns else rows.limit(0)}


def normalised(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of a kind that count, in the canonical shape."""
    return NORMALISERS[kind](FILTERS.get(kind, lambda r: r)(rows))


def validation_sample(rows: DataFrame, strata: Sequence[str], seed: int, margin: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """A sample of Cochran's size of all rows, shared out to strata by largest remainder, each ordered by content.

    Equal rows are told apart by nothing: of several that share a place the sample takes as many as its quota has room for.
    """
    total = rows.count()
    size = rows.sparkSession.range(1).select(M.sample_size(F.lit(total), margin, confidence).alias("n")).first()["n"]
    if not total:
        return rows
    counts = rows.groupBy(*strata).agg(F.count("*").alias("__n")) if strata else rows.agg(F.count("*").alias("__n"))
    keyed = counts.withColumn("__key", F.to_json(F.struct(*strata)) if strata else F.lit(""))
    quotas = M.largest_remainder(keyed, "__n", "__key", size).select(*strata, "quota")
    digest = M.content_order(rows.columns, seed)
    ordered = rows.withColumn("__d", digest).withColumn("__o", M.place_of(F.col("__d")))
    wants = joined(counts, quotas, strata).select(*strata, F.col("quota").alias("__want"), "__n")
    ranked = joined(numbered(M.first_by_hash(ordered, "__o", [(strata, wants)]), "__o", "__k", by=strata, ties=["__d"]), quotas, strata)
    return ranked.filter("__k <= quota").drop("__d", "__o", "__k", "quota")


def finished(sample: DataFrame, step: str, seed: int) -> DataFrame:
    """A sample in content order with ids step-0001, step-0002, ... and empty columns for the reviewer."""
    ordered = sample.withColumn("__d", M.content_order(sample.columns, seed)).withColumn("__o", M.place_of(F.col("__d")))
    named = numbered(ordered, "__o", "__k", ties=["__d"])
    return named.select(F.format_string(f"{step}-%04d", F.col("__k")).alias("validation_id"), *sample.columns, F.lit("").alias("label"), F.lit("").alias("reviewer_notes"))


def run_validation(step: str, kind: str, files: dict[str, DataFrame], strata: Sequence[str], seed: int, folder: str | None = None, combined: bool = True) -> DataFrame:
    """A sample over all files together, or of each file by itself; the plan is written as JSON if a folder is given."""
    parts = [normalised(rows, kind).withColumn("source_file", F.lit(name)) for name, rows in sorted(files.items())]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if combined:
        sample = validation_sample(whole, strata, seed)
    else:
        samples = [validation_sample(part, strata, seed) for part in parts]
        sample = samples[0]
        for other in samples[1:]:
            sample = sample.unionByName(other)
    out = finished(sample, step, seed)
    if folder:
        write_summary({"step": step, "kind": kind, "seed": seed, "strata": list(strata), "population": whole.count(), "sample": out.count()}, f"{folder}/{step}.json")
    return out


def sample_plan(units: DataFrame, key: str, size: str, by: str, target: int | None, match: DataFrame | None, seed: int, path: str | None = None) -> DataFrame:
    """Whole units by stratum towards ``target`` items in proportion, or towards the counts of another corpus (by, n).

    Exactly one of the two is given. The plan can be written as JSON, and read again instead of being drawn anew.
    """
    if (target is None) == (match is None):
        raise ValueError("a plan needs a target or another corpus to match, not both")
    if match is None:
        sums = units.groupBy(by).agg(F.sum(size).alias("__n"))
        quotas = M.largest_remainder(sums, "__n", by, int(target)).select(by, "quota")
    else:
        quotas = match.select(by, F.col("n").alias("quota"))
    chosen = M.whole_units(units, key, size, quotas, by, "quota", seed)
    if path:
        plan = chosen.groupBy(by).agg(F.count("*").alias("units"), F.sum(size).alias("items")).orderBy(by).collect()
        write_summary({"seed": seed, "target": target, "strata": json.loads(json.dumps([r.asDict() for r in plan]))}, path)
    return chosen


def head_sample(rows: DataFrame, by: str, order: str, ties: Sequence[str] = (), margin: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """The first rows of each stratum in their own order, as many as Cochran's size for it."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("__n")).select(by, M.sample_size(F.col("__n"), margin, confidence).alias("__size"))
    return joined(numbered(rows, order, "__k", by=[by], ties=ties), sizes, [by]).filter("__k <= __size").drop("__k", "__size")
