"""Commit logs as tables: roles, touched test files, scans by unit, and extraction from commits and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import extract as X
from quarryline.operators.graph import ancestors
from quarryline.operators.joins import covered
from quarryline.operators.workflow import since
from quarryline.session import stored


def commit_roles(commits: DataFrame, changes: DataFrame, begin: Column, merged: Column | None = None) -> DataFrame:
    """Commits (repo, sha, date, agent, ...) from a day on, without merges, with their role and the test files they touch.

    ``changes`` has repo, sha and path. A commit with an agent is the agent's, others are human. Paths are distinct and sorted;
    a commit that touches none is no test commit.
    """
    touched = changes.filter(S.is_test_path("path")).groupBy("repo", "sha").agg(F.array_sort(F.collect_set("path")).alias("test_files"))
    rows = since(commits, "date", begin, merged).join(touched, ["repo", "sha"], "left")
    files = F.coalesce("test_files", F.array().cast("array<string>"))
    role = F.when(F.col("agent").isNotNull(), "agent").otherwise("human")
    return rows.withColumn("test_files", files).withColumn("role", role).withColumn("is_test_commit", F.size(files) > 0)


def test_commit_rows(roles: DataFrame, role: str) -> DataFrame:
    """The test commits of a role as rows for a text table: paths are one JSON array."""
    chosen = roles.filter((F.col("role") == role) & F.col("is_test_commit"))
    return chosen.select("repo", "sha", "role", "agent", "date", F.size("test_files").cast("long").alias("test_file_count"), F.to_json("test_files").alias("test_file_paths"))


def commit_links(commits: DataFrame) -> DataFrame:
    """Commits of agents with a link to each."""
    link = F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit("/commit/"), F.col("sha"))
    return commits.filter("agent is not null").withColumn("commit_url", link)


def scan_summary(roles: DataFrame) -> DataFrame:
    """For each unit: commits, those of agents and people, human test commits, the agents' share, and its bucket."""
    counts = roles.groupBy("repo").agg(
        F.count("*").alias("commits"),
        F.count_if(F.col("role") == "agent").alias("agent_commits"),
        F.count_if(F.col("role") == "human").alias("human_commits"),
        F.count_if((F.col("role") == "human") & F.col("is_test_commit")).alias("human_test_commits"),
    )
    return counts.withColumn("adoption", S.intensity("agent_commits", "commits"))


def human_pool(roles: DataFrame, changes: DataFrame) -> DataFrame:
    """Human test commits with whether all test files they touch only gain lines.

    ``changes`` has repo, sha, path, change_type and deleted_lines.
    """
    pure = X.pure_additions(changes).groupBy("repo", "sha").agg(F.coalesce(F.every(F.when(S.is_test_path("path"), F.col("pure"))), F.lit(True)).alias("accepted"))
    chosen = roles.filter("role = 'human' and is_test_commit")
    return chosen.join(pure, ["repo", "sha"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(True)))


def verification(commits: DataFrame) -> DataFrame:
    """One row over all units with a verified commit: units, commits, and commits per unit, 0 without units."""
    found = commits.filter("agent is not null")
    out = found.agg(F.countDistinct("repo").alias("repos"), F.count("*").alias("commits"))
    return out.withColumn("per_repo", F.coalesce(F.try_divide(F.col("commits").cast("double"), F.nullif(F.col("repos"), F.lit(0))), F.lit(0.0)))


def yield_of(commits: DataFrame, least_repos: int, least_commits: int) -> DataFrame:
    """Commits by agent, with the whole yield and whether both floors are met."""
    found = commits.filter("agent is not null")
    whole = found.agg(F.countDistinct("repo").alias("all_repos"), F.count("*").alias("all_commits"))
    enough = (F.col("all_repos") >= least_repos) & (F.col("all_commits") >= least_commits)
    return found.groupBy("agent").agg(F.count("*").alias("commits")).crossJoin(F.broadcast(whole)).withColumn("sufficient", enough)


def config_scan(files: DataFrame, patterns: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(repo, agent, n_files, first_file) of paths (repo, path) under each agent's patterns (agent, pattern, is a folder)."""
    hits = F.array(*(F.when(S.path_matches("path", p, is_dir), F.lit(agent)) for agent, p, is_dir in patterns))
    found = files.select("repo", "path", F.explode(F.array_distinct(F.array_compact(hits))).alias("agent"))
    return found.groupBy("repo", "agent").agg(F.countDistinct("path").alias("n_files"), F.min("path").alias("first_file"))


def config_summary(found: DataFrame) -> DataFrame:
    """Units by agent, and under null the units of several agents."""
    by_agent = found.groupBy("agent").agg(F.countDistinct("repo").alias("repos"), F.sum("n_files").alias("files"))
    several = found.groupBy("repo").agg(F.count("*").alias("n"), F.sum("n_files").alias("f")).filter("n > 1")
    return by_agent.unionByName(several.agg(F.lit(None).cast("string").alias("agent"), F.count("*").alias("repos"), F.coalesce(F.sum("f"), F.lit(0)).alias("files")))


def before_cutoff(commits: DataFrame, cutoff: Column) -> DataFrame:
    """Commits up to a day, each with how many its unit has up to then: a pool by unit without a list in one row."""
    kept = commits.filter(F.col("date") <= cutoff)
    return kept.join(kept.groupBy("repo").agg(F.count("*").alias("pool")), "repo")


def reachable(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snapshots`` (repo, date) with the number of commits (repo, date) of the unit up to it, 0 without any."""
    wanted = snapshots.select(F.col("repo").alias("__r"), F.col("date").alias("__d")).distinct()
    met = commits.join(wanted, (F.col("repo") == F.col("__r")) & (F.col("date") <= F.col("__d"))).groupBy("__r", "__d").agg(F.count("*").alias("commits"))
    out = snapshots.join(met, (F.col("repo") == F.col("__r")) & (F.col("date") == F.col("__d")), "left")
    return out.withColumn("commits", F.coalesce("commits", F.lit(0))).drop("__r", "__d")


def commits_before(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """``starts`` (repo, sha, ...) with the number of commits (repo, sha, parents) that each can reach, itself among them; 0
    for a commit that isn't in the table."""
    counts = ancestors(commits, starts).groupBy(F.col("repo").alias("__r"), F.col("sha").alias("__s")).agg(F.count("*").alias("commits"))
    return starts.join(counts, (F.col("repo") == F.col("__r")) & (F.col("sha") == F.col("__s")), "left").withColumn("commits", F.coalesce("commits", F.lit(0))).drop("__r", "__s")


def last_before(commits: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo, snapshot, sha): of each snapshot (repo, date) the commit with the last date up to it, of equal dates the least sha.

    A commit falls to the first snapshot on or after it; the last of each is found before commits are shuffled, and snapshots
    without one of their own take over that of the one before.
    """
    dates = snapshots.select("repo", F.col("date").alias("snapshot")).distinct()
    listed = dates.groupBy(F.col("repo").alias("__r")).agg(F.array_sort(F.collect_set("snapshot")).alias("__all"))
    own = commits.select("repo", "date", F.col("sha").cast("string").alias("sha")).join(listed, F.col("repo") == F.col("__r"))
    falls = own.withColumn("snapshot", F.get(F.filter("__all", lambda d: d >= F.col("date")), F.lit(0))).filter("snapshot is not null")
    per_day = falls.groupBy("repo", "snapshot", "date").agg(F.min("sha").alias("sha"))
    last = per_day.groupBy("repo", "snapshot").agg(F.max(F.struct("date", "sha")).alias("last"))
    up_to = F.last("last", ignorenulls=True).over(Window.partitionBy("repo").orderBy("snapshot"))
    found = dates.join(last, ["repo", "snapshot"], "left").withColumn("last", up_to)
    return found.filter("last is not null").select("repo", "snapshot", F.col("last.sha").alias("sha"))


#: The columns of a table of fixtures, in their order.
FIXTURE_COLUMNS = (
    "repo_name", "language", "commit_sha", "file_path", "fixture_name", "fixture_type", "start_line", "end_line", "loc", "framework", "num_mocks", "scope", "cyclomatic_complexity", "max_nesting_depth",
    "num_parameters", "num_objects_instantiated", "num_external_calls", "num_comment_lines", "comment_density", "has_teardown_pair", "github_url", "agent_type", "commit_kind", "commit_type", "raw_source",
    "commit_date", "repo_age_at_commit_years",
)


def fixture_table(found: DataFrame, files: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Fixtures (of syntax.with_teardown) as rows of the fixed columns and ``extra`` ones, which ``files`` has.

    ``files`` has file_id, repo, sha, path, agent_type, commit_kind, message, commit_date and created. Test doubles are counted
    in a fixture's own text.
    """
    rows = found.withColumn("num_mocks", X.mock_counts("raw_source")).join(files, "file_id")
    return rows.select(
        F.col("repo").alias("repo_name"), found["language"], F.col("sha").alias("commit_sha"), F.col("path").alias("file_path"), F.col("name").alias("fixture_name"), *(F.col(c) for c in FIXTURE_COLUMNS[5:10]),
        "num_mocks", *(F.col(c) for c in FIXTURE_COLUMNS[11:18]), F.round(S.density("num_comment_lines", "loc"), 4).alias("comment_density"),
        F.col("has_teardown_pair").cast("int").alias("has_teardown_pair"), S.source_url("repo", "sha", "path", "start_line", "end_line").alias("github_url"), "agent_type", "commit_kind",
        S.commit_type("message").alias("commit_type"), "raw_source", F.col("commit_date").cast("date").alias("commit_date"), F.round(S.age_years("created", "commit_date"), 4).alias("repo_age_at_commit_years"), *extra,
    )


def test_files_of(changes: DataFrame, added_only: bool = False) -> DataFrame:
    """(repo, sha, path, language) of the test files that commits touch, or only of those they add."""
    found = changes.filter(S.is_test_path("path"))
    if added_only:
        found = found.filter(F.lower("change_type").isin("add", "added"))
    return found.select("repo", "sha", "path", S.language_of("path").alias("language")).distinct()


def test_files_in(tree: DataFrame, language: str | None = None) -> DataFrame:
    """(repo, path, language) of the test files of a tree (repo, path), of any language or of one."""
    found = tree.filter(S.is_test_path("path")).select("repo", "path", S.language_of("path").alias("language")).distinct()
    return found if language is None else found.filter(F.col("language") == language)


#: Folders that a walk over a tree doesn't enter.
PRUNED = (".git", "node_modules", "vendor", "build", "dist", "target", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache")


def pruned(tree: DataFrame, path: str = "path", folders: Sequence[str] = PRUNED) -> DataFrame:
    """Paths that don't lie in one of the folders, at any depth."""
    return tree.filter(~F.arrays_overlap(F.split(F.col(path), "/"), F.array(*map(F.lit, folders))))


def _extracted(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fixtures of ``files`` (repo, sha, path, source, ...) with their scopes, partners and links."""
    keyed = files.withColumn("file_id", F.xxhash64("repo", "sha", "path")).withColumn("language", S.language_of("path"))
    # Sources are parsed once; the scopes are found in rounds over what came of that.
    found = stored(X.with_teardown(X.with_scopes(stored(X.fixtures(keyed.select("file_id", "language", "source")), "fixtures"))), "paired")
    uses = X.mocks(found.select(F.xxhash64("file_id", "name", "start_line").alias("file_id"), F.col("raw_source").alias("source")))
    counts = uses.groupBy(F.col("file_id").alias("__f")).agg(F.count("*").alias("num_mocks"))
    found = found.join(counts, F.xxhash64("file_id", "name", "start_line") == F.col("__f"), "left").drop("__f").withColumn("num_mocks", F.coalesce("num_mocks", F.lit(0)))
    where = keyed.select("file_id", *names).distinct()
    out = found.join(where, "file_id")
    return out.withColumn("github_url", S.source_url("repo", "sha", "path", "start_line", "end_line"))


def snapshot_fixtures(files: DataFrame) -> DataFrame:
    """Fixtures of the test files of a snapshot (repo, sha, path, source)."""
    return _extracted(pruned(files).filter(S.is_test_path("path")), ["repo", "sha", "path"])


def commit_fixtures(changes: DataFrame) -> DataFrame:
    """Fixtures that commits add: of changes (repo, sha, path, change_type, deleted_lines, diff, source).

    A commit whose test files don't all only gain lines gives none. Of the others, is_complete_addition tells fixtures of which
    every line is added.
    """
    tests = X.pure_additions(changes.filter(S.is_test_path("path")))
    impure = tests.filter(~F.col("pure")).select("repo", "sha").distinct()
    kept = tests.join(impure, ["repo", "sha"], "left_anti")
    found = _extracted(kept, ["repo", "sha", "path"])
    lines = X.added_lines(kept.select(F.concat_ws("\x00", "repo", "sha").alias("commit"), "diff"))
    lines = lines.select(F.xxhash64(F.split_part("commit", F.lit("\x00"), F.lit(1)), F.split_part("commit", F.lit("\x00"), F.lit(2)), "path").alias("file_id"), F.col("line").alias("point"))
    return covered(found, lines, ["file_id"], "start_line", "end_line", "point").withColumnRenamed("is_covered", "is_complete_addition")


def named_lines(files: DataFrame) -> DataFrame:
    """(file_id, point): lines of sources (file_id, language, source) that have code, not only comments, blanks and brackets.

    They are what a fixture's additions are compared with where a comment inside was there before.
    """
    import re
    from collections.abc import Iterator

    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file_id, language, source in zip(frame["file_id"], frame["language"], frame["source"], strict=True):
                text = re.sub(r"#[^\n]*", "", source or "") if language == "python" else X.blanked_comments(source or "")
                rows += [(file_id, k) for k, line in enumerate(text.split("\n"), 1) if re.search(r"\w", line)]
            yield pd.DataFrame(rows, columns=["file_id", "point"])

    return files.select(F.col("file_id").cast("long"), "language", "source").mapInPandas(run, "file_id long, point int")


def covered_by_code(spans: DataFrame, added: DataFrame, files: DataFrame, lines: Callable[[DataFrame], DataFrame] = named_lines) -> DataFrame:
    """``spans`` (file_id, start_line, end_line) with whether each line with code in them is added; spans without code need all.

    ``lines`` says which lines of ``files`` have code; syntax.leaf_lines goes by tokens, and tells keywords and brackets alone.
    """
    code = lines(files)
    keys = ["file_id", "start_line", "end_line"]
    wanted = spans.filter("start_line <= end_line").select(*keys).distinct().withColumn("point", F.explode(F.sequence("start_line", "end_line")))
    marked = wanted.join(code.withColumn("__code", F.lit(True)), ["file_id", "point"], "left").join(added.select("file_id", "point").distinct().withColumn("__added", F.lit(True)), ["file_id", "point"], "left")
    sums = marked.groupBy(*keys).agg(F.count_if(F.col("__code")).alias("c"), F.count_if(F.col("__code") & F.col("__added")).alias("ca"), F.count("*").alias("n"), F.count_if(F.col("__added")).alias("na"))
    whole = F.when(F.col("c") > 0, F.col("c") == F.col("ca")).otherwise(F.col("n") == F.col("na"))
    return spans.join(sums.select(*keys, whole.alias("is_covered")), keys, "left").withColumn("is_covered", F.coalesce("is_covered", F.lit(False)))
