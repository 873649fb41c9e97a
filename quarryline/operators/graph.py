"""Closures, least levels and ancestors over directed graphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import stored

#: Commits and starts of a history that one task walks through at once; longer ones take steps over all tasks.
SHORT = 4096
#: Ancestors in a batch that a task sends on, about.
SENT = 20_000


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """All (source, target) with a path of one edge or more; each round doubles the length of the paths that are known."""
    known = stored(edges.select(source, target).filter(F.col(source).isNotNull() & F.col(target).isNotNull()).distinct(), "paths")
    count = known.count()
    while True:
        onward = known.select(F.col(source).alias("__a"), F.col(target).alias("__b"))
        longer = known.join(onward, F.col(target) == F.col("__a")).select(source, F.col("__b").alias(target))
        known = stored(known.union(longer).distinct(), "paths")
        now = known.count()
        if now == count:
            return known
        count = now


def least_over_closure(nodes: DataFrame, edges: DataFrame, key: str, level: str, source: str, target: str) -> DataFrame:
    """``nodes`` with the least level among a node and all it depends on."""
    # Levels run along the edges until nothing falls any more: no pair of nodes further apart is ever made.
    edges = stored(edges.select(F.col(source).alias("__s"), F.col(target).alias("__t")).filter("__s is not null and __t is not null").distinct(), "edges")
    now = stored(nodes.groupBy(F.col(key).alias("__k")).agg(F.min(level).alias("__m")), "levels")
    while True:
        below = edges.join(now.select(F.col("__k").alias("__t"), F.col("__m").alias("__below")), "__t").groupBy("__s").agg(F.min("__below").alias("__below"))
        new = now.join(below, F.col("__k") == F.col("__s"), "left").select("__k", F.least("__m", "__below").alias("__m"), (F.coalesce(F.col("__below") < F.col("__m"), F.col("__m").isNull() & F.col("__below").isNotNull())).alias("__fell"))
        new = stored(new, "levels")
        now = new.select("__k", "__m")
        if new.filter("__fell").isEmpty():
            break
    return nodes.join(now, F.col(key) == F.col("__k"), "left").withColumn("effective", F.least(F.col(level), F.col("__m"))).drop("__k", "__m")


def ancestors(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """(repo, sha, ancestor): every commit from which each start (repo, sha) descends, itself among them.

    ``commits`` has repo, sha and parents (array). Histories of at most SHORT commits and starts are walked through one by one,
    the others by steps over all of them. Unknown starts, parents that aren't in the table and null keys have no rows; repeated
    commits count once.
    """
    commits, starts = commits.filter("repo is not null"), starts.filter("repo is not null")
    sizes = commits.select("repo").unionByName(starts.select("repo")).groupBy("repo").count()
    long = stored(sizes.filter(F.col("count") > SHORT).select("repo"), "long")
    if long.isEmpty():
        return _walked(commits, starts)
    # There are few: each has thousands of rows.
    long = F.broadcast(long)
    short = _walked(commits.join(long, "repo", "left_anti"), starts.join(long, "repo", "left_anti"))
    return short.unionByName(_stepped(commits.join(long, "repo", "left_semi"), starts.join(long, "repo", "left_semi")))


def _walked(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """The ancestors within histories that a task can hold, one after the other."""
    kinds = dict(commits.dtypes)
    empty = F.array().cast("array<string>")
    own = commits.filter("sha is not null").select("repo", "sha", F.coalesce("parents", empty).alias("parents"), F.lit(False).alias("start"))
    asked = starts.filter("sha is not null").select(F.col("repo").cast(kinds["repo"]), F.col("sha").cast(kinds["sha"]), empty.alias("parents"), F.lit(True).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, parents, wanted = None, {}, {}
        out: tuple[list, list, list] = ([], [], [])

        def walk() -> Iterator[pa.RecordBatch]:
            for at in wanted:
                if at not in parents:
                    continue
                seen, rest = {at}, [at]
                while rest:
                    new = [p for p in parents[rest.pop()] if p not in seen and p in parents]
                    seen.update(new)
                    rest += new
                out[0].extend([repo] * len(seen))
                out[1].extend([at] * len(seen))
                out[2].extend(seen)
                if len(out[0]) >= SENT:
                    yield sent()

        def sent() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (types[0], types[1], types[1]), strict=True)], ["repo", "sha", "ancestor"])
            for x in out:
                x.clear()
            return batch

        types = None
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(2)]
            for r, sha, before, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != repo:
                    yield from walk()
                    repo, parents, wanted = r, {}, {}
                if start:
                    wanted[sha] = True
                else:
                    parents.setdefault(sha, before)
        yield from walk()
        if out[0]:
            yield sent()

    dealt = own.unionByName(asked).repartition("repo").sortWithinPartitions("repo")
    return dealt.mapInArrow(run, f"repo {kinds['repo']}, sha {kinds['sha']}, ancestor {kinds['sha']}")


def _stepped(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """The ancestors within histories of any length.

    A commit's first known parent is its main line's; ancestors on the main line are found through tables of the 1st, 2nd, 4th,
    ... commit before each, so a history of n commits takes log(n) steps. Then the other parents of what was found are followed
    in the same way, as often as lines were merged one into the other.
    """
    known = commits.filter("repo is not null and sha is not null").select("repo", "sha", F.coalesce("parents", F.array().cast("array<string>")).alias("parents")).dropDuplicates(["repo", "sha"])
    own = stored(known.select("repo", "sha"), "commits")
    links = known.select("repo", "sha", F.posexplode("parents").alias("nth", "parent"))
    links = stored(links.join(own.withColumnRenamed("sha", "parent"), ["repo", "parent"], "left_semi"), "links")
    main = stored(links.groupBy("repo", "sha").agg(F.min(F.struct("nth", "parent")).alias("least")).select("repo", "sha", F.col("least.parent").alias("before")), "main")
    other = stored(links.join(main, ["repo", "sha"]).filter("parent != before").select("repo", "sha", "parent").distinct(), "other")
    longest = own.groupBy("repo").count().agg(F.max("count")).first()[0] or 0
    jumps, length = [main], 1
    while 2 * length < longest:
        onward = jumps[-1].select("repo", F.col("sha").alias("before"), F.col("before").alias("far"))
        jumps.append(stored(jumps[-1].join(onward, ["repo", "before"]).select("repo", "sha", F.col("far").alias("before")), f"before-{2 * length}"))
        length *= 2
        if jumps[-1].isEmpty():
            jumps.pop()
            break
    # (repo, start, sha) of commits that are known to be ancestors, and of the latest of these.
    latest = starts.select("repo", "sha").distinct().join(own, ["repo", "sha"]).select("repo", F.col("sha").alias("start"), "sha")
    found: DataFrame | None = None
    while True:
        for k, jump in enumerate(jumps):
            step = latest.join(jump, ["repo", "sha"]).select("repo", "start", F.col("before").alias("sha"))
            latest = latest.unionByName(step).distinct()
            if k % 2 or k == len(jumps) - 1:
                latest = stored(latest, "line")
        new = latest if found is None else latest.join(found, ["repo", "start", "sha"], "left_anti")
        found = stored(new if found is None else found.unionByName(new), "found")
        merged = latest.join(other, ["repo", "sha"]).select("repo", "start", F.col("parent").alias("sha")).distinct()
        latest = stored(merged.join(found, ["repo", "start", "sha"], "left_anti"), "merged")
        if latest.isEmpty():
            break
    return found.select("repo", F.col("start").alias("sha"), F.col("sha").alias("ancestor"))
