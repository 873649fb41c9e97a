"""Ancestors in histories with merges against plain code."""

import random

from quarryline.operators import commits, graph

SCHEMA = "repo string, sha string, parents array<string>, date int"


def reach(parents, start):
    seen, rest = set(), [start]
    while rest:
        c = rest.pop()
        if c in parents and c not in seen:
            seen.add(c)
            rest += parents[c] or []
    return seen


def test_ancestors_equal_plain_code(spark):
    r = random.Random(6)
    rows, want, starts = [], set(), []
    for repo in "abcd":
        n = r.randint(1, 120)
        parents = {f"{i}": [f"{r.randrange(max(0, i - 9), i)}" for _ in range(r.choice([1, 1, 1, 2, 3]))] if i and r.random() < 0.97 else r.choice([None, [], ["gone"]]) for i in range(n)}
        rows += [(repo, c, p, int(c)) for c, p in parents.items()]
        for at in {f"{r.randrange(n)}" for _ in range(3)}:
            starts.append((repo, at))
            want |= {(repo, at, c) for c in reach(parents, at)}
    rows += [rows[0], (None, "1", ["0"], 1), ("a", None, ["0"], 1)]
    starts += [starts[0], ("a", "unknown"), (None, "1"), ("zz", "1")]
    got = graph.ancestors(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(starts, "repo string, sha string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    counts = commits.commits_before(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(starts, "repo string, sha string")).collect()
    assert len(counts) == len(starts)
    assert all(x.commits == sum((x.repo, x.sha) == w[:2] for w in want) for x in counts)


def test_short_histories_are_walked_without_tables_and_long_ones_in_steps_alike(spark, monkeypatch):
    tables = []
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: tables.append(label) or real(df, label))
    r, rows = random.Random(3), []
    for repo, n in ((1, 5), (2, 90), (3, 40)):
        rows += [(repo, f"{i}", [f"{r.randrange(max(0, i - 6), i)}" for _ in range(r.choice([1, 2]))] if i else None) for i in range(n)]
    log = spark.createDataFrame(rows, "repo long, sha string, parents array<string>")
    starts = spark.createDataFrame([(1, "4"), (2, "89"), (2, "50"), (3, "39"), (3, "x")], "repo int, sha string")
    found = []
    for most in (4096, 42, 0):
        monkeypatch.setattr(graph, "SHORT", most)
        tables.clear()
        monkeypatch.setattr(graph, "SENT", 7 if most == 42 else 20_000)
        found.append(sorted(map(tuple, graph.ancestors(log, starts).collect())))
        assert (len(tables) < 3) == (most == 4096)
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_a_long_history_takes_few_steps(spark, monkeypatch):
    tables = []
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: tables.append(label) or real(df, label))
    n = 3000
    rows = [("r", f"{i}", [f"{i - 1}"] + ([f"{i - 7}"] if i % 10 == 0 else []) if i else [], i) for i in range(n)]
    got = graph.ancestors(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("r", f"{n - 1}")], "repo string, sha string"))
    assert got.count() == n
    assert len(tables) < 40


def test_circles_and_empty_tables_end(spark):
    rows = [("r", "a", ["b"], 1), ("r", "b", ["a", "b"], 1), ("r", "c", ["c"], 1)]
    starts = spark.createDataFrame([("r", "a"), ("r", "c")], "repo string, sha string")
    got = graph.ancestors(spark.createDataFrame(rows, SCHEMA), starts).collect()
    assert sorted((x.sha, x.ancestor) for x in got) == [("a", "a"), ("a", "b"), ("c", "c")]
    assert graph.ancestors(spark.createDataFrame([], SCHEMA), starts).collect() == []
    assert graph.ancestors(spark.createDataFrame(rows, SCHEMA), starts.limit(0)).collect() == []


def test_last_commit_up_to_a_day(spark):
    rows = [("r", "x", None, 3), ("r", "b", None, 5), ("r", "a", None, 5), ("r", "c", None, 9), ("s", "q", None, 7)]
    days = spark.createDataFrame([("r", d) for d in (1, 3, 4, 5, 8, 20)] + [("s", 6), ("s", 7), ("t", 7)], "repo string, date int")
    got = commits.last_before(spark.createDataFrame(rows, SCHEMA), days).collect()
    assert sorted((x.repo, x.snapshot, x.sha) for x in got) == [("r", 3, "x"), ("r", 4, "x"), ("r", 5, "a"), ("r", 8, "a"), ("r", 20, "c"), ("s", 7, "q")]


def test_a_long_history_takes_few_steps_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SHORT", 100)
    test_a_long_history_takes_few_steps(spark, monkeypatch)
