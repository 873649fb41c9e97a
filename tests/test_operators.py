"""Operators on small cases that can be worked out by hand or by brute force."""

import gzip
import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import aggregate as A
from quarryline.operators import dedup as D
from quarryline.operators import extract as X
from quarryline.operators import joins as J
from quarryline.operators import sampling as M
from quarryline.operators import stats
from quarryline.operators.graph import closure
from quarryline.operators.running import numbered, running
from quarryline.sources import files as IO
from quarryline.streaming import events as E


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_rank_sum_p_counts_arrangements():
    for n1, n2 in ((3, 4), (2, 5)):
        for u in range(n1 * n2 + 1):
            us = [sum(a > b for a in chosen for b in set(range(n1 + n2)) - set(chosen)) for chosen in itertools.combinations(range(n1 + n2), n1)]
            want = min(1.0, 2 * sum(x >= max(u, n1 * n2 - u) for x in us) / len(us))
            assert stats.rank_sum_p(u, n1, n2, 0) == pytest.approx(want)


def test_chi_square_tail():
    assert stats.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_p(2.0, 2) == pytest.approx(np.exp(-1), abs=1e-12)
    assert stats.chi_square_p(30.0, 4) == pytest.approx(np.exp(-15) * 16, rel=1e-9)
    assert stats.chi_square_p(0.0, 3) == 1.0


def test_mann_whitney_by_pairs(spark):
    rng = random.Random(4)
    data = [(g, s, rng.randint(0, 6)) for g in "ab" for s in "xy" for _ in range(20)] + [("a", "z", 1), ("a", "w", 2), ("b", "w", 2), ("a", "x", None)]
    got = {r.s: r for r in stats.mann_whitney(spark.createDataFrame(data, "g string, s string, v int"), "v", "g", "a", "b", ["s"]).collect()}
    for s in "xy":
        a, b = ([v for g, t, v in data if g == k and t == s and v is not None] for k in "ab")
        assert got[s].u == sum((x > y) + (x == y) / 2 for x in a for y in b)
        assert got[s].cliffs_delta == pytest.approx(sum((x > y) - (x < y) for x in a for y in b) / len(a) / len(b))
    assert (got["z"].reason, got["z"].p) == ("insufficient_data", 1.0)
    assert (got["w"].reason, got["w"].u, got["w"].p) == ("identical_distributions", 0.0, 1.0)


def test_chi_square_with_yates_and_without_data(spark):
    data = [("a", "x", "p")] * 8 + [("a", "x", "q")] * 2 + [("b", "x", "p")] * 3 + [("b", "x", "q")] * 7 + [("a", "y", "p")]
    got = {r.s: r for r in stats.chi_square(spark.createDataFrame(data, "g string, s string, c string"), "c", "g", "a", "b", ["s"]).collect()}
    assert got["x"].chi2 == pytest.approx(3.23232323, abs=1e-6)
    assert got["x"].dof == 1
    assert got["y"].reason == "insufficient_data"


def test_false_discovery(spark):
    tests = spark.createDataFrame([("f", 1, 0.01, None), ("f", 2, 0.04, None), ("f", 3, 0.03, None), ("f", 4, 1.0, "insufficient_data")], "f string, k int, p double, reason string")
    got = {r.k: r.p_adjusted for r in stats.false_discovery(tests, ["f"], ["k"]).collect()}
    assert [got[k] if got[k] is None else round(got[k], 6) for k in (1, 2, 3, 4)] == [0.03, 0.04, 0.04, None]


def test_dip_tells_one_mode_from_two(spark):
    rng = np.random.default_rng(1)
    data = [("one", float(x)) for x in rng.random(400)] + [("two", float(x)) for x in np.r_[rng.normal(0, 0.1, 200), rng.normal(3, 0.1, 200)]] + [("few", 1.0)] * 3
    got = {r.g: r for r in stats.dip_tests(spark.createDataFrame(data, "g string, x double"), "x", ["g"]).collect()}
    assert got["one"].p > 0.05
    assert got["two"].p <= 0.02
    assert got["few"].p is None
    assert stats.dip(np.array([1.0, 1.0])) == 0.0


def test_dip_is_that_of_all_values(spark):
    """Two modes too close for a hundred points are told apart by thousands; the dip is the exact one."""
    rng = np.random.default_rng(2)
    close = np.round(np.r_[rng.normal(0, 1, 3000), rng.normal(2.8, 1, 3000)], 2)
    data = [("close", float(x)) for x in close] + [("one", float(x)) for x in rng.normal(size=3000)]
    got = {r.g: r for r in stats.dip_tests(spark.createDataFrame(data, "g string, x double"), "x", ["g"]).collect()}
    assert got["close"].p <= 0.01 and got["one"].p > 0.05
    assert got["close"].dip == pytest.approx(stats.dip(close), abs=1e-9)
    # The best split by trying all, each side's curve from every line through two of its points.
    for n in (2, 5, 9):
        x = np.sort(rng.random(n))
        low, high = np.arange(n) / n, np.arange(1, n + 1) / n

        def gap(x, low, high):
            curve = [min([low[j], *(low[a] + (low[b] - low[a]) * (x[j] - x[a]) / (x[b] - x[a]) for a in range(j) for b in range(j + 1, len(x)))]) for j in range(len(x))]
            return max((h - c for h, c in zip(high, curve, strict=True)), default=0.0)

        best = min(max(gap(x[:i], low[:i], high[:i]), gap(-x[i:][::-1], 1 - high[i:][::-1], 1 - low[i:][::-1])) for i in range(n + 1)) / 2
        assert stats.dip(x) == pytest.approx(best, abs=1e-9)


def test_running_sums_in_ranges(spark):
    rng = random.Random(2)
    data = [(i, rng.randint(0, 50), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(data, "i int, v int, g string")
    got = {r.i: r for r in running(df, "v", {"total": "v"}, by=["g"], ties=["i"]).collect()}
    down = {r.i: r for r in running(df, "v", {"total": "v"}, ties=["i"], descending=True, inclusive=False).collect()}
    for g in "ab":
        total = 0
        for v, i in sorted((v, i) for i, v, h in data if h == g):
            total += v
            assert got[i].total == total
    total = 0
    for v, i in sorted(((v, i) for i, v, _ in data), key=lambda x: (-x[0], x[1])):
        assert down[i].total == total
        total += v
    assert sorted(r.n for r in numbered(df, "v", "n", ties=["i"]).collect()) == list(range(1, 501))


def test_empty_tables_pass_through(spark):
    empty = spark.createDataFrame([], "k int, g string, v double")
    assert rows(A.shares(empty, "g")) == []
    assert rows(stats.mann_whitney(empty, "v", "g", "a", "b", ["k"])) == []
    assert rows(A.cluster_proportions(empty, "k", "g")) == []
    assert rows(D.duplicate_clusters(empty, F.col("g"), "k", [F.col("k")])) == []
    assert rows(M.stratified(empty, "k", "g", 10, 1)) == []
    assert rows(A.timeline(empty.withColumn("y", F.lit(1)), "y", "g")) == []
    assert rows(running(empty, "v", {"s": "v"})) == []


def test_duplicates_leave_blank_keys_alone(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, "x", 9), (3, "", 1), (4, "", 1), (5, None, 1), (6, "y", 1), (7, "x", 9)], "id int, k string, stars int")
    assert rows(D.duplicate_clusters(df, F.col("k"), "id", [F.desc("stars"), F.col("id")])) == [(1, 2, "x", 3), (7, 2, "x", 3)]


def test_cross_owner_prefers_known_owners(spark):
    pairs = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s1", "b"), ("s2", "a"), ("s1", "c")], "sha string, repo string")
    meta = spark.createDataFrame([("b", 3), ("c", 9)], "repo string, stars int")
    assert rows(D.cross_owner(pairs, "sha", "repo", meta, [F.desc("stars")])) == [("s1", "a", "c", 3), ("s1", "b", "c", 3)]


def test_upsert_keeps_first_values_but_for_updates(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    new = spark.createDataFrame([(2, "z", 5), (3, "c", 7)], "k int, name string, n int")
    assert rows(D.upserted(old, new, ["k"], ["n"])) == [(1, "a", 1, False), (2, "b", 5, False), (3, "c", 7, True)]


def test_coverage_and_partners(spark):
    spans = spark.createDataFrame([(1, 1, 3), (1, 3, 5), (2, 4, 2), (3, 1, 1)], "k int, a int, b int")
    points = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (1, 5)], "k int, p int")
    assert [r[-1] for r in rows(J.covered(spans, points, ["k"], "a", "b", "p"))] == [True, False, False, False]
    left = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "i int, c string")
    right = spark.createDataFrame([(None,), ("x",)], "d string")
    assert rows(J.with_partner(left, right, [("c", "d")], "hit")) == [(1, None, True), (2, "x", True), (3, "y", False)]


def test_enrich_and_reconcile(spark):
    left = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "k int, role string")
    right = spark.createDataFrame([(1, " ", "p"), (2, "java", "z")], "k int, lang string, seen string")
    assert rows(J.enrich(left, right, ["k"], {"lang": "python"})) == [(1, "p", "python"), (2, "p", "java"), (3, "q", "python")]
    assert [r[-1] for r in rows(J.reconcile(left, right, ["k"], "role", "seen"))] == ["ok", "mismatch", "missing"]


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, None)], "a int, b int")
    got = set(rows(closure(edges, "a", "b")))
    assert got == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} | {(4, 4)}


def test_python_workers_get_bounded_batches_and_send_rows_on(spark, monkeypatch):
    import pandas as pd

    def sizes(frames):
        yield pd.DataFrame([(len(f), int(f["t"].str.len().sum())) for f in frames], columns=["n", "size"])

    texts = spark.range(5000).select(F.repeat(F.lit("x"), 20_000).alias("t")).coalesce(1)
    got = texts.mapInPandas(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 5000 and max(r.n for r in got) <= 1000 and max(r.size for r in got) < 10 << 20
    diff = "+++ b/x\n@@ -0,0 +1,50 @@\n" + "\n".join(f"+{i}" for i in range(50))
    source = "import pytest\n" + "".join(f"@pytest.fixture\ndef f{i}(): Mock()\n" for i in range(50))
    diffs = spark.createDataFrame([("c", diff)], "commit string, diff string")
    files = spark.createDataFrame([(1, "python", source)], "file_id long, language string, source string")
    found = lambda: (rows(X.added_lines(diffs)), rows(X.fixtures(files)), rows(X.mocks(files)))
    whole = found()
    monkeypatch.setattr(X, "SENT_ROWS", 7)
    monkeypatch.setattr(X, "SENT_BYTES", 900)
    assert whole == found() and [len(x) for x in whole] == [50, 50, 50]


def test_test_doubles_are_counted_in_place_as_they_are_listed(spark):
    texts = ["", None, "@Mock A a; y = Mockito.spy(z); Mockito.mock(B.class)", "jest.fn() jest.fn()", "nothing", "jest.fn() jest.fn()"]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, source string").repartition(3)
    listed = dict(rows(X.mocks(files).groupBy("file_id").count()))
    counted = files.select("file_id", X.mock_counts("source").alias("n"))
    assert dict(rows(counted)) == {k: listed.get(k, 0) for k in range(len(texts))}
    # No row meets another: the only exchange is the one that dealt the files.
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_means_that_are_equal_tie_in_any_order_of_their_rows(spark):
    from quarryline.operators import reports as R

    data = [("a", "F", 0.1), ("a", "F", 0.2), ("a", "F", 0.3), ("b", "O", 0.3), ("b", "O", 0.2), ("b", "O", 0.1)]
    got = R.continuous_comparison(spark.createDataFrame(data, "u string, g string, v double").coalesce(1), "v", "g", "F", "O", unit="u").first()
    assert (got.statistic, got.effect) == ("U=0.0", "0.000")
    # What decimals can't hold has the mean of doubles; nulls have none.
    odd = spark.createDataFrame([("a", 1e300), ("a", 3e300), ("b", 1e-15), ("b", 3e-15), ("c", None), ("d", float("inf")), ("e", 1.5), ("e", None), ("f", 9e17), ("f", 9e17)], "u string, v double")
    assert rows(A.cluster_means(odd, "u", ["v"])) == [("a", 2e300), ("b", 2e-15), ("c", None), ("d", float("inf")), ("e", 1.5), ("f", 9e17)]


def test_water_filling_meets_the_target(spark):
    strata = spark.createDataFrame([("a", 5, 1.0), ("b", 100, 1.0), ("c", 20, 2.0)], "k string, cap int, w double")
    got = {r.k: r.quota for r in M.water_filling(strata, "cap", "w", "k", 60.0).collect()}
    assert got == {"a": 5.0, "b": 35.0, "c": 20.0}
    assert sum(r.quota for r in M.water_filling(strata, "cap", "w", "k", 1000.0).collect()) == 125


def test_water_filling_in_steps_of_the_level_as_the_sql(spark, duck, tmp_path):
    from conftest import same_rows

    from quarryline.plans import catalogue

    data = [(f"{name}{i}", name, 6000.0 if i < cap else 0.0) for name, cap, n in (("a", 1338, 2932), ("b", 1426, 3045), ("c", 1407, 2943)) for i in range(n)]
    one = spark.createDataFrame(data, "c_custkey string, c_mktsegment string, c_acctbal double")
    one.crossJoin(spark.range(20).select("id")).drop("id").write.parquet(f"{tmp_path}/customer.parquet")
    sql = catalogue.SQL["water_filling"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")
    same_rows(catalogue.QUERIES["water_filling"](spark, str(tmp_path)), duck, sql)
    strata = spark.createDataFrame([("a", 5, 1.0), ("b", 100, 1.0), ("c", 20, 2.0)], "k string, cap int, w double")
    filled = lambda target, levels: rows(M.water_filling(strata, "cap", "w", "k", target, levels).select("k", "quota"))
    assert filled(60.0, 10) == [("a", 5.0), ("b", 35.0), ("c", 20.0)]
    assert filled(60.5, 1) == [("a", 5.0), ("b", 35.0), ("c", 20.0)]
    assert filled(1000.0, 10) == [("a", 5.0), ("b", 100.0), ("c", 20.0)]
    assert filled(0.0, 10) == [("a", 0.0), ("b", 0.0), ("c", 0.0)]


def test_sample_sizes(spark):
    got = spark.createDataFrame([(0,), (10,), (1000,), (10**6,)], "n long").select(M.sample_size(F.col("n")).alias("s"))
    assert [r.s for r in got.collect()] == [0, 10, 278, 384]


def test_scalars(spark):
    df = spark.createDataFrame([(" 12.0 ", "TRUE", "Feat(x)!: y\nz"), ("", "0", "perf: a"), (None, None, "hello"), ("x", "1", None)], "n string, b string, m string")
    assert [tuple(r) for r in df.select(S.to_int("n"), S.flag("b"), S.commit_type("m")).collect()] == [(12, True, "feat"), (0, False, "other"), (0, False, None), (0, True, None)]
    commit = spark.createDataFrame(
        [("bot[bot]", "x@y", "Co-authored-by: Claude"), ("Ann", "a@b", "fix\n\nCo-Authored-By: Copilot <c@d>"), ("cursor", "me@home", "x"), ("Cursory", "e@f", "x")], "n string, e string, m string"
    )
    agents = [("claude", ["claude"]), ("copilot", ["copilot"]), ("cursor", ["cursor"])]
    assert [r[0] for r in commit.select(S.agent_of("n", "e", "m", agents, ["[bot]"], ["me@home"])).collect()] == [None, "copilot", None, None]
    paths = spark.createDataFrame([("tests/a.py",), ("src/test_b.py",), ("src/FooTest.java",), ("a/b.test.ts",), ("tests/data.json",), ("src/contest.py",)], "p string")
    assert [r[0] for r in paths.select(S.is_test_path("p")).collect()] == [True, True, True, True, False, False]


SNIPPETS = [
    (1, "python", "import pytest\n\n@pytest.fixture(scope='module')\ndef db():\n    # open it\n    c = Connection('x')\n    yield c\n    c.close()\n\n@pytest.fixture(scope='session')\ndef user(db):\n    return db.get(User())\n"),
    (2, "python", "import unittest\n\nclass T(unittest.TestCase):\n    def setUp(self):\n        for i in range(3):\n            if i:\n                self.x = Thing(i)\n    def tearDown(self):\n        pass\n"),
    (3, "java", "import org.junit.*;\npublic class ATest {\n  @Before\n  public void init() { if (a && b) { x = new Foo(); } }\n  @After\n  public void done() { }\n}\n"),
    (4, "javascript", "describe('a', () => {\n  beforeEach(async () => {\n    // fresh\n    await db.connect();\n  });\n  afterEach(function (done) { done(); });\n});\n"),
    (5, "python", "def broken(:\n"),
    (6, "python", None),
]


def test_extraction(spark):
    found = X.with_teardown(X.with_scopes(X.fixtures(spark.createDataFrame(SNIPPETS, "file_id long, language string, source string"))))
    got = {(r.file_id, r.name): r for r in found.collect()}
    assert set(got) == {(1, "db"), (1, "user"), (2, "setUp"), (2, "tearDown"), (3, "init"), (3, "done"), (4, "beforeEach"), (4, "afterEach")}
    assert got[1, "db"].scope == "module" and got[1, "db"].has_teardown_pair and got[1, "db"].num_comment_lines == 1
    assert got[1, "user"].scope == "module"  # it can't outlive what it depends on
    assert got[2, "setUp"].cyclomatic_complexity == 3 and got[2, "setUp"].has_teardown_pair
    assert got[3, "init"].cyclomatic_complexity == 3 and got[3, "init"].container == "ATest"
    assert got[4, "beforeEach"].has_teardown_pair and got[4, "beforeEach"].container == "a"
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+b\n c\n"
    assert rows(X.added_lines(spark.createDataFrame([("c1", diff), ("c2", None)], "commit string, diff string"))) == [("c1", "x.py", 2)]
    mocks = X.mocks(spark.createDataFrame([(1, "@patch('a.b')\ndef t(m):\n    m.return_value = Mock()\n"), (2, None)], "file_id long, source string"))
    assert {(r.framework, r.target, r.interactions) for r in mocks.collect()} == {("unittest_mock", "a.b", 1), ("unittest_mock", "", 0)}


def test_sources(spark, tmp_path):
    (tmp_path / "python.csv").write_text('name,text\na/b,"x\ny ""z"""\nc/d,\n')
    got = IO.language_from_name(IO.read_csv(spark, str(tmp_path / "python.csv")))
    assert rows(got) == [("a/b", 'x\ny "z"', "python"), ("c/d", None, "python")]
    with gzip.open(tmp_path / "java.csv.gz", "wt") as f:
        f.write("name\ne/f\n")
    assert rows(IO.read_names(spark, str(tmp_path / "java.csv.gz"))) == [("e/f",)]
    for k, body in enumerate((["a/b", {"name": "c/d"}], {"items": [{"repository": "e/f"}]})):
        (tmp_path / f"{k}.json").write_text(json.dumps(body))
    assert rows(IO.read_names(spark, str(tmp_path / "0.json"))) == [("a/b",), ("c/d",)]
    assert rows(IO.read_names(spark, str(tmp_path / "1.json"))) == [("e/f",)]
    (tmp_path / "l.txt").write_text("# none\n x/y \n\n")
    assert rows(IO.read_names(spark, str(tmp_path / "l.txt"))) == [("x/y",)]
    assert IO.preferred(["r/a.json", "r/a.csv.gz", "r/b.txt"]) == ["r/a.csv.gz", "r/b.txt"]
    assert rows(IO.read_or_empty(spark, str(tmp_path / "nothing"), "a int")) == []


def test_guarded_append_and_package(spark, tmp_path):
    table = str(tmp_path / "t")
    IO.append(spark.createDataFrame([(1, "a")], "k int, v string"), table)
    IO.append(spark.createDataFrame([("b", 2)], "v string, k int"), table)
    assert rows(spark.read.parquet(table).select("k", "v")) == [(1, "a"), (2, "b")]
    with pytest.raises(IO.SchemaDrift):
        IO.append(spark.createDataFrame([(1,)], "k int"), table)
    IO.write_csv(spark.createDataFrame([(1, None)], "k int, v string"), str(tmp_path / "c"), ["v", "k", "w"])
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True).select("k")) == [("1",)]
    IO.package({"a.csv": b"k,v\n1,2\n"}, str(tmp_path / "p.zip"))
    assert IO.package_problems(str(tmp_path / "p.zip"), {"a.csv": ["k", "w"], "b.csv": []}) == ["missing b.csv", "a.csv has no column w"]
    assert "| 1 | -- |" in IO.markdown_table(spark.createDataFrame([(1, None)], "k int, v string"))


def test_stream_upserts_and_deduplicates(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, n int, ts timestamp"
    for part in ([(1, 1)], [(1, 5), (2, 2)], [(2, 9)]):
        spark.createDataFrame(part, "k int, n int").withColumn("ts", F.expr("timestamp '2024-01-01'")).coalesce(1).write.mode("append").parquet(source)
        E.upsert_into(E.read_stream(spark, source, schema), table, ["k"], ["n"], str(tmp_path / "state")).awaitTermination()
    assert rows(E.read_upserted(spark, table).select("k", "n")) == [(1, 5), (2, 9)]
    assert rows(E.read_upserted(spark, table, before=1).select("k", "n")) == [(1, 1)]
    unique = E.deduplicated(E.read_stream(spark, source, schema), "ts", "k", "1 hour")
    job = unique.writeStream.format("memory").queryName("unique_keys").option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
    job.awaitTermination()
    assert sorted(r.k for r in spark.table("unique_keys").collect()) == [1, 2]


def test_import_direction():
    """Nothing in the library but its optional part imports that part."""
    from pathlib import Path

    root = Path(IO.__file__).resolve().parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "quarryline.llm" in p.read_text()]


def test_gates_and_counts(spark):
    from quarryline.operators import workflow as V

    rows_in = spark.createDataFrame([(1, 200, 10), (2, 50, 10), (3, 200, None)], "k int, commits int, files int")
    gate = V.gated(rows_in, {"commits": 100, "files": 5})
    assert [r.skip_reason for r in gate.orderBy("k").collect()] == [None, "low_commits", "low_files"]
    assert rows(V.reason_counts(gate, ["passed", "low_loc"]), "place", "reason") == [("passed", 1, 0), ("low_loc", 0, 1), ("low_commits", 1, 2), ("low_files", 1, 2)]
    pure = V.purity(spark.createDataFrame([("x", 3, 0), ("x", 0, 2), (" ", None, None)], "b string, a int, r int"), "a", "r", "b")
    assert rows(pure) == [("(not set)", 1, 0, 0, 0, 0, None), ("x", 2, 3, 2, 1, 1, 40.0)]


def test_discovery_expands_until_enough_survive(spark):
    from quarryline.operators import workflow as V

    looked = []

    def check(df):
        looked.append(df.count())
        return df.filter("id % 10 = 9")

    got = V.expanded(spark.range(1000), [F.col("id")], check, 5, 4, rounds=5)
    assert [r.id for r in got.orderBy("id").collect()] == [9, 19, 29, 39, 49]
    assert looked[:2] == [4, 4] and sum(looked) <= 200


def test_nested_tables(spark):
    from quarryline.operators import workflow as V

    nested = spark.createDataFrame([(1, [(5,), (6,)]), (2, []), (3, None)], "k int, xs array<struct<v:int>>")
    parents, children = V.nested_to_tables(nested, "k", "xs")
    assert rows(parents) == [(1, 2), (2, 0), (3, 0)]
    assert rows(children) == [(1, 0, 5), (1, 1, 6)]


def test_priority_classifier_reads_every_row(spark, tmp_path):
    """Text with letters beyond ASCII is classified, and such letters are part of a word."""
    from quarryline.plans.catalogue import QUERIES

    texts = ["Räder für alle", "die Straße", "Wörter und das", "that's naïve", "é the", "Bäder, der Fluß", "thé", "le café", "Generated-By: ü der", "die"]
    data = [(k, 0, "user", t) for k, t in enumerate(texts)] + [(50, 1, "system", "die Größe")]
    spark.createDataFrame(data, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for k, turn, role, t in data:
        name = next((n for n, p in (("english", r"\b(the|that)\b"), ("german", r"\b(der|die)\b")) if re.search(p, t, re.I)), None)
        want.append((k, turn, None if role == "system" else name))
    assert rows(QUERIES["priority_classifier"](spark, str(tmp_path))) == want


def test_tables_of_a_scope_go_at_its_end(spark):
    import os
    from urllib.parse import urlparse

    from quarryline.session import scope, stored

    place = lambda df: os.path.dirname(urlparse(df.inputFiles()[0]).path)
    with scope(spark):
        with scope(spark):
            inner, kept = place(stored(spark.range(3), "inner")), place(stored(spark.range(3), "kept", kept=True))
        assert not os.path.exists(inner) and os.path.exists(kept)
    assert not os.path.exists(kept)
    outside = place(stored(spark.range(3), "outside", kept=True))
    assert os.path.exists(outside)


def test_shares_of_many_categories(spark, monkeypatch):
    from quarryline.operators import aggregate

    rows = spark.createDataFrame([(u, f"k{(u * 7 + i) % 90}") for u in range(20) for i in range(5)] + [(1, None)], "unit int, kind string")
    want = sorted(map(tuple, aggregate.cluster_proportions(rows, "unit", "kind").collect()))
    monkeypatch.setattr(aggregate, "KINDS", 7)
    assert sorted(map(tuple, aggregate.cluster_proportions(rows, "unit", "kind").collect())) == want
    assert len(want) == 20 * len({k for _, k, _ in want})


def test_dips_of_uniform_samples_have_even_probabilities(spark):
    """At sizes of the table, between them and beyond: a twentieth of the samples is below 0.05, half below 0.5."""
    table = stats.null_table(spark, 500, 7)
    assert (np.diff(table, axis=1) >= 0).all()
    rng = np.random.default_rng(4)
    for n, tries in ((6, 400), (40, 400), (250, 200), (5000, 60)):
        p = np.array([stats.dip_p(table, n, stats.dip(rng.random(n))) for _ in range(tries)])
        assert abs((p <= 0.5).mean() - 0.5) < 4 * 0.5 / np.sqrt(tries) + 0.02
        assert (p <= 0.05).mean() < 0.05 + 4 * np.sqrt(0.05 / tries) + 0.01
