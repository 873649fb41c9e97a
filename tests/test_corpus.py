"""Commits, reviews, reports and stores on small cases that can be worked out by hand."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import aggregate as A
from quarryline.operators import commits as C
from quarryline.operators import extract as X
from quarryline.operators import reports as R
from quarryline.operators import validation as V
from quarryline.operators.graph import least_over_closure
from quarryline.sources import stores as K


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE repos (id INTEGER, name TEXT, stars REAL)")
        c.executemany("INSERT INTO repos VALUES (?, ?, ?)", [(i, None if i == 3 else f"r{i}", i / 2) for i in range(20)])
        c.execute("CREATE TABLE empty (id INTEGER)")
    got = K.read_sqlite(spark, path, "repos", partitions=3)
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("stars", "double")]
    assert rows(got) == [(i, None if i == 3 else f"r{i}", i / 2) for i in range(20)]
    assert rows(K.read_sqlite(spark, path, "empty")) == []
    assert K.read_sqlite_or_none(spark, str(tmp_path / "none.db"), "repos") is None


def test_updates_and_growth(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "k int, s string, n int")
    new = spark.createDataFrame([(1, None, 7), (2, "c", None), (9, "z", 1)], "k int, s string, n int")
    assert rows(K.updated(old, new, ["k"])) == [(1, "a", 7), (2, "c", None)]
    assert K.grown(K.grown(old, {"x": "double"}), {"x": "double"}).dtypes[-1] == ("x", "double")


def test_progress_and_stages(spark, tmp_path):
    p = K.Progress(spark, str(tmp_path / "p"))
    ran = []
    assert p.unless_done("load", lambda: ran.append(1)) and not p.unless_done("load", lambda: ran.append(2))
    assert p.unless_done("load", lambda: ran.append(3), force=True) and ran == [1, 3]
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit string")
    p.mark(units.filter("unit <> 'c'"), "scan")
    p.mark(units.filter("unit <> 'c'"), "scan")
    assert rows(p.pending(units, "scan")) == [("c",)] and p.is_done("scan", "a") and not p.is_done("scan", "c")
    stages = K.Stages(str(tmp_path / "run"))
    assert stages.before("search") is None and stages.before("export").endswith("04-fixtures")
    assert stages.source(spark, "export") is None
    units.write.parquet(stages.folder("quality"))
    assert rows(stages.source(spark, "export")) == [("a",), ("b",), ("c",)]
    for name in ("s_2024.csv", "s_2025.csv", "t.csv"):
        (tmp_path / name).write_text("x")
    assert K.latest_file(str(tmp_path), "s_*.csv").endswith("s_2025.csv") and K.latest_file(str(tmp_path), "q*") is None


def test_parameters_and_rules(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"min_commits": 7, "languages": ["java"]}))
    assert K.Parameters.load(str(tmp_path / "p.json")) == K.Parameters(min_commits=7, languages=("java",))
    (tmp_path / "q.json").write_text(json.dumps({"min_comits": 7}))
    with pytest.raises(ValueError, match="min_comits"):
        K.Parameters.load(str(tmp_path / "q.json"))
    (tmp_path / "r.csv").write_text("# rules\nframework,pattern\njest,jest\\.fn\n# end\n")
    rules = K.load_rules(str(tmp_path / "r.csv"), ["framework", "pattern"])
    found = X.mocks(spark.createDataFrame([(1, "x = jest.fn()")], "file_id long, source string"), [(r["framework"], r["pattern"]) for r in rules])
    assert [(r.framework, r.at) for r in found.collect()] == [("jest", 4)]
    (tmp_path / "s.csv").write_text("framework,pattern\njest,\n")
    with pytest.raises(ValueError, match="rule 1"):
        K.load_rules(str(tmp_path / "s.csv"), ["framework", "pattern"])
    (tmp_path / "repos.csv").write_text("full_name,language,stars\na/b, Python ,12.0\nnoslash,java,1\n")
    assert rows(K.load_repos(spark, str(tmp_path / "repos.csv"))) == [("a/b", "python", 12, "https://github.com/a/b.git")]


def test_tables_by_language_and_commits(spark, tmp_path):
    commits = spark.createDataFrame([("a/b", "1", "java"), ("a/b", "1", "java"), ("c/d", "2", "python")], "repo string, sha string, language string")
    for _ in range(2):
        assert K.append_commits(commits, str(tmp_path / "c"), str(tmp_path / "state.json")) == {"java": 1, "python": 1}
    assert json.loads((tmp_path / "state.json").read_text()) == {"commits": {"java": 1, "python": 1}}
    K.write_by_language(commits, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w/by_language/language=java"), header=True).count() == 2
    assert spark.read.csv(str(tmp_path / "w/all"), header=True).count() == 3
    K.truncated(spark, {str(tmp_path / "w/all"): ["repo", "sha"]})
    assert spark.read.csv(str(tmp_path / "w/all"), header=True).count() == 0
    K.create_tables(spark, str(tmp_path / "db"), {"repos": "id long"})
    K.create_tables(spark, str(tmp_path / "db"), {"repos": "id long"})
    assert rows(K.table_counts({"repos": spark.read.parquet(str(tmp_path / "db/repos"))})) == [("repos", 0)]


def test_trees(spark, tmp_path):
    for name in ("src/test_a.py", "node_modules/x/b.test.js", "tests/c.py", "d.md"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text("def test_x(): pass\n")
    tree = K.read_tree(spark, str(tmp_path / "t"))
    assert [r[0] for r in rows(C.pruned(tree).select("path"))] == ["d.md", "src/test_a.py", "tests/c.py"]
    assert rows(C.test_files_in(C.pruned(tree).withColumn("repo", F.lit("r")), "python")) == [("r", "src/test_a.py", "python"), ("r", "tests/c.py", "python")]


DIFF = "--- /dev/null\n+++ b/tests/test_a.py\n@@ -0,0 +1,5 @@\n+import pytest\n+@pytest.fixture\n+def a():\n+    m = mock.patch('x.y')\n+    return m\n"
SOURCE = "import pytest\n@pytest.fixture\ndef a():\n    m = mock.patch('x.y')\n    return m\n"


def test_fixtures_of_commits(spark):
    schema = "repo string, sha string, path string, change_type string, deleted_lines int, diff string, source string"
    changes = [
        ("r/a", "1", "tests/test_a.py", "add", 0, DIFF, SOURCE),
        ("r/a", "2", "tests/test_a.py", "modify", 0, "--- a/x\n+++ b/tests/test_a.py\n@@ -3,1 +3,2 @@\n def a():\n+    m = mock.patch('x.y')\n", SOURCE),
        ("r/a", "3", "tests/test_a.py", "modify", 2, DIFF, SOURCE),
        ("r/a", "3", "src/a.py", "modify", 9, None, None),
        ("r/b", "4", "src/a.py", "add", 0, DIFF, SOURCE),
        ("r/b", "5", "tests/test_n.py", "add", 0, None, None),
    ]
    got = C.commit_fixtures(spark.createDataFrame(changes, schema))
    assert rows(got.select("repo", "sha", "name", "num_mocks", "is_complete_addition")) == [("r/a", "1", "a", 1, True), ("r/a", "2", "a", 1, False)]
    assert got.filter("sha = '1'").first()["github_url"] == "https://github.com/r/a/blob/1/tests/test_a.py#L2-L5"
    snapshot = C.snapshot_fixtures(spark.createDataFrame([("r/a", "h", "tests/test_a.py", SOURCE), ("r/a", "h", "vendor/test_b.py", SOURCE)], "repo string, sha string, path string, source string"))
    assert rows(snapshot.select("path", "name", "start_line", "end_line")) == [("tests/test_a.py", "a", 2, 5)]


def test_coverage_by_lines_with_code(spark):
    source = "def a():\n    # old\n\n    x = 1\n"
    files = spark.createDataFrame([(1, "python", source), (2, "javascript", "f(); // a\n/* b\n c */\nvar s = '// no';\n")], "file_id long, language string, source string")
    assert rows(C.named_lines(files)) == [(1, 1), (1, 4), (2, 1), (2, 4)]
    spans = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (1, 2, 3), (1, 3, 1)], "file_id long, start_line int, end_line int")
    added = spark.createDataFrame([(1, 4)], "file_id long, point int")
    assert rows(C.covered_by_code(spans, added, files)) == [(1, 1, 4, False), (1, 2, 3, False), (1, 2, 4, True), (1, 3, 1, False)]


def test_scanner_of_brace_languages():
    source = "const r = /[\"'`{]/g; s = `a ${ f({x: `n ${1}`}) } b { `; // {\nbeforeEach(() => { if (a / b / c) { x = \"}\"; y.map(z => { if (z) { w() } }); } });"
    code = X.blanked(source)
    assert len(code) == len(source) and code.count("{") == code.count("}")
    assert "f({x:" in code and "a ${" not in code
    found = list(X.javascript_fixtures(source))
    assert [(f.name, f.cyclomatic_complexity, f.start_line, f.end_line) for f in found] == [("beforeEach", 3, 2, 2)]
    assert X.outer_complexity(found[0].raw_source, "javascript") == 2
    assert X.outer_complexity("beforeEach(setup);", "typescript") is None
    for broken in ("`${", "`a ${ `b ${ ", "/* x", "'", '"""', "a = /[", "}}}"):
        assert len(X.blanked(broken)) == len(broken)


def test_deep_expressions_are_parsed_or_left_alone(spark):
    deep = "x = " + " + ".join(["1"] * 1500) + "\n\ndef setUp(self):\n    pass\n"
    nested = "def setUp(self):\n    return " + "(" * 150 + "1" + ")" * 150 + "\n"
    broken = "x = " + "(" * 5000
    files = spark.createDataFrame([(1, "python", deep), (2, "python", nested), (3, "python", broken)], "file_id long, language string, source string")
    assert {r.file_id for r in X.fixtures(files).collect()} <= {1, 2}
    assert 1 in {r.file_id for r in X.fixtures(files).collect()}


def test_test_functions_are_counted():
    assert X.test_functions("def test_a(): pass\nclass T:\n    async def test_b(self): pass\n    def helper(self): pass\n", "python") == 2
    assert X.test_functions("class A extends TestCase { public void testX() {} @Test public void foo() throws E { } // @Test void no() {}\n}", "java") == 2
    assert X.test_functions("it('a', f); test.only('b', f); xit('c'); obj.it('d'); // it('e')\n", "typescript") == 2
    assert X.test_functions("def broken(:", "python") == 0 and X.test_functions("x", "go") == 0


def test_cells_and_reports(spark):
    data = [(g, s, float(v)) for g, s, base in (("a", "x", 0), ("b", "x", 5), ("a", "y", 1), ("b", "y", 1)) for v in range(base, base + 12)] + [("a", "z", 1.0)]
    table = R.continuous_comparison(spark.createDataFrame(data, "g string, s string, v double"), "v", "g", "a", "b", "s")
    got = rows(table, "place", "label")
    assert [r[1] for r in got] == ["Overall", "x", "y", "z"]
    assert got[3][4:] == ("--", "--", "--", "insufficient data", "--")
    assert got[0][8] == "--" and got[1][4].startswith("U=") and got[1][6] == "large"
    text = R.report("Study", [("Values", "Two groups.", table.orderBy("place", "label"))])
    assert text.startswith("# Study\n\n## Values\n\nTwo groups.\n\n| place |") and "insufficient data" in text
    few = R.paired_balance(spark.createDataFrame([("a", "p")] * 3 + [("b", "q")] * 9, "g string, c string"), "c", "g", "a", "b")
    assert rows(few) == [(3, 9, None, None, None, "insufficient_data")]
    has = R.presence_comparison(spark.createDataFrame([(g, s, u, (u + k) % 3) for g in "ab" for s in "xy" for u in range(6) for k in range(4)], "g string, s string, u int, n int"), F.col("n") > 0, "u", "g", "a", "b", "s")
    assert [r[1] for r in rows(has, "place", "label")] == ["Overall", "x", "y"]


def test_reviews(spark, tmp_path):
    commits = spark.createDataFrame([("a/b", "1", "claude", None), ("a/b", None, None, "http://u")], "repo_name string, commit_sha string, agent_type string, commit_url string")
    got = rows(V.normalised(commits, "commit"))
    assert sorted(r[4] for r in got) == ["http://u", "https://github.com/a/b/commit/1"]
    repos = spark.createDataFrame([("a/b", "1", " "), ("c/d", "0", "x")], "repo_name string, has_agent_config string, matched_config_file string")
    assert [r[5] for r in rows(V.normalised(repos, "repo"))] == ["agent_config_present"]
    for kind in V.NORMALISERS:
        assert V.normalised(commits.withColumn("has_agent_config", F.lit("1")), kind).columns == list(V.CANONICAL)
    files = {name: spark.createDataFrame([(f"{name}/{i}", str(i), "x" if i % 3 else "y") for i in range(n)], "repo_name string, commit_sha string, language string") for name, n in (("p", 700), ("q", 40))}
    whole = V.run_validation("step", "commit", files, ["language"], 1, str(tmp_path))
    assert whole.count() == 254 and json.loads((tmp_path / "step.json").read_text())["population"] == 740
    each = V.run_validation("step", "commit", files, ["language"], 1, combined=False)
    assert {r.source_file: r.n for r in each.groupBy("source_file").agg(F.count("*").alias("n")).collect()} == {"p": 249, "q": 37}
    ids = sorted(r.validation_id for r in each.collect())
    assert ids[0] == "step-0001" and ids[-1] == "step-0286" and len(set(ids)) == 286
    assert V.validation_sample(files["p"].limit(0), ["language"], 1).collect() == []


def test_sample_plans(spark, tmp_path):
    units = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 4) for i in range(60)], "u int, s string, n int")
    plan = V.sample_plan(units, "u", "n", "s", 40, None, 3, str(tmp_path / "plan.json"))
    assert abs(sum(r.n for r in plan.collect()) - 40) <= 4
    assert json.loads((tmp_path / "plan.json").read_text())["target"] == 40
    match = spark.createDataFrame([("a", 10)], "s string, n long")
    assert {r.s for r in V.sample_plan(units, "u", "n", "s", None, match, 3).collect()} == {"a"}
    with pytest.raises(ValueError):
        V.sample_plan(units, "u", "n", "s", 40, match, 3)


def test_quantiles_of_groups(spark):
    data = [("a", float(v)) for v in (5, 1, 3, 3)] + [("b", 7.0), ("c", None), (None, 2.0), (None, 4.0)]
    got = {r.g: (r.m, r.q) for r in A.quantiles(spark.createDataFrame(data, "g string, v double"), "v", ["g"], {"m": 0.5, "q": 0.25}).collect()}
    assert got == {"a": (3.0, 2.5), "b": (7.0, 7.0), None: (3.0, 2.5)}
    assert A.quantiles(spark.createDataFrame(data, "g string, v double"), "v", [], {"m": 1.0}).first()["m"] == 7.0


def test_levels_fall_along_chains_and_circles(spark):
    nodes = spark.createDataFrame([(1, 5), (2, 4), (3, 1), (4, 9), (5, 3), (6, None)], "k int, level int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 1), (4, None)], "a int, b int")
    got = {r.k: r.effective for r in least_over_closure(nodes, edges, "k", "level", "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 3, 5: 3, 6: 1}


def test_filters(spark):
    df = spark.createDataFrame([("2020-01-05T00:00", "Python"), (" ", "java"), (None, "go"), ("2022-01-01", "python ")], "d string, l string")
    assert [r[0] for r in df.select(S.until_or_blank("d", "2020-12-31")).collect()] == [True, True, True, False]
    assert [r[0] for r in df.select(S.is_language("l", S.language_names(["PYTHON", " "]))).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(S.language_display("l")).collect()][:3] == ["Python", "Java", "Go"]
    assert spark.range(1).select(S.json_list(F.lit('["a","b"]')), S.json_list(F.lit("x"))).first()[0] == ["a", "b"]


def test_a_batch_that_runs_again_leaves_the_same_table(spark, tmp_path):
    from quarryline.streaming import events as E

    source, table, schema = str(tmp_path / "in"), str(tmp_path / "out"), "k int, n int"
    spark.createDataFrame([(1, 5), (1, 9), (1, 2), (2, 1)], schema).repartition(4).write.parquet(source)
    for state in ("s1", "s2"):
        E.upsert_into(E.read_stream(spark, source, schema), table, ["k"], ["n"], str(tmp_path / state), ["n"]).awaitTermination()
        assert rows(E.read_upserted(spark, table)) == [(1, 9), (2, 1)]
    assert E.read_upserted(spark, str(tmp_path / "none")) is None
