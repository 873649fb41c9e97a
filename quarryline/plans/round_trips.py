"""Queries that write rows with each sink and read them with each source, and on values as text, each with its SQL."""

from __future__ import annotations

import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import commits as C
from quarryline.operators import extract as X
from quarryline.operators import reports as R
from quarryline.operators import syntax
from quarryline.operators import validation as V
from quarryline.plans.code import _calls_sql, sources
from quarryline.plans.registry import query
from quarryline.session import shared_dir, stored
from quarryline.session import table as T
from quarryline.sources import files as K
from quarryline.sources import stores as L


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}"


def _local(spark: SparkSession, root: str) -> Path:
    """``root`` as a folder of files, for the small files that the driver writes."""
    place = urlparse(root)
    if place.scheme not in ("", "file"):
        raise ValueError("small files need a folder that all machines see as files")
    path = Path(place.path)
    path.mkdir(parents=True, exist_ok=True)
    return path


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, '' AS missing, translate(coalesce(text, ''), chr(13), ' ') AS body FROM documents")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All texts as CSV with fixed columns, line breaks and quotes inside; what is missing is an empty text."""
    root = _root(spark)
    docs = T(spark, d, "documents").select("doc_id", "lang", F.translate("text", "\r", " ").alias("body"))
    K.write_csv(docs, root, ["doc_id", "lang", "missing", "body"])
    return K.read_csv(spark, root).fillna("")


@query("SELECT coalesce(lang, 'und') AS language, count(*) AS rows, count(*) AS all_rows FROM documents GROUP BY ALL")
def rows_by_language(spark: SparkSession, d: str) -> DataFrame:
    """A folder for each language and all rows together, read back from both."""
    root = _root(spark)
    L.write_by_language(T(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("language"), "source"), root)
    parts = K.read_csv(spark, f"{root}/by_language").groupBy("language").agg(F.count("*").alias("rows"))
    return parts.join(K.read_csv(spark, f"{root}/all").groupBy("language").agg(F.count("*").alias("all_rows")), "language")


@query("SELECT coalesce(lang, 'und') AS language, doc_id::VARCHAR AS doc_id FROM documents")
def language_files(spark: SparkSession, d: str) -> DataFrame:
    """One gzip file for each language, named after it; the language comes from the file's name again."""
    root = _root(spark)
    docs = stored(T(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang")), "languages")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path(f"{root}/named"))
    for (language,) in docs.select("lang").distinct().collect():
        docs.filter(F.col("lang") == language).select("doc_id").write.options(header=True, compression="gzip").csv(f"{root}/{language}")
        for k, status in enumerate(s for s in store.listStatus(path(f"{root}/{language}")) if s.getPath().getName().startswith("part-")):
            store.rename(status.getPath(), path(f"{root}/named/{language}-{k}.csv.gz"))
    return K.language_from_name(K.read_csv(spark, f"{root}/named")).select("language", "doc_id")


@query("""SELECT 'csv' AS form, c_name AS name FROM customer UNION ALL SELECT 'txt', c_name FROM customer
UNION ALL SELECT 'json', c_name FROM customer UNION ALL SELECT 'preferred', c_name FROM customer""")
def name_lists(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names as a CSV column, as lines with a remark, and as JSON; of files that differ in their ending CSV is taken."""
    root = _root(spark)
    names = T(spark, d, "customer").select(F.col("c_name").alias("name"))
    names.write.options(header=True).csv(f"{root}/names.csv")
    spark.range(1).select(F.lit("# a remark").alias("name")).unionByName(names.select(F.concat(F.lit("  "), "name").alias("name"))).write.text(f"{root}/names.txt")
    # Each partition is a file, and each file an array.
    numbered = names.withColumn("part", F.spark_partition_id())
    numbered.groupBy("part").agg(F.to_json(F.collect_list(F.struct("name"))).alias("value")).repartition("part").select("value").write.text(f"{root}/names.json")
    chosen = K.preferred([f"{root}/names.txt", f"{root}/names.csv", f"{root}/names.json"])
    forms = {"csv": f"{root}/names.csv", "txt": f"{root}/names.txt", "json": f"{root}/names.json", "preferred": chosen[0]}
    out = None
    for form, path in forms.items():
        one = K.read_names(spark, path).select(F.lit(form).alias("form"), "name")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_type AS kind, count(*) AS n, true AS drift_seen FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events) GROUP BY ALL")
def guarded_append(spark: SparkSession, d: str) -> DataFrame:
    """Events appended twice; rows with another column are refused before anything is written."""
    root = _root(spark)
    events = T(spark, d, "events").select("event_type", "user_id")
    K.append(events, root)
    K.append(events.select("user_id", "event_type"), root)
    try:
        K.append(events.withColumn("other", F.lit(1)), root)
        drift = False
    except K.SchemaDrift:
        drift = True
    return spark.read.parquet(root).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("drift_seen", F.lit(drift))


@query("SELECT (SELECT count(*) FROM orders) AS there, 0 AS missing, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS has_open, false AS has_none")
def optional_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source that is there, and one that isn't; whether they have rows of a kind."""
    root = _root(spark)
    T(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.parquet(f"{root}/orders")
    there, missing = (K.read_or_empty(spark, f"{root}/{name}", "o_orderkey long, o_orderstatus string") for name in ("orders", "nothing"))
    counts = there.agg(F.count("*").alias("there")).crossJoin(F.broadcast(missing.agg(F.count("*").alias("missing"))))
    return counts.withColumn("has_open", F.lit(K.has_rows(there, "o_orderstatus = 'P'"))).withColumn("has_none", F.lit(K.has_rows(missing)))


@query("SELECT o_orderstatus AS language, count(*) AS n, count(*) AS in_state FROM orders GROUP BY ALL")
def commit_appends(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits, appended twice by language: what is there stays, and the state tells the counts."""
    root = _root(spark)
    state = _local(spark, root) / "state.json"
    commits = T(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("repo"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderstatus").alias("language"))
    L.append_commits(commits.filter("language != 'P'"), f"{root}/commits", str(state))
    counts = L.append_commits(commits, f"{root}/commits", str(state))
    told = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    return spark.read.parquet(f"{root}/commits").groupBy("language").agg(F.count("*").alias("n")).withColumn("in_state", told[F.col("language")].cast("long"))


@query("SELECT lang AS language, count(*) AS n, true AS first, false AS again, true AS forced FROM documents WHERE lang IS NOT NULL GROUP BY ALL")
def staged_run(spark: SparkSession, d: str) -> DataFrame:
    """A stage that runs once, is left out when it is done, and runs again by force; the next stage finds its table."""
    root = _root(spark)
    stages, progress = L.Stages(root), L.Progress(spark, f"{root}/progress")

    def search() -> None:
        T(spark, d, "documents").filter("lang is not null").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(stages.folder("search"))

    ran = [progress.unless_done("search", search), progress.unless_done("search", search), progress.unless_done("search", search, force=True)]
    found = stages.source(spark, "commits")
    for name, value in zip(("first", "again", "forced"), ran, strict=True):
        found = found.withColumn(name, F.lit(value))
    return found


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_mktsegment LIKE '%BUILDING%' THEN 'houses' ELSE 'other' END AS class FROM customer
WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) >= 12""")
def rules_and_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Customers with as many orders as a parameter file says, classified by the first rule of a rule table that holds."""
    folder = _local(spark, _root(spark))
    (folder / "rules.csv").write_text("# the first rule that holds counts\nname,condition\ndebt,c_acctbal < 0\n\nhouses,\"c_mktsegment LIKE '%BUILDING%'\"\n", encoding="utf-8")
    (folder / "study.yaml").write_text("min_commits: 12\nlanguages: [java]\n", encoding="utf-8")
    rules, study = L.load_rules(str(folder / "rules.csv"), ["name", "condition"]), L.Parameters.load(str(folder / "study.yaml"))
    orders = T(spark, d, "orders").groupBy("o_custkey").count().filter(F.col("count") >= study.min_commits)
    label = F.coalesce(*(F.when(F.expr(r["condition"]), r["name"]) for r in rules), F.lit("other"))
    return T(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", label.alias("class"))


@query("""SELECT 'org/' || c_custkey AS repo_name, lower(c_mktsegment) AS language, trunc(greatest(c_acctbal, 0))::BIGINT AS stars,
  CASE WHEN c_custkey % 3 = 0 THEN 'ssh://' || c_custkey ELSE 'https://github.com/org/' || c_custkey || '.git' END AS clone_url FROM customer WHERE c_custkey % 7 > 0""")
def repository_list(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a list of repositories: names in either column or in none, stars as texts, addresses that may be missing."""
    root = _root(spark)
    key = F.col("c_custkey")
    name = F.concat(F.lit(" org/"), key)
    rows = T(spark, d, "customer").select(
        F.when((key % 2 == 0) & (key % 7 > 0), name).otherwise(" ").alias("repo_name"), F.when(key % 7 == 0, "nameless").otherwise(name).alias("full_name"), F.col("c_mktsegment").alias("language"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("none").alias("stars"), F.when(key % 3 == 0, F.concat(F.lit("ssh://"), key)).alias("clone_url"), "c_name",
    )
    rows.write.options(header=True, escape='"').csv(root)
    return L.load_repos(spark, root)


@query("""SELECT p_partkey, coalesce(trunc(try_cast(x AS DOUBLE))::BIGINT, 0) AS n, p_size % 2 = 1 AS is_odd, CASE p_size WHEN 0 THEN 0.0 ELSE p_retailprice / p_size END AS per_size,
  CASE p_partkey % 3 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'Python' ELSE 'Cobol' END AS shown FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE ' ' || p_retailprice || ' ' END AS x FROM part)""")
def values_as_text(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, flags and names that come as texts, and a ratio without a whole."""
    key = F.col("p_partkey")
    parts = T(spark, d, "part").withColumn("x", F.when(key % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" "))))
    odd = F.when(F.col("p_size") % 2 == 0, "no").when(key % 2 == 0, "TRUE").otherwise("1")
    name = F.when(key % 3 == 0, "javascript").when(key % 3 == 1, "PYTHON").otherwise("cobol")
    return parts.select("p_partkey", S.to_int("x").alias("n"), S.flag(odd).alias("is_odd"), S.density("p_retailprice", "p_size").alias("per_size"), S.language_display(name).alias("shown"))


@query("SELECT (SELECT count(*) FROM supplier) AS before, 0 AS after, 's_suppkey,s_name' AS header")
def truncated_outputs(spark: SparkSession, d: str) -> DataFrame:
    """A CSV table with rows of an older run keeps its header alone."""
    root = _root(spark)
    rows = T(spark, d, "supplier").select("s_suppkey", "s_name")
    K.write_csv(rows, root, rows.columns)
    before = K.read_csv(spark, root).count()
    L.truncated(spark, {root: rows.columns})
    empty = K.read_csv(spark, root)
    return empty.agg(F.count("*").alias("after")).select(F.lit(before).cast("long").alias("before"), "after", F.lit(",".join(empty.columns)).alias("header"))


@query("SELECT 'nation.csv has no column n_region' AS problem, (SELECT count(*) FROM nation) AS rows UNION ALL SELECT 'missing region.csv', (SELECT count(*) FROM nation)")
def package_problems(spark: SparkSession, d: str) -> DataFrame:
    """A package of a small table and its summary, and what it lacks of what is asked for."""
    folder = _local(spark, _root(spark))
    rows = T(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    K.write_summary({"rows": len(rows)}, str(folder / "summary.json"))
    table = "n_nationkey,n_name\n" + "".join(f"{r.n_nationkey},{r.n_name}\n" for r in rows)
    K.package({"nation.csv": table.encode(), "summary.json": (folder / "summary.json").read_bytes()}, str(folder / "all.zip"))
    found = K.package_problems(str(folder / "all.zip"), {"nation.csv": ["n_name", "n_region"], "region.csv": ["r_name"], "summary.json": []})
    return spark.createDataFrame([(p,) for p in found], "problem string").withColumn("rows", F.lit(len(rows)).cast("long"))


@query("""SELECT line FROM (VALUES ('# Orders'), ('## By status'), ('| status | n | share |'), ('| --- | --- | --- |')) AS _(line)
UNION ALL SELECT '| ' || o_orderstatus || ' | ' || count(*) || ' | ' || printf('%.3f', count(*)::DOUBLE / (SELECT count(*) FROM orders)) || ' |' FROM orders GROUP BY o_orderstatus""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown report on orders by status, written and read back by lines."""
    from quarryline.operators.aggregate import shares

    folder = _local(spark, _root(spark))
    counts = shares(T(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status")
    table = counts.select("status", F.col("n"), F.col("share").cast("double").alias("share"))
    (folder / "report.md").write_text(R.report("Orders", [("By status", "", table)]), encoding="utf-8")
    return spark.read.text(f"file:{folder}/report.md").select(F.col("value").alias("line")).filter("line != ''")


@query("""SELECT doc_id, 1 + i AS line FROM (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)""")
def added_line_map(spark: SparkSession, d: str) -> DataFrame:
    """Each text as the lines that a commit adds to a file, behind a hunk of another file that only loses lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    hunk = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n-++ gone\n kept\n--- /dev/null\n+++ b/y\n@@ -0,0 +1,"), F.size(lines), F.lit(" @@\n+"), F.array_join(lines, "\n+"))
    diffs = T(spark, d, "documents").select(F.col("doc_id").cast("string").alias("commit"), hunk.alias("diff"))
    return X.added_lines(diffs).filter("path = 'y'").select(F.col("commit").cast("long").alias("doc_id"), "line")


@query("SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 2 ELSE 1 END AS n_tests FROM documents")
def test_function_counts(spark: SparkSession, d: str) -> DataFrame:
    """The tests that sources have, behind the text of each document in comments and strings."""
    more = F.when(F.col("language") == "java", "class B extends TestCase { @ParameterizedTest(name = \"@Test\") void a(int x) {} public void testB() {} void helper() {} }\n")
    more = more.when(F.col("language") == "typescript", "it.only('test(1)', () => {}); x.test(1); // it()\n").otherwise("def test_a():\n    'def test_b(): pass'\n")
    files = sources(spark, d).select("file_id", "language", F.concat("source", more).alias("source"))
    return syntax.test_counts(syntax.nodes(files))


_HOOK = "describe('s', () => {\n  // {text}\n  beforeEach(() => {\n    const m = jest.fn();\n    if (m) run(() => m && q());\n  });\n});\n"


@query("""SELECT 'r' || doc_id % 10 AS repo, 'c' || doc_id AS sha, 'tests/' || doc_id || '.test.js' AS path, 'beforeEach' AS name, 3 AS start_line, 6 AS end_line, 4 AS loc, 1 AS num_mocks, 2 AS outer_complexity,
  'https://github.com/r' || doc_id % 10 || '/blob/c' || doc_id || '/tests/' || doc_id || '.test.js#L3-L6' AS github_url FROM documents""")
def snapshot_fixture_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures of a snapshot's test files, with their test doubles, their link, and the complexity of their own function."""
    key = F.col("doc_id").cast("string")
    source = F.replace(F.lit(_HOOK), F.lit("{text}"), F.translate(F.coalesce("text", F.lit("")), "\r\n\u2028\u2029", "    "))
    files = T(spark, d, "documents").select(F.concat(F.lit("r"), (F.col("doc_id") % 10).cast("string")).alias("repo"), F.concat(F.lit("c"), key).alias("sha"), F.concat(F.lit("tests/"), key, F.lit(".test.js")).alias("path"), source.alias("source"))
    skipped = files.withColumn("path", F.concat(F.lit("node_modules/"), "path"))
    found = syntax.rechecked(stored(C.snapshot_fixtures(files.unionByName(skipped)), "fixtures"))
    return found.select("repo", "sha", "path", "name", "start_line", "end_line", "loc", "num_mocks", "outer_complexity", "github_url")


@query("""SELECT 'c' || doc_id AS sha, 'f' AS name, doc_id % 2 = 0 AS is_complete_addition FROM documents WHERE doc_id % 5 > 0""")
def commit_fixture_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures that commits add: of files of which all lines or all but one are added; a commit that loses lines gives none."""
    key = F.col("doc_id").cast("string")
    body = F.concat(F.lit("import pytest\n@pytest.fixture\ndef f(m):\n    # "), F.translate(F.coalesce("text", F.lit("")), "\r\n\x0c\x00", "    "), F.lit("\n    return m"))
    lines = F.split(body, "\n", -1)
    # The second form has the function's last line already.
    every = F.concat(F.lit("+++ b/tests/test_a.py\n@@ -0,0 +1,5 @@\n+"), F.array_join(lines, "\n+"))
    most = F.concat(F.lit("+++ b/tests/test_a.py\n@@ -1,1 +1,5 @@\n+"), F.array_join(F.slice(lines, 1, 4), "\n+"), F.lit("\n     return m"))
    changes = T(spark, d, "documents").select(
        F.lit("r").alias("repo"), F.concat(F.lit("c"), key).alias("sha"), F.lit("tests/test_a.py").alias("path"), F.lit("modify").alias("change_type"),
        F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("deleted_lines"), F.when(F.col("doc_id") % 2 == 0, every).otherwise(most).alias("diff"), body.alias("source"),
    )
    return C.commit_fixtures(changes).select("sha", "name", "is_complete_addition")


@query("SELECT c_mktsegment, count(*) AS units, sum(n)::BIGINT AS items FROM (SELECT c_mktsegment, c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) GROUP BY ALL")
def matched_sample(spark: SparkSession, d: str) -> DataFrame:
    """Whole customers by segment towards the orders that the segments have: all of them, as the plan file tells too."""
    folder = _local(spark, _root(spark))
    units = T(spark, d, "customer").join(T(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("size"))
    match = units.groupBy("c_mktsegment").agg((F.sum("size") + F.count("*")).alias("n"))
    chosen = V.sample_plan(units.withColumn("weight", F.col("size") + 1), "c_custkey", "weight", "c_mktsegment", None, match, 3, str(folder / "plan.json"))
    return chosen.groupBy("c_mktsegment").agg(F.count("*").alias("units"), F.sum("size").alias("items"))


@query("""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(13) || chr(0) || chr(12) || chr(10) || '*', '     ') AS t FROM documents)
SELECT 'r' || doc_id % 10 AS repo_name, 'java' AS language, 'c' || doc_id AS commit_sha, 'src/test/A' || doc_id || 'Test.java' AS file_path, 'up' AS fixture_name, 'junit4_before' AS fixture_type, '3' AS start_line, '6' AS end_line,
  '4' AS loc, 'junit' AS framework, '1' AS num_mocks, 'per_test' AS scope, '1' AS cyclomatic_complexity, '1' AS max_nesting_depth, '0' AS num_parameters, '0' AS num_objects_instantiated,
  CALLS::VARCHAR AS num_external_calls, '1' AS num_comment_lines, '0.25' AS comment_density, '0' AS has_teardown_pair, 'https://github.com/r' || doc_id % 10 || '/blob/c' || doc_id || '/src/test/A' || doc_id || 'Test.java#L3-L6' AS github_url,
  CASE WHEN doc_id % 2 = 0 THEN 'claude' ELSE '' END AS agent_type, CASE WHEN doc_id % 2 = 0 THEN 'agent' ELSE 'human' END AS commit_kind, CASE WHEN doc_id % 3 = 0 THEN 'fix' ELSE '' END AS commit_type,
  sha256('@Before void up() {' || chr(10) || '    // ' || t || chr(10) || '    y = Mockito.spy(z); open();' || chr(10) || '  }') AS raw_source, '2025-03-01' AS commit_date, '2.0014' AS repo_age_at_commit_years, '1' AS is_complete_addition FROM t""".replace("CALLS", f"({_calls_sql('t')} + 1)"))
def fixture_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures with all their columns and one more, written as CSV and read back; the source as a digest."""
    key = F.col("doc_id").cast("string")
    text = F.translate(F.coalesce("text", F.lit("")), "\r\x00\x0c\n*", "     ")
    source = F.concat(F.lit("class A {\n  @Mock X x;\n  @Before void up() {\n    // "), text, F.lit("\n    y = Mockito.spy(z); open();\n  }\n}"))
    even = F.col("doc_id") % 2 == 0
    files = T(spark, d, "documents").select(
        F.col("doc_id").alias("file_id"), F.lit("java").alias("language"), source.alias("source"), F.concat(F.lit("r"), (F.col("doc_id") % 10).cast("string")).alias("repo"), F.concat(F.lit("c"), key).alias("sha"),
        F.concat(F.lit("src/test/A"), key, F.lit("Test.java")).alias("path"), F.when(even, "claude").alias("agent_type"), F.when(even, "agent").otherwise("human").alias("commit_kind"),
        F.when(F.col("doc_id") % 3 == 0, "fix(core): it").otherwise("update").alias("message"), F.lit("2025-03-01T10:00:00").alias("commit_date"), F.lit("2023-03-01").alias("created"), F.lit(1).alias("is_complete_addition"),
    )
    files = stored(files, "files")
    found = syntax.with_teardown(stored(syntax.fixtures(syntax.nodes(files)), "fixtures"))
    root = _root(spark)
    K.write_csv(C.fixture_table(found, files.drop("language", "source"), ["is_complete_addition"]), root, [*C.FIXTURE_COLUMNS, "is_complete_addition"])
    return K.read_csv(spark, root).fillna("").withColumn("raw_source", F.sha2(F.col("raw_source").cast("binary"), 256))


@query("SELECT o_orderstatus AS status, count(*) AS n, true AS none_elsewhere FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
def resumed_from_newest(spark: SparkSession, d: str) -> DataFrame:
    """Of two runs' tables the one that was written last, though its name comes first."""
    root = _root(spark)
    orders = T(spark, d, "orders").select(F.col("o_orderstatus").alias("status"))
    orders.filter("status = 'F'").write.parquet(f"{root}/run-b")
    orders.filter("status = 'O'").write.parquet(f"{root}/run-a")
    counts = spark.read.parquet(L.newest(spark, f"{root}/run-*")).groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("none_elsewhere", F.lit(L.newest(spark, f"{root}/other-*") is None))
