"""Queries on sources, each with its SQL. The driver tables hold no code, so the texts of ``documents`` stand in the comments and
strings of sources that are written to the shared folder and parsed from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators import commits as C
from quarryline.operators import extract as X
from quarryline.operators import syntax
from quarryline.plans.registry import query
from quarryline.session import stored
from quarryline.session import table as T

_JAVA = """package a;
class A extends Base<B> {
  @Rule public Folder f = new Folder();
  @Before
  public <K> void init(Map<K, @Q List<String>> a, int b) throws E {
    /* {text} */
    for (String s : a) if (s == null || b > 0) x(new Foo() { void y() { if (z) w(); } }, () -> { while (q) r(); });
  }
  @After public void done() { open("@Before void no() {}"); }
}
"""
_SCRIPT = """describe('s', () => {
  beforeEach(async (): Promise<void> => {
    const t = `{text} ${u => u > 0 && v ? new A() : w}`;
    if (t) await db.connect();
  });
  // beforeAll(() => {})
  afterEach(() => done());
});
"""
_PYTHON = """import pytest
class T(TestCase):
    def setUp(self):
        # {text}
        if a or b:
            self.addCleanup(Foo().close)
    @pytest.fixture(scope='session')
    def f(self, g, *h):
        yield g
"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, language, source): a source with the text of each document, in one of three languages, stored."""
    text = F.translate(F.coalesce("text", F.lit("")), "\r\x00\x0c", "   ")
    remark = F.replace(text, F.lit("*/"), F.lit("* /"))
    template = F.replace(F.translate(text, "\\`", "/'"), F.lit("${"), F.lit("$ {"))
    lined = F.replace(text, F.lit("\n"), F.lit("\n# "))
    k = F.col("doc_id") % 3
    language = F.when(k == 0, "java").when(k == 1, "typescript").otherwise("python")
    made = [F.replace(F.lit(code), F.lit("{text}"), value) for code, value in ((_JAVA, remark), (_SCRIPT, template), (_PYTHON, lined))]
    source = F.when(k == 0, made[0]).when(k == 1, made[1]).otherwise(made[2])
    return stored(T(spark, d, "documents").select(F.col("doc_id").alias("file_id"), language.alias("language"), source.alias("source")), "sources")


def _calls_sql(text: str) -> str:
    return " + ".join(f"len(regexp_extract_all(lower({text}), '{p}'))" for p in X.EXTERNAL)


_TEXTS = """WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), chr(13) || chr(0) || chr(12), '   ') AS t FROM documents
), s AS (SELECT doc_id, t, replace(t, '*/', '* /') AS c, replace(replace(replace(t, '\\', '/'), '`', ''''), '${', '$ {') AS q, replace(t, chr(10), chr(10) || '# ') AS h,
  len(t) - len(replace(t, chr(10), '')) AS n FROM t)"""


@query(f"""{_TEXTS}
SELECT doc_id AS file_id, 'f' AS name, 'junit_rule' AS fixture_type, 'per_test' AS scope, 3 AS start_line, 3 AS end_line, 1 AS cyclomatic_complexity, 1 AS max_nesting_depth, 1 AS num_objects_instantiated,
  0 AS num_external_calls, 0 AS num_comment_lines, 0 AS num_parameters, true AS has_teardown_pair FROM s WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'init', 'junit4_before', 'per_test', 4, n + 8, 5, 4, 1, {_calls_sql("c")}, n + 1, 2, true FROM s WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'done', 'junit4_after', 'per_test', n + 9, n + 9, 1, 1, 0, 1, 0, 0, false FROM s WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, '<anonymous>_1', 'before_each', 'per_test', 2, n + 5, 2, 2, 1, {_calls_sql("q")} + 1, 0, 0, true FROM s WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, '<anonymous>_' || (n + 6), 'after_each', 'per_test', n + 7, n + 7, 1, 1, 0, 0, 0, 0, false FROM s WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'setUp', 'unittest_setup', 'per_test', 3, n + 6, 3, 2, 1, {_calls_sql("h")}, n + 1, 0, true FROM s WHERE doc_id % 3 = 2
UNION ALL SELECT doc_id, 'f', 'pytest_decorator', 'global', n + 8, n + 9, 1, 1, 0, 0, 0, 2, true FROM s WHERE doc_id % 3 = 2
""")
def parsed_fixtures(spark: SparkSession, d: str) -> DataFrame:
    found = stored(syntax.fixtures(syntax.nodes(sources(spark, d))), "fixtures")
    return syntax.with_teardown(found).drop("language", "framework", "loc", "parameters", "container", "raw_source")


@query("""
WITH s AS (SELECT doc_id, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS n FROM documents)
SELECT doc_id AS file_id, kind, c AS nodes FROM s, (VALUES ('class', 1), ('field', 1), ('method', 3), ('anonymous', 1), ('new', 2), ('for', 1), ('if', 2), ('while', 1), ('call', 4), ('comment', 1)) AS _(kind, c) WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, kind, c FROM s, (VALUES ('call', 5), ('function', 4), ('if', 1), ('new', 1), ('comment', 1)) AS _(kind, c) WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, kind, c FROM s, (VALUES ('class', 1), ('function', 2), ('call', 3)) AS _(kind, c) WHERE doc_id % 3 = 2
UNION ALL SELECT doc_id, 'comment', n + 1 FROM s WHERE doc_id % 3 = 2
""")
def syntax_nodes(spark: SparkSession, d: str) -> DataFrame:
    return syntax.nodes(sources(spark, d)).groupBy("file_id", "kind").agg(F.count("*").alias("nodes"))


@query("""
WITH s AS (SELECT doc_id, len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS n FROM documents)
SELECT doc_id AS file_id, 4 AS start_line, n + 8 AS end_line, true AS is_covered FROM s WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 2, n + 5, false FROM s WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 3, n + 6, true FROM s WHERE doc_id % 3 = 2
""")
def leaf_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Set-up code whose comment lines aren't among the added ones; of a template string the last line isn't either."""
    files = sources(spark, d)
    java, script = F.col("language") == "java", F.col("language") == "typescript"
    texts = F.size(F.split("source", "\n")) - 1 - F.when(java, 10).when(script, 8).otherwise(9)
    begin, end = F.when(java, 4).when(script, 2).otherwise(3), texts + F.when(java, 8).when(script, 5).otherwise(6)
    spans = stored(files.select("file_id", begin.alias("start_line"), end.alias("end_line"), "language"), "spans")
    code = F.when(java, F.array(F.col("start_line"), F.col("start_line") + 1, F.col("end_line") - 1))
    points = code.when(script, F.sequence("start_line", F.col("end_line") - 2)).otherwise(F.array(F.col("start_line"), F.col("end_line") - 1, F.col("end_line")))
    added = spans.select("file_id", F.explode(points).alias("point"))
    return C.covered_by_code(spans.select("file_id", "start_line", "end_line"), added, files, syntax.leaf_lines)


_HISTORY = """WITH RECURSIVE numbered AS (
  SELECT o_custkey AS repo, o_orderkey AS sha, o_orderdate AS date, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders
), links AS (
  SELECT a.repo, a.sha, b.sha AS parent FROM numbered a JOIN numbered b ON a.repo = b.repo AND (
    b.n = CASE WHEN a.n % 5 = 3 THEN a.n - 2 ELSE a.n - 1 END OR a.n % 10 = 5 AND b.n = a.n - 3)
), starts AS (
  SELECT repo, snapshot, arg_min(sha, sha::VARCHAR) AS sha FROM (
    SELECT *, max(date) OVER (PARTITION BY repo, snapshot) AS last FROM numbered, (VALUES (TIMESTAMP '1996-06-30'), (TIMESTAMP '1999-01-01')) AS _(snapshot) WHERE date <= snapshot
  ) WHERE date = last GROUP BY repo, snapshot
), reach AS (
  SELECT repo, snapshot, sha FROM starts
  UNION SELECT r.repo, r.snapshot, l.parent FROM reach r JOIN links l ON l.repo = r.repo AND l.sha = r.sha
)"""


@query(f"{_HISTORY} SELECT repo, snapshot, count(*) AS commits FROM reach GROUP BY repo, snapshot")
def commits_reachable(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a customer's commits: every fifth branches off and leaves one aside, which every other time is merged again."""
    order = Window.partitionBy("repo").orderBy("date", "key")
    orders = T(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("date"))
    n = F.row_number().over(order)
    before = lambda k: F.lag(F.col("key").cast("string"), k).over(order)
    parents = F.array(F.when(n % 5 == 3, before(2)).otherwise(before(1)), F.when(n % 10 == 5, before(3)))
    commits = stored(orders.select("repo", F.col("key").cast("string").alias("sha"), "date", F.array_compact(parents).alias("parents")), "history")
    days = F.explode(F.array(F.expr("timestamp '1996-06-30'"), F.expr("timestamp '1999-01-01'")))
    starts = stored(C.last_before(commits, commits.select("repo").distinct().select("repo", days.alias("date"))), "starts")
    return C.commits_before(commits, starts).select("repo", "snapshot", "commits")
