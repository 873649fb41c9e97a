"""Queries on commit logs, reviews, reports and stores, each with its SQL.

The driver tables have no commits, so orders stand for commits, their lines for changed files and customers for repositories.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import aggregate as A
from quarryline.operators import commits as C
from quarryline.operators import dedup as D
from quarryline.operators import extract as X
from quarryline.operators import joins as J
from quarryline.operators import reports as R
from quarryline.operators import validation as V
from quarryline.plans.analysis import _BH, _chi_sql, _rank_sql, _two_sided
from quarryline.plans.registry import query, rounded
from quarryline.session import shared_dir, stored
from quarryline.session import table as T
from quarryline.sources import stores as K


def _commits(spark: SparkSession, d: str) -> DataFrame:
    agent = F.when(F.col("o_orderpriority") == "1-URGENT", "claude").when(F.col("o_orderpriority") == "2-HIGH", "copilot")
    return T(spark, d, "orders").select(
        F.concat(F.lit("org/r"), (F.col("o_custkey") % 50).cast("string")).alias("repo"), F.md5(F.col("o_orderkey").cast("string")).alias("sha"), F.col("o_orderdate").alias("date"), agent.alias("agent"),
        (F.col("o_orderstatus") == "P").alias("merged"),
    )


def _changes(spark: SparkSession, d: str) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    path = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("tests/test_"), part, F.lit(".py")))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("src/"), part, F.lit("Test.java")))
        .otherwise(F.concat(F.lit("src/main"), part, F.lit(".ts")))
    )
    rows = T(spark, d, "lineitem").join(T(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.concat(F.lit("org/r"), (F.col("o_custkey") % 50).cast("string")).alias("repo"), F.md5(F.col("l_orderkey").cast("string")).alias("sha"), path.alias("path"),
        F.when(F.col("l_linestatus") == "F", "add").otherwise("modify").alias("change_type"), F.when(F.col("l_discount") > 0.08, 1).otherwise(0).alias("deleted_lines"),
    )


_LOG = """commits AS (
  SELECT 'org/r' || (o_custkey % 50) AS repo, md5(o_orderkey::VARCHAR) AS sha, o_orderdate AS date, CASE o_orderpriority WHEN '1-URGENT' THEN 'claude' WHEN '2-HIGH' THEN 'copilot' END AS agent, o_orderstatus = 'P' AS merged FROM orders
), changes AS (
  SELECT 'org/r' || (o_custkey % 50) AS repo, md5(l_orderkey::VARCHAR) AS sha, CASE l_returnflag WHEN 'A' THEN 'tests/test_' || l_partkey || '.py' WHEN 'R' THEN 'src/' || l_partkey || 'Test.java' ELSE 'src/main' || l_partkey || '.ts' END AS path,
         l_returnflag IN ('A', 'R') AS is_test, CASE WHEN l_linestatus = 'F' THEN 'add' ELSE 'modify' END AS change_type, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS deleted_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), touched AS (
  SELECT repo, sha, list_sort(list(DISTINCT path)) AS files, bool_and(deleted_lines = 0) AS pure FROM changes WHERE is_test GROUP BY ALL
), roles AS (
  SELECT c.repo, c.sha, c.date, c.agent, CASE WHEN agent IS NULL THEN 'human' ELSE 'agent' END AS role, coalesce(files, []) AS files, coalesce(pure, true) AS pure, files IS NOT NULL AS is_test_commit
  FROM commits c LEFT JOIN touched t ON c.repo = t.repo AND c.sha = t.sha WHERE date >= TIMESTAMP '1995-06-01' AND NOT merged
)"""


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return C.commit_roles(_commits(spark, d), _changes(spark, d), F.expr("timestamp '1995-06-01'"), F.col("merged"))


@query(f"WITH {_LOG} SELECT repo, sha, role, len(files) AS n_files, files[1] AS first_file, is_test_commit FROM roles")
def commit_roles(spark: SparkSession, d: str) -> DataFrame:
    return _roles(spark, d).select("repo", "sha", "role", F.size("test_files").cast("long").alias("n_files"), F.get("test_files", F.lit(0)).alias("first_file"), "is_test_commit")


@query(f"WITH {_LOG} SELECT repo, sha, role, agent, len(files) AS test_file_count, to_json(files)::VARCHAR AS test_file_paths FROM roles WHERE role = 'human' AND is_test_commit")
def test_commit_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.test_commit_rows(_roles(spark, d), "human").drop("date")


@query(f"WITH {_LOG} SELECT repo, agent, 'https://github.com/' || repo || '/commit/' || sha AS commit_url FROM roles WHERE agent IS NOT NULL")
def agent_commit_links(spark: SparkSession, d: str) -> DataFrame:
    return C.commit_links(_roles(spark, d)).select("repo", "agent", "commit_url")


@query(f"""WITH {_LOG}, n AS (SELECT repo, count(*) AS commits, count(*) FILTER (WHERE role = 'agent') AS agent_commits, count(*) FILTER (WHERE role = 'human') AS human_commits,
  count(*) FILTER (WHERE role = 'human' AND is_test_commit) AS human_test_commits FROM roles GROUP BY ALL)
SELECT *, CASE WHEN agent_commits * 1.0 / commits < 0.01 THEN 'experimental' WHEN agent_commits * 1.0 / commits < 0.05 THEN 'low' WHEN agent_commits * 1.0 / commits <= 0.20 THEN 'moderate' ELSE 'high' END AS adoption FROM n""")
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.scan_summary(_roles(spark, d))


@query(f"WITH {_LOG} SELECT repo, sha, len(files) AS n_files, pure AS accepted FROM roles WHERE role = 'human' AND is_test_commit")
def human_commit_pool(spark: SparkSession, d: str) -> DataFrame:
    return C.human_pool(_roles(spark, d), _changes(spark, d)).select("repo", "sha", F.size("test_files").cast("long").alias("n_files"), "accepted")


@query(f"""WITH {_LOG}, u AS (SELECT repo, count(*) FILTER (WHERE pure) AS a, count(*) FILTER (WHERE NOT pure) AS r FROM roles WHERE role = 'human' AND is_test_commit GROUP BY ALL)
SELECT count(*) AS units, count(*) FILTER (WHERE r = 0) AS none_rejected, count(*) FILTER (WHERE a = 0) AS all_rejected, round(avg(r * 1.0 / (a + r)), 6) AS mean_rejected FROM u""")
def rejection_distribution(spark: SparkSession, d: str) -> DataFrame:
    pool = C.human_pool(_roles(spark, d), _changes(spark, d))
    units = pool.groupBy("repo").agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    return rounded(R.rejection_distribution(units, "a", "r"), 6)


@query(f"WITH {_LOG} SELECT count(DISTINCT repo) AS repos, count(*) AS commits, round(count(*) * 1.0 / count(DISTINCT repo), 6) AS per_repo FROM roles WHERE agent IS NOT NULL")
def verification_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.verification(_roles(spark, d)), 6)


@query(f"""WITH {_LOG}, w AS (SELECT count(DISTINCT repo) AS all_repos, count(*) AS all_commits FROM roles WHERE agent IS NOT NULL)
SELECT agent, count(*) AS commits, all_repos, all_commits, all_repos >= 10 AND all_commits >= 100 AS sufficient FROM roles CROSS JOIN w WHERE agent IS NOT NULL GROUP BY ALL""")
def tier_yield(spark: SparkSession, d: str) -> DataFrame:
    return C.yield_of(_roles(spark, d), 10, 100)


@query(f"WITH {_LOG} SELECT repo, sha, count(*) OVER (PARTITION BY repo) AS pool FROM commits WHERE date <= TIMESTAMP '1996-12-31'")
def pre_cutoff_pool(spark: SparkSession, d: str) -> DataFrame:
    return C.before_cutoff(_commits(spark, d), F.expr("timestamp '1996-12-31'")).select("repo", "sha", "pool")


@query(f"WITH {_LOG}, s AS (SELECT repo, max(date) - INTERVAL 200 DAY AS at FROM commits GROUP BY ALL) SELECT s.repo, count(c.sha) AS commits FROM s LEFT JOIN commits c ON c.repo = s.repo AND c.date <= s.at GROUP BY s.repo")
def commits_up_to_snapshot(spark: SparkSession, d: str) -> DataFrame:
    commits = _commits(spark, d)
    snapshots = commits.groupBy("repo").agg((F.max("date") - F.expr("interval 200 days")).alias("date"))
    return C.reachable(commits, snapshots).select("repo", "commits")


@query(f"WITH {_LOG} SELECT DISTINCT repo, sha, path, CASE WHEN path LIKE '%.py' THEN 'python' ELSE 'java' END AS language FROM changes WHERE is_test AND change_type = 'add'")
def added_test_files(spark: SparkSession, d: str) -> DataFrame:
    return C.test_files_of(_changes(spark, d), added_only=True)


_TREE = """tree AS (SELECT 'org/' || (page_id % 7) AS repo, CASE page_id % 5 WHEN 0 THEN 'CLAUDE.md' WHEN 1 THEN 'docs/.cursor/rules/' || page_id || '.mdc' WHEN 2 THEN '.github/copilot-instructions.md' WHEN 3 THEN 'node_modules/x/' || page_id || '.test.js' ELSE 'web/' || page_id || '.test.js' END AS path, page_id % 5 AS k FROM pages)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(k == 0, "CLAUDE.md").when(k == 1, F.concat(F.lit("docs/.cursor/rules/"), i, F.lit(".mdc"))).when(k == 2, ".github/copilot-instructions.md")
    path = path.when(k == 3, F.concat(F.lit("node_modules/x/"), i, F.lit(".test.js"))).otherwise(F.concat(F.lit("web/"), i, F.lit(".test.js")))
    return T(spark, d, "pages").select(F.concat(F.lit("org/"), (F.col("page_id") % 7).cast("string")).alias("repo"), path.alias("path"))


@query(f"""WITH {_TREE}, f AS (SELECT repo, CASE k WHEN 0 THEN 'claude' WHEN 1 THEN 'cursor' ELSE 'copilot' END AS agent, count(DISTINCT path) AS n FROM tree WHERE k < 3 GROUP BY ALL), m AS (SELECT repo, sum(n) AS f FROM f GROUP BY ALL HAVING count(*) > 1)
SELECT agent, count(DISTINCT repo) AS repos, sum(n)::BIGINT AS files FROM f GROUP BY ALL UNION ALL SELECT NULL, count(*), coalesce(sum(f), 0)::BIGINT FROM m""")
def config_scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.config_summary(C.config_scan(_tree(spark, d), [("cursor", ".cursor/rules", True), ("claude", "CLAUDE.md", False), ("copilot", ".github/copilot-instructions.md", False)]))


@query(f"WITH {_TREE} SELECT DISTINCT repo, path, 'javascript' AS language FROM tree WHERE k = 4")
def tree_test_files(spark: SparkSession, d: str) -> DataFrame:
    return C.test_files_in(C.pruned(_tree(spark, d)))


# Extraction over sources that are made from every row of a table.

_PYTHON = "import pytest\n\n@pytest.fixture(scope='module')\ndef f{i}(a, b):\n    # open it\n    c = Connection(a)\n    if b:\n        requests.get(b)\n    yield c\n"
_JAVA = "import org.junit.*;\npublic class A{i}Test {\n  @Before\n  public void init() { if (a && b) { x = new Foo(); } }\n  @After\n  public void done() { }\n}\n"
_JS = "describe('s{i}', () => {\n  beforeEach(async () => {\n    const r = /[{]/g;\n    await db.connect();\n  });\n});\n"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    made = [F.replace(F.lit(text), F.lit("{i}"), i) for text in (_PYTHON, _JAVA, _JS)]
    k = F.col("doc_id") % 3
    language = F.when(k == 0, "python").when(k == 1, "java").otherwise("javascript")
    source = F.when(k == 0, made[0]).when(k == 1, made[1]).otherwise(made[2])
    return T(spark, d, "documents").select(F.col("doc_id").alias("file_id"), language.alias("language"), source.alias("source"))


@query("""
SELECT doc_id AS file_id, 'f' || doc_id AS name, 'pytest_decorator' AS fixture_type, 'module' AS scope, 3 AS start_line, 9 AS end_line, 2 AS cyclomatic_complexity, 2 AS max_nesting_depth, 1 AS num_objects_instantiated, 1 AS num_external_calls, 2 AS num_parameters, true AS has_teardown_pair FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'init', 'Before', 'test', 3, 4, 3, 2, 1, 0, 0, true FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'done', 'After', 'test', 5, 6, 1, 1, 0, 0, 0, false FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'beforeEach', 'hook_beforeEach', 'test', 2, 5, 1, 1, 0, 1, 0, false FROM documents WHERE doc_id % 3 = 2
""")
def extract_fixtures(spark: SparkSession, d: str) -> DataFrame:
    found = X.with_teardown(X.with_scopes(stored(X.fixtures(_sources(spark, d)), "fixtures")))
    return found.select("file_id", "name", "fixture_type", "scope", "start_line", "end_line", "cyclomatic_complexity", "max_nesting_depth", "num_objects_instantiated", "num_external_calls", "num_parameters", "has_teardown_pair")


@query("""
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM documents)
SELECT doc_id AS file_id, 'pytest_mock' AS framework, CASE WHEN contains(l, 'dummy') OR contains(l, 'dummies') THEN 'dummy' WHEN contains(l, 'stub') THEN 'stub' WHEN contains(l, 'spy') OR contains(l, 'spies') THEN 'spy' WHEN contains(l, 'fake') THEN 'fake' ELSE 'mock' END AS category,
       'pkg.m' || doc_id AS target, 2 AS interactions, length(t) + 5 AS at FROM s
UNION ALL SELECT doc_id, 'unittest_mock', CASE WHEN contains(l, 'dummy') OR contains(l, 'dummies') THEN 'dummy' WHEN contains(l, 'stub') THEN 'stub' WHEN contains(l, 'spy') OR contains(l, 'spies') THEN 'spy' WHEN contains(l, 'fake') THEN 'fake' ELSE 'mock' END,
       '', 1, length(t) + 44 + length(doc_id::VARCHAR) FROM s
""")
def mock_uses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    source = F.concat(F.coalesce("text", F.lit("")), F.lit("\nm = mocker.patch('pkg.m"), i, F.lit("')\nm.return_value = Mock()\nm.side_effect = 1\n"))
    return X.mocks(T(spark, d, "documents").select(F.col("doc_id").alias("file_id"), source.alias("source"))).drop("snippet")


def _calls_sql(column: str) -> str:
    return " + ".join(f"len(regexp_extract_all(lower({column}), '{p}'))" for p in X.EXTERNAL)


@query(f"SELECT page_id, {_calls_sql('html')} AS n FROM pages")
def external_call_counts(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "pages").select("page_id", S.occurrences("html", X.EXTERNAL).alias("n"))


# Reports.

_ORDERS = "SELECT o_orderstatus AS g, o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')"
_SEGMENTS = "SELECT c_mktsegment, o_orderstatus AS g, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')"


def _cells(p: str, adjusted: str) -> str:
    size = "abs(cliffs_delta)"
    shown = lambda x: f"CASE WHEN {x} IS NULL THEN '--' WHEN {x} < 0.001 THEN '<0.001' ELSE printf('%.3f', {x}) END"
    return f"""n1, n2, printf('U=%.1f', u) AS statistic, printf('%.3f', cliffs_delta) AS effect, CASE WHEN {size} < 0.147 THEN 'negligible' WHEN {size} < 0.33 THEN 'small' WHEN {size} < 0.474 THEN 'medium' ELSE 'large' END AS magnitude,
      {shown(p)} AS p, {shown(adjusted)} AS p_adjusted"""


def _comparison_sql(pooled: str, split: str) -> str:
    return f"""WITH o AS (WITH {_rank_sql(pooled, [])} SELECT * FROM tests), s AS (WITH {_rank_sql(split, ['c_mktsegment'])}, {_BH.format(key='c_mktsegment')} SELECT * FROM adjusted)
SELECT 0 AS place, 'Overall' AS label, {_cells('p', 'NULL::DOUBLE')} FROM o UNION ALL SELECT 1, c_mktsegment, {_cells('p', 'p_adjusted')} FROM s"""


def _by_segment(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(_comparison_sql(_ORDERS, _SEGMENTS))
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    return R.continuous_comparison(_by_segment(spark, d), "o_totalprice", "o_orderstatus", "F", "O", "c_mktsegment")


_MEANS = "SELECT o_orderstatus AS g, o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL"
_SEGMENT_MEANS = "SELECT c_mktsegment, o_orderstatus AS g, o_custkey, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL"


@query(_comparison_sql(_MEANS, _SEGMENT_MEANS))
def unit_level_comparison(spark: SparkSession, d: str) -> DataFrame:
    return R.continuous_comparison(_by_segment(spark, d), "o_totalprice", "o_orderstatus", "F", "O", "c_mktsegment", "o_custkey")


_CHI = _chi_sql("SELECT o_orderstatus AS g, o_orderpriority AS c FROM orders WHERE o_orderstatus IN ('F', 'O')", [])


@query(f"WITH t AS ({_CHI}) SELECT n1, n2, chi2, dof, p, CASE WHEN p >= 0.05 THEN 'balanced' ELSE 'imbalanced' END AS status FROM t")
def paired_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.paired_balance(T(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "F", "O"), 6)


@query(f"""WITH t AS ({_CHI}) SELECT 0 AS place, 'Overall' AS label, n1, n2, printf('chi2=%.1f (df=%d)', chi2, dof) AS statistic, printf('%.3f', cramers_v) AS effect,
  CASE WHEN cramers_v < 0.1 THEN 'negligible' WHEN cramers_v < 0.3 THEN 'small' WHEN cramers_v < 0.5 THEN 'medium' ELSE 'large' END AS magnitude, CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p, '--' AS p_adjusted FROM t""")
def categorical_table(spark: SparkSession, d: str) -> DataFrame:
    return R.categorical_comparison(T(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "F", "O")


_HAS = """SELECT c_mktsegment, o_orderstatus AS g, o_custkey, o_orderpriority < '3' AS has FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O')"""
_HAS_SHARES = f"SELECT c_mktsegment, g, o_custkey, avg(has::INTEGER) AS v FROM ({_HAS}) GROUP BY ALL"


@query(f"""WITH k AS (
  SELECT count(*) FILTER (WHERE g = 'F' AND has)::DOUBLE AS a, count(*) FILTER (WHERE g = 'F' AND NOT has)::DOUBLE AS b, count(*) FILTER (WHERE g = 'O' AND has)::DOUBLE AS c, count(*) FILTER (WHERE g = 'O' AND NOT has)::DOUBLE AS d, count(*)::DOUBLE AS n FROM ({_HAS})
), chi AS (SELECT *, n * power(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM k
), o AS (SELECT (a + b)::BIGINT AS n1, (c + d)::BIGINT AS n2, chi2, sqrt(chi2 / n) AS v, sqrt(chi2) AS z FROM chi
), s AS (WITH {_rank_sql(_HAS_SHARES, ['c_mktsegment'])}, {_BH.format(key='c_mktsegment')} SELECT * FROM adjusted)
SELECT 0 AS place, 'Overall' AS label, n1, n2, printf('chi2=%.1f (df=%d)', chi2, 1) AS statistic, printf('%.3f', v) AS effect, CASE WHEN v < 0.1 THEN 'negligible' WHEN v < 0.3 THEN 'small' WHEN v < 0.5 THEN 'medium' ELSE 'large' END AS magnitude,
  CASE WHEN {_two_sided('z')} < 0.001 THEN '<0.001' ELSE printf('%.3f', {_two_sided('z')}) END AS p, '--' AS p_adjusted FROM o
UNION ALL SELECT 1, c_mktsegment, {_cells('p', 'p_adjusted')} FROM s""")
def presence_table(spark: SparkSession, d: str) -> DataFrame:
    """Whether orders are urgent or high: by order over all, and by the customers' shares in each segment."""
    has = F.col("o_orderpriority") < "3"
    return R.presence_comparison(_by_segment(spark, d), has, "o_custkey", "o_orderstatus", "F", "O", "c_mktsegment")


@query("SELECT l_returnflag, sum(l_quantity) AS items, sum(l_linenumber)::BIGINT AS units, round(sum(l_quantity) * 1.0 / sum(l_linenumber), 6) AS per_unit FROM lineitem GROUP BY ALL")
def items_per_unit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.rates_per(T(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_linenumber"), 6)


@query("""SELECT CASE WHEN length(source) < 5 THEN 'N/A' ELSE source END AS source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang IN ('en', 'de')) AS "Total" FROM documents GROUP BY ALL""")
def language_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "documents").withColumn("source", F.when(F.length("source") >= 5, F.col("source")))
    return R.language_table(rows, "source", "lang", ["en", "de"])


@query("SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'debt' END AS reason, count(*) AS n, round(avg(c_acctbal), 4) AS mean_c_acctbal FROM customer GROUP BY ALL")
def skip_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "customer").withColumn("reason", F.when(F.col("c_acctbal") < 0, "debt"))
    return rounded(R.counters(rows, "reason", "c_mktsegment", ["c_acctbal"]), 4)


@query("SELECT o_orderstatus, round(avg(greatest(0, date_diff('day', o_orderdate::DATE, DATE '1997-06-30'))), 4) AS mean_days, median(greatest(0, date_diff('day', o_orderdate::DATE, DATE '1997-06-30'))) AS median_days FROM orders GROUP BY ALL")
def recency_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "orders").withColumn("days", F.greatest(F.lit(0), F.date_diff(F.expr("date '1997-06-30'"), F.to_date("o_orderdate"))))
    means = rows.groupBy("o_orderstatus").agg(F.avg("days").alias("mean_days"))
    return rounded(means.join(A.quantiles(rows, "days", ["o_orderstatus"], {"median_days": 0.5}), "o_orderstatus"), 4)


# Samples for review.


@query(f"""WITH {_LOG} SELECT 'commit' AS validation_type, '' AS language, repo AS repo_full_name, sha AS item_id, 'https://github.com/' || repo || '/commit/' || sha AS item_url, coalesce(agent, '') AS detection_signal,
  'agent_type=' || coalesce(agent, '') || '; commit_date=' || strftime(date, '%Y-%m-%d') || '; author= <>' AS evidence FROM commits""")
def validation_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _commits(spark, d).select(F.col("repo").alias("repo_name"), F.col("sha").alias("commit_sha"), F.date_format("date", "yyyy-MM-dd").alias("commit_date"), F.col("agent").alias("agent_type"))
    return V.normalised(rows, "commit")


_SAMPLE = """k AS (SELECT doc_id, lang, source, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' || ':42') AS h FROM documents),
t AS (SELECT least(count(*), ceil(384.1458820694124 / (1 + 383.1458820694124 / count(*))))::BIGINT AS n, count(*) AS s FROM documents),
e AS (SELECT lang, count(*) * max(t.n) / max(t.s)::DOUBLE AS x, max(t.n) AS n FROM documents CROSS JOIN t GROUP BY ALL),
q AS (SELECT lang, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, '{"lang":"' || lang || '"}') <= n - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h) AS i FROM k), s AS (SELECT doc_id, lang, source, h FROM r JOIN q USING (lang) WHERE i <= quota)"""


@query(f"WITH {_SAMPLE} SELECT printf('docs-%04d', row_number() OVER (ORDER BY h)) AS validation_id, doc_id, lang, source, '' AS label, '' AS reviewer_notes FROM s")
def validation_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "documents").select("doc_id", "lang", "source")
    return V.finished(V.validation_sample(rows, ["lang"], 42), "docs", 42)


@query("""
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id FROM r WHERE k <= least(n, ceil(384.1458820694124 / (1 + 383.1458820694124 / n)))
""")
def head_sample(spark: SparkSession, d: str) -> DataFrame:
    return V.head_sample(T(spark, d, "documents").select("lang", "doc_id"), "lang", "doc_id")


@query("""
WITH u AS (SELECT user_id, arg_max(event_type || ':' || json_extract_string(props, '$.k'), struct_pack(ts := ts, k := -event_id)) AS c FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY ALL),
     g AS (SELECT c, min(user_id) AS kept, count(*) AS n FROM u GROUP BY ALL HAVING count(*) > 1)
SELECT user_id AS removed, kept, c AS content_key, n AS cluster_size FROM u JOIN g USING (c) WHERE user_id <> kept
""")
def snapshot_duplicates(spark: SparkSession, d: str) -> DataFrame:
    events = T(spark, d, "events").withColumn("c", F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")))
    last = J.latest_before(events, ["user_id"], "ts", F.expr("timestamp '2024-01-15'"), [F.col("event_id")], ["c"])
    return D.duplicate_clusters(last, F.col("c"), "user_id", [F.col("user_id")])


# Stores and filters.


@query("SELECT c_custkey, n, CASE WHEN n IS NULL THEN 'left_only' ELSE 'both' END AS _merge FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL) ON o_custkey = c_custkey")
def merge_indicator(spark: SparkSession, d: str) -> DataFrame:
    counts = T(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return J.merged_with(T(spark, d, "customer").select("c_custkey"), counts, ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def in_list_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = T(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("name"))
    return K.split_by_names(T(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"chosen": names})["chosen"].select("o_orderkey")


@query("WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS created, o_orderpriority FROM orders) SELECT o_orderkey, created FROM r WHERE (created = '' OR created <= '1995-12-31') AND lower(o_orderpriority) IN ('1-urgent', '2-high')")
def pre_cutoff_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "orders").withColumn("created", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    names = S.language_names([" 1-Urgent", "2-HIGH", "1-urgent", ""])
    return rows.filter(S.until_or_blank("created", "1995-12-31") & S.is_language("o_orderpriority", names)).select("o_orderkey", "created")


@query("SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'infrastructure' WHEN contains(lower(c_mktsegment), 'house') THEN 'consumer' ELSE 'other' END AS domain, round(date_diff('day', DATE '1992-01-01' + c_custkey::INTEGER % 3000, DATE '2000-01-01') / 365.25, 6) AS age FROM customer WHERE DATE '1992-01-01' + c_custkey::INTEGER % 3000 <= DATE '2000-01-01' UNION ALL SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'infrastructure' WHEN contains(lower(c_mktsegment), 'house') THEN 'consumer' ELSE 'other' END, NULL FROM customer WHERE DATE '1992-01-01' + c_custkey::INTEGER % 3000 > DATE '2000-01-01'")
def control_variables(spark: SparkSession, d: str) -> DataFrame:
    begun = F.date_add(F.expr("date '1992-01-01'"), (F.col("c_custkey") % 3000).cast("int"))
    rows = T(spark, d, "customer").withColumn("created", begun)
    rules = [("infrastructure", ["build"]), ("consumer", ["house"])]
    return rounded(rows.select("c_custkey", S.first_keyword("c_mktsegment", rules, "other").alias("domain"), S.age_years("created", F.expr("date '2000-01-01'")).alias("age")), 6)


@query("""
WITH n AS (SELECT o_custkey AS c_custkey, CASE WHEN count(*) > 12 THEN 'BUSY' END AS seg, round(max(o_totalprice), 2) AS bal FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, round(coalesce(bal, c_acctbal), 2) AS c_acctbal FROM customer LEFT JOIN n USING (c_custkey)
""")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    changes = T(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.when(F.count("*") > 12, "BUSY").alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal"))
    return rounded(K.updated(T(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), changes, ["c_custkey"]), 2)


@query("SELECT doc_id, lang, NULL::BIGINT AS stars, quality FROM documents JOIN labels USING (doc_id)")
def grown_table(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "documents").select("doc_id", "lang").join(T(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return K.grown(rows, {"stars": "bigint", "quality": "bigint"}).select("doc_id", "lang", "stars", "quality")


@query("SELECT CASE WHEN lang = 'de' THEN 'javascript' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY ALL")
def folded_languages(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "documents").withColumn("language", F.when(F.col("lang") == "de", "typescript").otherwise(F.col("lang")))
    return K.sql_rows(spark, "SELECT language, 1 AS one FROM {rows}", {"rows": rows}).groupBy("language").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey < 0")
def table_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.table_counts({"customer": T(spark, d, "customer"), "nation": T(spark, d, "nation"), "region": T(spark, d, "region").filter("r_regionkey < 0")})


@query("SELECT 'debt' AS part, c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'rich', c_custkey FROM customer WHERE c_acctbal > 8000")
def split_by_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "customer").select("c_custkey", "c_acctbal")
    lists = {"debt": rows.filter("c_acctbal < 0").select(F.col("c_custkey").alias("name")), "rich": rows.filter("c_acctbal > 8000").select(F.col("c_custkey").alias("name"))}
    parts = K.split_by_names(rows, "c_custkey", lists)
    return parts["debt"].select(F.lit("debt").alias("part"), "c_custkey").unionByName(parts["rich"].select(F.lit("rich").alias("part"), "c_custkey"))


@query("SELECT c_custkey::VARCHAR AS unit FROM customer WHERE c_mktsegment <> 'BUILDING'")
def progress_pending(spark: SparkSession, d: str) -> DataFrame:
    """What is left after some units have been marked, twice, in a progress table."""
    units = T(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("unit"), "c_mktsegment")
    progress = K.Progress(spark, f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}")
    for _ in range(2):
        progress.mark(units.filter("c_mktsegment = 'BUILDING'"), "scan")
    return progress.pending(units.select("unit"), "scan")
