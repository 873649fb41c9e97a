"""Queries on gates, audits, discovery and exports, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import aggregate as A
from quarryline.operators import workflow as V
from quarryline.plans.registry import query, rounded
from quarryline.session import table as T


def _gated(spark: SparkSession, d: str) -> DataFrame:
    orders = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    units = T(spark, d, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left")
    return V.gated(units, {"orders": 5, "spent": 1_000_000}, {"orders": "few_orders", "spent": "low_value"})


_GATED = """g AS (SELECT c_custkey, c_mktsegment, CASE WHEN coalesce(n, 0) < 5 THEN 'few_orders' WHEN coalesce(spent, 0) < 1000000 THEN 'low_value' END AS skip_reason
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS spent FROM orders GROUP BY ALL) ON o_custkey = c_custkey)"""


@query(f"WITH {_GATED} SELECT c_custkey, skip_reason FROM g")
def quality_floors(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("c_custkey", "skip_reason")


@query(f"WITH {_GATED}, l AS (SELECT unnest(['passed', 'few_orders', 'low_value', 'no_licence']) AS reason, unnest([0, 1, 2, 3]) AS place), n AS (SELECT coalesce(skip_reason, 'passed') AS reason, count(*) AS n FROM g GROUP BY ALL) SELECT reason, coalesce(n, 0) AS n, place FROM l LEFT JOIN n USING (reason)")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.reason_counts(_gated(spark, d), ["passed", "few_orders", "low_value", "no_licence"])


@query("""
WITH u AS (SELECT o_custkey, CASE WHEN o_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS seg, count(*) FILTER (WHERE o_orderstatus = 'F') AS a, count(*) FILTER (WHERE o_orderstatus = 'P') AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT CASE WHEN seg = '' THEN '(not set)' ELSE seg END AS seg, count(*) AS units, sum(a)::BIGINT AS accepted, sum(r)::BIGINT AS rejected, count(*) FILTER (WHERE r = 0 AND a > 0) AS units_pure,
       count(*) FILTER (WHERE a = 0 AND r > 0) AS units_impure, round(100.0 * sum(r) / nullif(sum(a) + sum(r), 0), 4) AS pct_rejected FROM u GROUP BY 1
""")
def purity_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    seg = F.when(F.col("o_custkey") % 6 == 0, "").otherwise(F.col("c_mktsegment"))
    units = rows.groupBy("o_custkey", seg.alias("seg")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "P").alias("r"))
    return rounded(V.purity(units, "a", "r", "seg"), 4)


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE lang <> 'en') AS foreign, count(DISTINCT CASE WHEN lang <> 'en' THEN lang END) AS foreign_values FROM documents GROUP BY ALL")
def language_contamination(spark: SparkSession, d: str) -> DataFrame:
    return V.contaminated(T(spark, d, "documents"), "source", "lang", F.col("lang") == "en")


@query("SELECT lang, count(*) AS n, count(*) FILTER (WHERE n_chars <> length(trim(text))) AS mismatched, round(100.0 * count(*) FILTER (WHERE n_chars <> length(trim(text))) / count(*), 4) AS pct_mismatched FROM documents GROUP BY ALL")
def metric_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.mismatches(T(spark, d, "documents"), "n_chars", F.length(F.trim("text")).cast("long"), ["lang"]), 4)


@query("""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer), f AS (SELECT c_custkey, k FROM c WHERE c_custkey % 3 = 0)
SELECT c_custkey FROM f ORDER BY k LIMIT 12
""")
def adaptive_expansion(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("c_acctbal"), F.col("c_custkey")]
    found = V.expanded(T(spark, d, "customer").select("c_custkey", "c_acctbal"), order, lambda rows: rows.filter("c_custkey % 3 = 0").orderBy(*order), 12, 20, rounds=6)
    return found.select("c_custkey")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND NOT event_type = 'logout'")
def log_since(spark: SparkSession, d: str) -> DataFrame:
    return V.since(T(spark, d, "events"), "ts", F.expr("timestamp '2024-01-20'"), F.col("event_type") == "logout").select("event_id", "user_id")


@query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l
""")
def subset_export(spark: SparkSession, d: str) -> DataFrame:
    customers = T(spark, d, "customer")
    parts = V.exported(
        {"customer": (customers, "c_custkey", "c_custkey"), "orders": (T(spark, d, "orders"), "o_custkey", "o_orderkey"), "lineitem": (T(spark, d, "lineitem"), "l_orderkey", None)},
        customers.filter("c_mktsegment = 'BUILDING'"), "c_custkey",
    )
    counts = [p.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, p in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT 'order' AS level, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders UNION ALL SELECT 'line', l_orderkey, l_linenumber FROM lineitem")
def nested_persist(spark: SparkSession, d: str) -> DataFrame:
    lines = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    nested = T(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    parents, children = V.nested_to_tables(nested, "o_orderkey", "lines")
    lines = children.select(F.lit("line").alias("level"), "o_orderkey", F.col("l_linenumber").cast("long").alias("n"))
    return parents.select(F.lit("order").alias("level"), "o_orderkey", F.col("num_lines").alias("n")).unionByName(lines)


@query("""
WITH x AS (SELECT o_totalprice AS y, o_custkey::DOUBLE AS a FROM orders), m AS (SELECT regr_intercept(y, a) AS intercept, regr_r2(y, a) AS r2, regr_slope(y, a) AS slope FROM x)
SELECT round(intercept, 2) AS intercept, round(r2, 6) AS r2, round(slope, 4) AS slope FROM m
""")
def simple_regression(spark: SparkSession, d: str) -> DataFrame:
    t = T(spark, d, "orders").agg(F.regr_intercept("o_totalprice", "o_custkey").alias("intercept"), F.regr_r2("o_totalprice", "o_custkey").alias("r2"), F.regr_slope("o_totalprice", "o_custkey").alias("slope"))
    return t.select(F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"), F.round("slope", 4).alias("slope"))


@query("""
WITH p AS (SELECT o_totalprice AS y, o_custkey::DOUBLE AS a, dense_rank() OVER (ORDER BY o_orderpriority) - 1.0 AS b, dense_rank() OVER (ORDER BY o_orderstatus) - 1.0 AS c FROM orders),
m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(y) AS vy, var_pop(a) AS aa, var_pop(b) AS bb, var_pop(c) AS cc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, c) AS bc, covar_pop(a, y) AS ay, covar_pop(b, y) AS "by", covar_pop(c, y) AS cy FROM p),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
s AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * ("by" * cc - bc * cy) + ac * ("by" * bc - bb * cy)) / det AS x, (aa * ("by" * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - "by" * ac)) / det AS z, (aa * (bb * cy - "by" * bc) - ab * (ab * cy - "by" * ac) + ay * (ab * bc - bb * ac)) / det AS w FROM d)
SELECT 'intercept' AS term, round(my - x * ma - z * mb - w * mc, 3) AS value FROM s UNION ALL SELECT 'o_custkey', round(x, 3) FROM s UNION ALL SELECT 'o_orderpriority', round(z, 3) FROM s UNION ALL SELECT 'o_orderstatus', round(w, 3) FROM s
UNION ALL SELECT 'r2', round((x * ay + z * "by" + w * cy) / vy, 3) FROM s
""")
def label_regression(spark: SparkSession, d: str) -> DataFrame:
    found = V.regression(T(spark, d, "orders"), "o_totalprice", ["o_custkey"], ["o_orderpriority", "o_orderstatus"])
    return spark.createDataFrame([(k, round(v, 3)) for k, v in sorted(found.items())], "term string, value double")


@query("""
SELECT c_mktsegment, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH" FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").pivot("o_orderpriority", ["1-URGENT", "2-HIGH"]).count().fillna(0)


@query("""
WITH f AS (SELECT c_mktsegment, count(*) AS discovered, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS analysed FROM customer GROUP BY ALL)
SELECT *, round(coalesce(analysed * 1.0 / nullif(discovered, 0), 0), 6) AS survival FROM f
""")
def survival_rate(spark: SparkSession, d: str) -> DataFrame:
    active = T(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    rows = T(spark, d, "customer").join(active, "c_custkey", "left")
    out = rows.groupBy("c_mktsegment").agg(F.count("*").alias("discovered"), F.count_if(F.col("active")).alias("analysed"))
    return rounded(out.withColumn("survival", F.coalesce(F.try_divide(F.col("analysed").cast("double"), F.col("discovered")), F.lit(0.0))), 6)


@query("""
SELECT page_id, (len(regexp_extract_all(html, '=>')) - 1) + len(regexp_extract_all(html, '\\bfunction\\b')) > 0 AS nested, NOT regexp_matches(html, '^\\s*(before|after)\\s*\\(') AS not_hook FROM pages
""")
def nested_construct(spark: SparkSession, d: str) -> DataFrame:
    nested = (F.regexp_count("html", F.lit("=>")) - 1) + F.regexp_count("html", F.lit(r"\bfunction\b")) > 0
    return T(spark, d, "pages").select("page_id", nested.alias("nested"), (~F.col("html").rlike(r"^\s*(before|after)\s*\(")).alias("not_hook"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%mit license%' OR text ILIKE '%password%'")
def like_any(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("text")
    return T(spark, d, "documents").filter(c.ilike("%mit license%") | c.ilike("%password%")).select("doc_id")


@query("""
WITH w AS (SELECT * FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1995-12-31')
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderpriority = '1-URGENT' THEN 'setup' ELSE 'other' END AS kind FROM w
""")
def date_window(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "orders").filter(S.in_window("o_orderdate", "1995-01-01", "1995-12-31"))
    kind = S.kind_of(F.when(F.col("o_orderpriority") == "1-URGENT", "beforeEach").otherwise("x"), F.lit(None).cast("string"))
    return rows.select("o_orderkey", S.date_only("o_orderdate").alias("day"), kind.alias("kind"))


@query("""
WITH s AS (SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, max(CASE WHEN o_orderstatus = 'F' THEN n ELSE 0 END) AS a, max(CASE WHEN o_orderstatus = 'O' THEN n ELSE 0 END) AS c,
       least(max(CASE WHEN o_orderstatus = 'F' THEN n ELSE 0 END), max(CASE WHEN o_orderstatus = 'O' THEN n ELSE 0 END)) AS target FROM s GROUP BY ALL
""")
def aligned_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sides = [A.distribution(rows.filter(F.col("o_orderstatus") == s), "c_mktsegment").withColumnRenamed("n", name) for s, name in (("F", "a"), ("O", "c"))]
    both = sides[0].join(sides[1], "c_mktsegment", "full").fillna(0, ["a", "c"])
    return both.withColumn("target", F.least("a", "c"))
