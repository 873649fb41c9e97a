"""Queries on joins, aggregates, windows and sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import aggregate as A
from quarryline.operators import dedup as D
from quarryline.operators import joins as J
from quarryline.operators.running import numbered
from quarryline.operators.sampling import balanced_pairs, relaxed
from quarryline.plans.registry import query, rounded
from quarryline.session import table as T


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 4) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem").filter("l_shipdate <= timestamp '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 4).alias("avg_discount"),
        F.count("*").alias("n"),
    )


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL")
def dist_by_category(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(T(spark, d, "orders"), "o_orderpriority")


def _orders_customers(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "orders").join(T(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query("SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def dist_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(_orders_customers(spark, d), "c_mktsegment", "o_orderpriority")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY ALL")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.shares(T(spark, d, "orders"), "o_orderpriority"), 6)


@query("SELECT c_mktsegment, count(DISTINCT o_custkey) AS units, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS units_f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def count_distinct_cluster_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders_customers(spark, d)
    return rows.groupBy("c_mktsegment").agg(F.countDistinct("o_custkey").alias("units"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("units_f"))


@query("""
SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
       round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS pct_returned, round(100.0 * count(*) FILTER (WHERE l_discount > 0.05) / count(*), 4) AS pct_discounted
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL
""")
def conditional_rate_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem").join(_orders_customers(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(A.rates(rows, ["c_mktsegment"], returned=F.col("l_returnflag") == "R", discounted=F.col("l_discount") > 0.05), 4)


@query("SELECT c_mktsegment, l_returnflag, l_linestatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def chain_join_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem").join(_orders_customers(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.distribution(rows, "c_mktsegment", "l_returnflag", "l_linestatus")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join_active_units(spark: SparkSession, d: str) -> DataFrame:
    big = T(spark, d, "orders").filter("o_totalprice > 200000")
    return T(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return D.excluded(T(spark, d, "documents"), T(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(avg(o_totalprice), 2) AS mean_price, round(median(o_totalprice), 2) AS median_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def left_join_maturity(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "customer").join(T(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.round(F.median("o_totalprice"), 2).alias("median_price"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS n_returned FROM orders")
def correlated_child_count(spark: SparkSession, d: str) -> DataFrame:
    returned = T(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_returned"))
    return T(spark, d, "orders").select("o_orderkey").join(returned, "o_orderkey", "left").fillna(0, ["n_returned"])


@query("SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY ALL) USING (doc_id)")
def enrich_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    return J.enrich(T(spark, d, "documents").select("doc_id", "lang"), T(spark, d, "labels"), ["doc_id"], {"quality": -1})


@query("""
SELECT doc_id, expected, CASE WHEN quality IS NULL THEN 'missing' WHEN quality <> expected THEN 'mismatch' ELSE 'ok' END AS reason
FROM (SELECT doc_id, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS expected FROM documents) LEFT JOIN labels USING (doc_id)
""")
def reconcile_classification(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 300, 1).otherwise(0).alias("expected"))
    return J.reconcile(docs, T(spark, d, "labels"), ["doc_id"], "expected", "quality")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, struct_pack(ts := ts, k := -event_id)) AS event_id FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY ALL")
def asof_cutoff_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return J.latest_before(T(spark, d, "events"), ["user_id"], "ts", F.expr("timestamp '2024-01-15'"), [F.col("event_id")], ["event_id"])


@query("""
WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS new_customer FROM customer),
     o AS (SELECT o_orderkey, new_customer, row_number() OVER (ORDER BY o_orderkey) AS new_order FROM orders JOIN c ON o_custkey = c_custkey)
SELECT new_order, new_customer, l_linenumber, l_quantity FROM lineitem JOIN o ON l_orderkey = o_orderkey
""")
def fk_subset_remap(spark: SparkSession, d: str) -> DataFrame:
    chosen = numbered(T(spark, d, "customer").select("c_custkey"), "c_custkey", "new_customer")
    orders = T(spark, d, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "new_customer")
    orders = numbered(orders, "o_orderkey", "new_order")
    return T(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("new_order", "new_customer", "l_linenumber", "l_quantity")


@query("""
SELECT a.event_id, EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND CAST(b.ts AS DATE) = CAST(a.ts AS DATE)) AS has_purchase
FROM events a WHERE a.event_type = 'click'
""")
def pair_within_group(spark: SparkSession, d: str) -> DataFrame:
    events = T(spark, d, "events").withColumn("day", F.to_date("ts"))
    clicks, bought = events.filter("event_type = 'click'"), events.filter("event_type = 'purchase'")
    return J.with_partner(clicks, bought, [("user_id", "user_id"), ("day", "day")], "has_purchase").select("event_id", "has_purchase")


@query("""
WITH spans AS (SELECT o_orderkey, 1 AS first, 1 + CAST(o_orderkey % 5 AS INTEGER) AS last FROM orders)
SELECT o_orderkey, first, last, (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber BETWEEN first AND last) = last - first + 1 AS is_covered FROM spans
""")
def line_range_coverage(spark: SparkSession, d: str) -> DataFrame:
    spans = T(spark, d, "orders").select("o_orderkey", F.lit(1).alias("first"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("last"))
    points = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return J.covered(spans, points, ["o_orderkey"], "first", "last", "l_linenumber")


@query("""
WITH m AS (SELECT c_mktsegment, o_custkey, avg(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, count(*) AS units, round(avg(x), 4) AS mean_o_totalprice FROM m GROUP BY ALL
""")
def cluster_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.mean_of_means(_orders_customers(spark, d), "o_custkey", ["o_totalprice"], ["c_mktsegment"]), 4)


@query("""
WITH t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY ALL), k AS (SELECT DISTINCT o_orderpriority FROM orders),
     n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, round(coalesce(n, 0) * 1.0 / total, 6) AS proportion FROM t CROSS JOIN k LEFT JOIN n USING (o_custkey, o_orderpriority)
""")
def cluster_category_proportions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.cluster_proportions(T(spark, d, "orders"), "o_custkey", "o_orderpriority"), 6)


@query("""
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, min(l_extendedprice) AS min,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS max
FROM lineitem GROUP BY ALL
""")
def describe_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.described(T(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), 4)


@query("""
WITH n AS (SELECT c_mktsegment, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT c_mktsegment, arg_min(o_orderpriority, struct_pack(a := -n, b := o_orderpriority)) AS mode FROM n GROUP BY ALL
""")
def label_mode(spark: SparkSession, d: str) -> DataFrame:
    return A.most_common(_orders_customers(spark, d), ["c_mktsegment"], "o_orderpriority")


@query("""
SELECT cr.r_name AS source, count(*) AS n, count(*) FILTER (WHERE cr.r_name <> sr.r_name) AS leaked, round(100.0 * count(*) FILTER (WHERE cr.r_name <> sr.r_name) / count(*), 4) AS pct
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey GROUP BY ALL
""")
def leakage_matrix(spark: SparkSession, d: str) -> DataFrame:
    places = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = T(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("source"))
    sellers = T(spark, d, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("target"))
    rows = T(spark, d, "lineitem").join(T(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rounded(A.leakage(rows, "source", "target"), 4)


@query("""
WITH u AS (SELECT event_type, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS bucket FROM events)
SELECT coalesce(event_type, 'Total') AS event_type, count(*) AS n, count(*) FILTER (WHERE bucket = 'low') AS n_low, count(*) FILTER (WHERE bucket = 'mid') AS n_mid, count(*) FILTER (WHERE bucket = 'high') AS n_high,
       round(100.0 * count(*) FILTER (WHERE bucket = 'low') / count(*), 4) AS pct_low, round(100.0 * count(*) FILTER (WHERE bucket = 'mid') / count(*), 4) AS pct_mid, round(100.0 * count(*) FILTER (WHERE bucket = 'high') / count(*), 4) AS pct_high
FROM u GROUP BY ROLLUP (event_type)
""")
def funnel_with_total(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "events").withColumn("bucket", F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high"))
    return rounded(A.funnel(rows, "event_type", "bucket", ["low", "mid", "high"]), 4)


@query("""
SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, count(*) FILTER (WHERE n_chars < 500) AS n_short
FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())
""")
def grouping_sets_buckets(spark: SparkSession, d: str) -> DataFrame:
    return A.grouped_sets(
        T(spark, d, "documents"), ["lang", "source"], [["lang", "source"], ["lang"], []], F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 500).alias("n_short")
    ).select("lang", "source", "n", "chars", "n_short")


@query("""
SELECT c_mktsegment, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS "F", round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'O') / count(*), 4) AS "O",
       round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 4) AS "P"
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL
""")
def pivot_row_percent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.pivot_percent(_orders_customers(spark, d), "c_mktsegment", "o_orderstatus", ["F", "O", "P"]), 4)


@query("""
WITH n AS (SELECT l_returnflag AS side, l_shipdate::DATE - date_trunc('month', l_shipdate)::DATE AS day, count(*) AS n FROM lineitem GROUP BY ALL),
     s AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY side) AS share, row_number() OVER (PARTITION BY side ORDER BY n DESC, day) AS k FROM n),
     c AS (SELECT DISTINCT day FROM s WHERE k <= 3), e AS (SELECT DISTINCT side FROM s)
SELECT side, day::INTEGER AS day, coalesce(n, 0) AS n, round(coalesce(share, 0), 6) AS share FROM e CROSS JOIN c LEFT JOIN s USING (side, day)
""")
def topn_per_group_union(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "lineitem").select(F.col("l_returnflag").alias("side"), (F.dayofmonth("l_shipdate") - 1).alias("day"))
    return rounded(A.top_per_group_union(rows, "side", "day", 3), 6)


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_mktsegment IS NOT NULL ORDER BY c_acctbal DESC, c_mktsegment, c_custkey LIMIT 25")
def topk_multi_key(spark: SparkSession, d: str) -> DataFrame:
    rows = T(spark, d, "customer").filter("c_acctbal >= 1000 and c_mktsegment is not null")
    return rows.orderBy(F.desc("c_acctbal"), "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment", "c_acctbal").limit(25)


@query("""
WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal > 20000 THEN 1 WHEN c_acctbal > 9900 THEN 2 WHEN c_acctbal > 0 THEN 3 END AS attempt FROM customer)
SELECT c_custkey, attempt FROM a WHERE attempt = (SELECT min(attempt) FROM a)
""")
def progressive_relaxation(spark: SparkSession, d: str) -> DataFrame:
    return relaxed(T(spark, d, "customer"), [F.col("c_acctbal") > 20000, F.col("c_acctbal") > 9900, F.col("c_acctbal") > 0]).select("c_custkey", "attempt")


@query("""
WITH r AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, max(ts) OVER () AS now FROM events)
SELECT user_id, count(*) AS n, round(avg(date_diff('day', ts::DATE, now::DATE)), 4) AS mean_days, median(date_diff('day', ts::DATE, now::DATE)) AS median_days FROM r WHERE k > 1 GROUP BY ALL
""")
def drop_group_max(spark: SparkSession, d: str) -> DataFrame:
    events = T(spark, d, "events")
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    now = events.agg(F.max("ts").alias("now"))
    rest = events.join(last, "user_id").filter(F.struct("ts", "event_id") < F.col("m")).crossJoin(F.broadcast(now))
    days = F.date_diff("now", "ts")
    return rest.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(days), 4).alias("mean_days"), F.median(days).alias("median_days"))


@query("""
SELECT c_custkey, c_acctbal, round(row_number() OVER w * 1.0 / count(*) OVER (), 6) AS unit_share, round(sum(c_acctbal) OVER w / sum(c_acctbal) OVER (), 6) AS value_share
FROM customer WHERE c_acctbal > 0 WINDOW w AS (ORDER BY c_acctbal, c_custkey ROWS UNBOUNDED PRECEDING)
""")
def lorenz_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.lorenz(T(spark, d, "customer").filter("c_acctbal > 0"), "c_acctbal", "c_custkey"), 6)


@query("SELECT user_id, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_type, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS last_type FROM events GROUP BY ALL")
def first_last_per_group(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return T(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query("""
WITH c AS (SELECT user_id, least(count(*) FILTER (WHERE event_type = 'click'), count(*) FILTER (WHERE event_type = 'purchase'), 3) AS take FROM events GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('click', 'purchase'))
SELECT event_id, user_id, event_type FROM r JOIN c USING (user_id) WHERE k <= take
""")
def balanced_pairs_by_user(spark: SparkSession, d: str) -> DataFrame:
    return balanced_pairs(T(spark, d, "events"), "user_id", "event_type", ("click", "purchase"), [F.col("ts"), F.col("event_id")], 3).select("event_id", "user_id", "event_type")


@query("SELECT o_orderstatus, round(corr(o_totalprice, o_custkey), 6) AS corr, round(regr_slope(o_custkey, log10(o_totalprice + 1)), 4) AS slope, round(regr_intercept(o_custkey, log10(o_totalprice + 1)), 3) AS intercept FROM orders GROUP BY ALL")
def corr_and_trend(spark: SparkSession, d: str) -> DataFrame:
    t = A.trend(T(spark, d, "orders"), "o_totalprice", "o_custkey", ["o_orderstatus"])
    return t.select("o_orderstatus", F.round("corr", 6).alias("corr"), F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("""
WITH h AS (SELECT least(greatest(floor(o_totalprice / 50000), 0), 7)::INTEGER AS bin, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT range::INTEGER AS bin FROM range(8)),
     f AS (SELECT bin, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (bin))
SELECT bin, bin * 50000.0::DOUBLE AS low_edge, n, repeat('#', round_even(n * 40.0 / (SELECT max(n) FROM f), 0)::INTEGER) AS bar FROM f
""")
def fixed_bin_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(T(spark, d, "orders"), "o_totalprice", 0.0, 400000.0, 8)


@query("""
WITH n AS (SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
     y AS (SELECT unnest(range(min(year), max(year) + 1))::INTEGER AS year FROM n), k AS (SELECT DISTINCT o_orderstatus FROM n)
SELECT year, o_orderstatus, coalesce(n, 0) AS n FROM y CROSS JOIN k LEFT JOIN n USING (year, o_orderstatus)
""")
def dense_timeline(spark: SparkSession, d: str) -> DataFrame:
    return A.timeline(T(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_orderstatus")


@query("""
WITH b AS (SELECT lang, n_chars, CASE WHEN n_chars < 500 THEN '1' WHEN n_chars < 1000 THEN '2' WHEN n_chars < 2000 THEN '3' WHEN n_chars < 4000 THEN '4' ELSE '5+' END AS depth FROM documents),
     n AS (SELECT lang, depth, count(*) AS n, median(n_chars) AS median_chars FROM b GROUP BY ALL)
SELECT lang, depth, n, median_chars, round(n * 1.0 / sum(n) OVER (PARTITION BY lang), 6) AS share FROM n
""")
def depth_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("n_chars")
    rows = T(spark, d, "documents").withColumn("depth", F.when(c < 500, "1").when(c < 1000, "2").when(c < 2000, "3").when(c < 4000, "4").otherwise("5+"))
    counts = rows.groupBy("lang", "depth").agg(F.count("*").alias("n"), F.median("n_chars").alias("median_chars"))
    return rounded(J.share_of(counts, "n", "share", ["lang"]), 6)


@query("""
WITH r AS (SELECT doc_id, md5(text) AS k, count(*) OVER (PARTITION BY md5(text)) AS n, row_number() OVER w AS i, first_value(doc_id) OVER w AS kept FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id))
SELECT doc_id AS removed, kept, k AS content_key, n AS cluster_size FROM r WHERE i > 1
""")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_clusters(T(spark, d, "documents"), F.md5("text"), "doc_id", [F.desc("n_chars"), F.col("doc_id")])


@query("""
WITH p AS (SELECT DISTINCT md5(text) AS k, source FROM documents), o AS (SELECT k, count(*) AS owners FROM p GROUP BY ALL HAVING count(*) > 1), m AS (SELECT source, count(*) AS size FROM documents GROUP BY ALL),
     r AS (SELECT k, source, owners, row_number() OVER w AS i, first_value(source) OVER w AS kept FROM p JOIN o USING (k) JOIN m USING (source) WINDOW w AS (PARTITION BY k ORDER BY size DESC, source))
SELECT k AS content_key, source AS owner_removed, kept AS owner_kept, owners FROM r WHERE i > 1
""")
def cross_owner_dups(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents").select(F.md5("text").alias("content_key"), "source")
    sizes = docs.groupBy("source").agg(F.count("*").alias("size"))
    return D.cross_owner(docs, "content_key", "source", sizes, [F.desc("size")])


@query("""
WITH r AS (SELECT lang, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id) AS i FROM documents)
SELECT lang, count(*) AS before, count(*) FILTER (WHERE i = 1) AS after, count(*) FILTER (WHERE i > 1) AS removed FROM r GROUP BY ALL
""")
def dedup_filter_and_audit_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents")
    gone = dup_clusters(spark, d).select(F.col("removed").alias("doc_id"))
    kept = D.excluded(docs, gone, ["doc_id"]).groupBy("lang").agg(F.count("*").alias("after"))
    return docs.groupBy("lang").agg(F.count("*").alias("before")).join(kept, "lang", "left").fillna(0, ["after"]).withColumn("removed", F.col("before") - F.col("after"))


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 3), o AS (SELECT * FROM orders WHERE o_custkey % 10 <> 3), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT c_custkey, c_mktsegment, (SELECT count(*) FROM o WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM l JOIN o ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS n_lines FROM c
""")
def cascade_delete_resync(spark: SparkSession, d: str) -> DataFrame:
    customers = T(spark, d, "customer").select("c_custkey", "c_mktsegment")
    gone = customers.filter("c_custkey % 10 = 3")
    lines = T(spark, d, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    left, orders, lines = D.cascade(customers, [(T(spark, d, "orders"), "o_orderkey", "o_custkey"), (lines, "line", "l_orderkey")], gone, "c_custkey")
    counted = D.resynced(left, orders, "c_custkey", "o_custkey", {"n_orders": F.count("*")})
    return D.resynced(counted, lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "c_custkey", "o_custkey", {"n_lines": F.count("*")})


@query("SELECT user_id, event_type, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id FROM events GROUP BY ALL")
def first_seen_distinct(spark: SparkSession, d: str) -> DataFrame:
    return J.firsts(T(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT dataset, o_orderpriority, count(*) AS n FROM (SELECT 'a' AS dataset, o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'c', o_orderpriority FROM orders WHERE o_orderstatus = 'O') GROUP BY ALL")
def tagged_union(spark: SparkSession, d: str) -> DataFrame:
    orders = T(spark, d, "orders")
    parts = [orders.filter(F.col("o_orderstatus") == s).withColumn("dataset", F.lit(tag)) for s, tag in (("F", "a"), ("O", "c"))]
    return A.distribution(parts[0].unionByName(parts[1]), "dataset", "o_orderpriority")


@query("SELECT year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT year(o_orderdate) FROM orders WHERE o_orderstatus = 'O'")
def shared_strata_only(spark: SparkSession, d: str) -> DataFrame:
    years = T(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").cast("long").alias("year"))
    return years.filter("o_orderstatus = 'F'").select("year").intersect(years.filter("o_orderstatus = 'O'").select("year"))


@query("""
WITH old AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS first_priority FROM orders WHERE year(o_orderdate) < 1996 GROUP BY ALL),
     new AS (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS first_priority FROM orders WHERE year(o_orderdate) >= 1996 GROUP BY ALL)
SELECT coalesce(old.o_custkey, new.o_custkey) AS o_custkey, coalesce(new.n, old.n) AS n, CASE WHEN old.o_custkey IS NULL THEN new.first_priority ELSE old.first_priority END AS first_priority, old.o_custkey IS NULL AS is_new
FROM old FULL JOIN new ON old.o_custkey = new.o_custkey
""")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    orders = T(spark, d, "orders")
    make = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("first_priority"))
    return D.upserted(make(orders.filter(F.year("o_orderdate") < 1996)), make(orders.filter(F.year("o_orderdate") >= 1996)), ["o_custkey"], ["n"])


@query("""
WITH old AS (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_id % 2 = 0) WHERE k = 1),
     new AS (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_id % 2 = 1) WHERE k = 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.user_id = new.user_id AND old.event_type = new.event_type)
""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    events = T(spark, d, "events")
    keys, order = ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]
    old = J.firsts(events.filter("event_id % 2 = 0"), keys, order)
    return D.inserted(old, events.filter("event_id % 2 = 1"), keys, order).select("user_id", "event_type", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def foreign_key_orphans(spark: SparkSession, d: str) -> DataFrame:
    return D.orphans(T(spark, d, "lineitem"), T(spark, d, "part").filter("p_size <= 40"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query("""
SELECT (SELECT count(*) FROM customer) AS units, (SELECT count(DISTINCT o_custkey) FROM orders) AS active_units, (SELECT count(*) FROM orders) AS rows_total,
       round((SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)), 4) AS rows_per_unit, round((SELECT count(DISTINCT o_custkey) FROM orders) * 100.0 / (SELECT count(*) FROM customer), 4) AS pct_active
""")
def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    units = T(spark, d, "customer").agg(F.count("*").alias("units"))
    per = T(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    active = per.agg(F.count("*").alias("active_units"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"), F.round(F.avg("n"), 4).alias("rows_per_unit"))
    return units.crossJoin(active).withColumn("pct_active", F.round(F.try_divide(F.col("active_units") * 100.0, F.col("units")), 4))


@query("SELECT o_orderstatus, round(avg(CASE WHEN o_totalprice = floor_price THEN 1.0 ELSE 0 END), 6) AS floor_share FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_orderstatus) AS floor_price FROM orders) GROUP BY ALL")
def floor_share(spark: SparkSession, d: str) -> DataFrame:
    orders = T(spark, d, "orders")
    least = orders.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("floor_price"))
    return rounded(orders.join(least, "o_orderstatus").groupBy("o_orderstatus").agg(F.avg((F.col("o_totalprice") == F.col("floor_price")).cast("int")).alias("floor_share")), 6)


@query("SELECT o_orderkey, round(least(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)), 4) AS price FROM orders")
def clip_to_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.capped(T(spark, d, "orders"), "o_totalprice", 0.95, "price").select("o_orderkey", "price"), 4)


@query("SELECT g.x, round(avg(exp(-power((g.x - v) / 500.0, 2) / 2)) / (500.0 * sqrt(2 * pi())), 9) AS density FROM (SELECT unnest([0.0, 2500.0, 5000.0, 7500.0])::DOUBLE AS x) g CROSS JOIN (SELECT c_acctbal AS v FROM customer) GROUP BY ALL")
def kernel_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.kernel_density(T(spark, d, "customer"), "c_acctbal", [0.0, 2500.0, 5000.0, 7500.0], 500.0), 9)
