"""Queries of dynamic arrays, lookups, matrices, ranks and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import arrays, lookup, ranking
from tabulon.plans.registry import query, r, rs
from tabulon.sources.tables import cells, table


@query("filter_sort_topk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def filter_sort_topk(spark, folder):
    kept = arrays.filter_rows(table(spark, folder, "orders"), F.col("o_orderstatus") == "O")
    return arrays.sort(kept, "-o_totalprice", tie="o_orderkey").select("o_orderkey", "o_totalprice").limit(25)


@query("unique_brand", "SELECT DISTINCT p_brand, p_type FROM part")
def unique_brand(spark, folder):
    return arrays.unique(table(spark, folder, "part"), columns=["p_brand", "p_type"], order="p_partkey")


@query("unique_once", "SELECT c_acctbal FROM customer GROUP BY 1 HAVING count(*) = 1")
def unique_once(spark, folder):
    return arrays.unique(table(spark, folder, "customer").select("c_acctbal"), exactly_once=True)


@query("take_last", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey DESC LIMIT 7")
def take_last(spark, folder):
    return arrays.take(table(spark, folder, "supplier"), "s_suppkey", -7, 2)


@query("drop_first_last", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 5) AND s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY 1 DESC LIMIT 3)")
def drop_first_last(spark, folder):
    df = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    return arrays.drop(arrays.drop(df, "s_suppkey", 5), "s_suppkey", -3)


@query("expand_rows", "SELECT g::BIGINT AS position, r_regionkey, coalesce(r_name, '-') AS r_name, CASE WHEN r_regionkey IS NULL THEN '#N/A' END AS row_error FROM range(1, 9) t(g) LEFT JOIN region ON r_regionkey = g - 1")
def expand_rows(spark, folder):
    return arrays.expand(table(spark, folder, "region"), "r_regionkey", 8, {"r_name": "-"})


@query("vstack_union", "SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def vstack_union(spark, folder):
    a = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return arrays.vstack(a, b)


@query("hstack_regions", "SELECT row_number() OVER (ORDER BY n_nationkey) AS position, n_nationkey, r_regionkey, r_name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def hstack_regions(spark, folder):
    return arrays.hstack(table(spark, folder, "nation").select("n_nationkey"), "n_nationkey", table(spark, folder, "region"), "r_regionkey")


@query("tocol_nation", 'SELECT n_nationkey, 0 AS "column", n_name AS value FROM nation UNION ALL SELECT n_nationkey, 1, n_regionkey::VARCHAR FROM nation')
def tocol_nation(spark, folder):
    return arrays.to_column(table(spark, folder, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


@query("torow_region", "SELECT list(r_name ORDER BY r_regionkey) AS value FROM region")
def torow_region(spark, folder):
    return arrays.to_row(table(spark, folder, "region"), "r_regionkey", ["r_name"])


@query(
    "wraprows_nation",
    """WITH p AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation)
    SELECT k // 4 AS "row", max(n_name) FILTER (WHERE k % 4 = 0) AS c1, max(n_name) FILTER (WHERE k % 4 = 1) AS c2, max(n_name) FILTER (WHERE k % 4 = 2) AS c3, max(n_name) FILTER (WHERE k % 4 = 3) AS c4 FROM p GROUP BY 1""",
)
def wraprows_nation(spark, folder):
    return arrays.wrap_rows(table(spark, folder, "nation"), "n_nationkey", "n_name", 4)


@query(
    "wrapcols_nation",
    """WITH p AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation)
    SELECT k % 10 AS "row", max(n_name) FILTER (WHERE k // 10 = 0) AS c1, max(n_name) FILTER (WHERE k // 10 = 1) AS c2, max(n_name) FILTER (WHERE k // 10 = 2) AS c3 FROM p GROUP BY 1""",
)
def wrapcols_nation(spark, folder):
    return arrays.wrap_columns(table(spark, folder, "nation"), "n_nationkey", "n_name", 10, 3)


@query("chooserows_region", "SELECT r.* FROM (VALUES (5), (1), (1)) v(p) JOIN region r ON r_regionkey = p - 1")
def chooserows_region(spark, folder):
    return arrays.choose_rows(table(spark, folder, "region"), "r_regionkey", [5, 1, 1])


@query("choosecols_orders", "SELECT o_orderpriority, o_orderkey FROM orders")
def choosecols_orders(spark, folder):
    return arrays.choose_columns(table(spark, folder, "orders"), [-1, 1])


@query(
    "transpose_flags",
    """WITH g AS (SELECT l_returnflag AS f, sum(l_quantity) AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), u AS (SELECT f, 'q' AS "column", q AS v FROM g UNION ALL SELECT f, 'n', n FROM g)
    SELECT "column", max(v) FILTER (WHERE f = 'A') AS "A", max(v) FILTER (WHERE f = 'N') AS "N", max(v) FILTER (WHERE f = 'R') AS "R" FROM u GROUP BY 1""",
)
def transpose_flags(spark, folder):
    g = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"))
    return arrays.transpose(g, "l_returnflag", ["A", "N", "R"])


@query(
    "xmatch_sizes",
    "SELECT p_partkey, list_position([5, 10, 20, 40], p_size)::BIGINT AS exact, nullif(list_position([5, 10, 20, 40], list_max(list_filter([5, 10, 20, 40], lambda x: x <= p_size))), 0)::BIGINT AS below, "
    "nullif(list_position([5, 10, 20, 40], list_min(list_filter([5, 10, 20, 40], lambda x: x >= p_size))), 0)::BIGINT AS above FROM part",
)
def xmatch_sizes(spark, folder):
    df = table(spark, folder, "part").withColumn("edges", F.array(*map(F.lit, (5, 10, 20, 40))))
    at = lambda mode: arrays.xmatch(df, F.col("p_size"), "edges", mode)
    return df.select("p_partkey", at(0).alias("exact"), at(-1).alias("below"), at(1).alias("above"))


# -- lookups -------------------------------------------------------------------------------------------------------


@query("xlookup_customer_nation", "SELECT c_custkey, coalesce(n_name, 'none') AS n_name, CASE WHEN n_name IS NULL THEN '#N/A' END AS lookup_error FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey")
def xlookup_customer_nation(spark, folder):
    nation = table(spark, folder, "nation").where("n_nationkey < 20")
    found = lookup.xlookup(table(spark, folder, "customer"), "c_nationkey", nation, "n_nationkey", ["n_name"], if_not_found={"n_name": "none"})
    return found.select("c_custkey", "n_name", "lookup_error")


@query("xlookup_first_order", "SELECT c_custkey, f.o_orderkey, f.o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) f ON c_custkey = o_custkey")
def xlookup_first_order(spark, folder):
    found = lookup.xlookup(table(spark, folder, "customer"), "c_custkey", table(spark, folder, "orders"), "o_custkey", ["o_orderkey", "o_totalprice"], order="o_orderkey")
    return found.select("c_custkey", "o_orderkey", "o_totalprice")


@query("vlookup_exact", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def vlookup_exact(spark, folder):
    return lookup.vlookup_exact(table(spark, folder, "supplier"), "s_nationkey", table(spark, folder, "nation"), 2).select("s_suppkey", "n_name")


_BANDS = [(900.0, "low"), (1200.0, "middle"), (1600.0, "high")]


@query(
    "vlookup_approx_price_band",
    "SELECT p_partkey, CASE WHEN p_retailprice >= 1600 THEN 'high' WHEN p_retailprice >= 1200 THEN 'middle' WHEN p_retailprice >= 900 THEN 'low' END AS band, CASE WHEN p_retailprice < 900 THEN '#N/A' END AS lookup_error FROM part",
)
def vlookup_approx_price_band(spark, folder):
    bands = spark.createDataFrame(_BANDS, "start double, band string")
    return lookup.vlookup_approximate(table(spark, folder, "part"), "p_retailprice", bands, 2).select("p_partkey", "band", "lookup_error")


@query(
    "asof_last_order",
    """WITH d AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS last_key FROM orders GROUP BY 1, 2)
    SELECT e.event_id, d.last_key FROM (SELECT event_id, user_id, ts - INTERVAL 9000 DAY AS at FROM events) e ASOF LEFT JOIN d ON e.user_id = d.o_custkey AND e.at >= d.o_orderdate""",
)
def asof_last_order(spark, folder):
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    events = table(spark, folder, "events").select("event_id", F.col("user_id").alias("who"), (seconds("ts") - 9000 * 86400).alias("at"))
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("who"), seconds("o_orderdate").alias("day")).agg(F.max("o_orderkey").alias("last_key"))
    return lookup.asof(events, "at", orders, "day", ["last_key"], by=["who"]).select("event_id", "last_key")


@query("lookup_below_above", "WITH s AS (SELECT DISTINCT s_acctbal AS k FROM supplier) SELECT c_custkey, (SELECT max(k) FROM s WHERE k <= c_acctbal) AS below, (SELECT min(k) FROM s WHERE k >= c_acctbal) AS above FROM customer")
def lookup_below_above(spark, folder):
    keys = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("below")).distinct()
    left = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    one = lookup.asof(left, "c_acctbal", keys, "below", ["below"]).drop("lookup_error")
    two = lookup.asof(one, "c_acctbal", keys.withColumnRenamed("below", "above"), "above", ["above"], direction="forward")
    return two.select("c_custkey", "below", "above")


@query("match_exact", "SELECT c_custkey, position FROM customer LEFT JOIN (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS position FROM nation WHERE n_nationkey >= 3) ON c_nationkey = n_nationkey")
def match_exact(spark, folder):
    nation = table(spark, folder, "nation").where("n_nationkey >= 3")
    return lookup.match(table(spark, folder, "customer"), "c_nationkey", nation, "n_nationkey", "n_nationkey").select("c_custkey", "position")


@query("match_approx", "WITH p AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_acctbal) AS position FROM (SELECT DISTINCT s_acctbal FROM supplier)) SELECT c_custkey, (SELECT max(position) FROM p WHERE s_acctbal <= c_acctbal) AS position FROM customer")
def match_approx(spark, folder):
    keys = table(spark, folder, "supplier").select("s_acctbal").distinct()
    return lookup.match(table(spark, folder, "customer"), "c_acctbal", keys, "s_acctbal", "s_acctbal", mode=1).select("c_custkey", "position")


@query("semi_anti_orders", "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti_orders(spark, folder):
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    a = lookup.matched(c, "c_custkey", o, "o_custkey").agg(F.lit("with").alias("kind"), F.count("*").alias("n"))
    return a.unionByName(lookup.unmatched(c, "c_custkey", o, "o_custkey").agg(F.lit("without").alias("kind"), F.count("*").alias("n")))


@query("index_row", "SELECT o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 99")
def index_row(spark, folder):
    return lookup.index(table(spark, folder, "orders"), "o_orderkey", 100, 4)


@query("rows_columns_address", "SELECT (SELECT count(*) FROM nation) AS rows_, 3 AS columns_, '$AB$7' AS a1, 'R[7]C28' AS r1c1")
def rows_columns_address(spark, folder):
    n = table(spark, folder, "nation")
    return n.agg(
        F.count("*").alias("rows_"), F.lit(len(n.columns)).alias("columns_"),
        F.first(lookup.address(F.lit(7), F.lit(28))).alias("a1"), F.first(lookup.address(F.lit(7), F.lit(28), 3, False)).alias("r1c1"),
    )


@query(
    "mmult_flags",
    """WITH a AS (SELECT l_linenumber AS i, l_suppkey % 7 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT s_suppkey % 7 AS k, s_nationkey AS j, sum(s_acctbal) AS v FROM supplier GROUP BY 1, 2)
    SELECT i::BIGINT AS i, j::BIGINT AS j, """ + rs("sum(a.v * b.v) / 1e6", 3) + " AS v FROM a JOIN b USING (k) GROUP BY 1, 2",
)
def mmult_flags(spark, folder):
    li, su = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    a = li.groupBy(F.col("l_linenumber").cast("bigint").alias("i"), (F.col("l_suppkey") % 7).alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = su.groupBy((F.col("s_suppkey") % 7).alias("i"), F.col("s_nationkey").cast("bigint").alias("j")).agg(F.sum("s_acctbal").alias("v"))
    b = b.select("i", "j", "v")
    return arrays.mmult(a, b).select("i", "j", r(F.col("v") / 1e6, 3).alias("v"))


@query("cell_relation", "SELECT 'nation' AS sheet, n_nationkey::BIGINT AS \"row\", c AS col, CASE c WHEN 1 THEN n_name ELSE n_regionkey::VARCHAR END AS value FROM nation, (VALUES (1), (2)) t(c)")
def cell_relation(spark, folder):
    return cells(table(spark, folder, "nation"), "nation", "n_nationkey", ["n_name", "n_regionkey"])


# -- ranks ---------------------------------------------------------------------------------------------------------


@query(
    "rank_eq_avg",
    "SELECT p_partkey, rank() OVER w AS rank_eq, rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank_avg FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)",
)
def rank_eq_avg(spark, folder):
    out = ranking.rank(table(spark, folder, "part"), "p_size", ["p_brand"])
    return out.select("p_partkey", "rank_eq", F.col("rank_avg").cast("double"))


@query("percentrank", f"SELECT p_partkey, {rs('percent_rank() OVER (PARTITION BY p_type ORDER BY p_size)', 6)} AS percent_rank FROM part")
def percentrank(spark, folder):
    return ranking.percent_rank(table(spark, folder, "part"), "p_size", ["p_type"]).select("p_partkey", r(F.col("percent_rank"), 6).alias("percent_rank"))


@query("percentrank_exc", f"SELECT p_partkey, {rs('(rank() OVER (PARTITION BY p_type ORDER BY p_size)) / (count(*) OVER (PARTITION BY p_type) + 1)', 6)} AS percent_rank FROM part")
def percentrank_exc(spark, folder):
    return ranking.percent_rank(table(spark, folder, "part"), "p_size", ["p_type"], exclusive=True).select("p_partkey", r(F.col("percent_rank"), 6).alias("percent_rank"))


@query("large_small", "SELECT p_brand, (list_sort(list(p_size), 'DESC'))[3] AS large3, (list_sort(list(p_size)))[2] AS small2 FROM part GROUP BY 1")
def large_small(spark, folder):
    df = table(spark, folder, "part")
    a = ranking.nth(df, "p_size", 3, ["p_brand"]).withColumnRenamed("value", "large3")
    return a.join(ranking.nth(df, "p_size", 2, ["p_brand"], largest=False).withColumnRenamed("value", "small2"), "p_brand")


@query(
    "trimmean",
    f"WITH k AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, {rs('avg(o_totalprice)', 2)} AS trim_mean FROM k WHERE i >= floor(n * 0.2 / 2) AND i < n - floor(n * 0.2 / 2) GROUP BY 1",
)
def trimmean(spark, folder):
    return ranking.trim_mean(table(spark, folder, "orders"), "o_totalprice", 0.2, ["o_orderpriority"]).select("o_orderpriority", r(F.col("trim_mean"), 2).alias("trim_mean"))


@query("modes", "WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_size AS mode, n FROM c QUALIFY n = max(n) OVER (PARTITION BY p_brand) AND n > 1")
def modes(spark, folder):
    return ranking.modes(table(spark, folder, "part"), "p_size", ["p_brand"])


@query("avedev", f"SELECT o_orderstatus, {rs('avg(abs(o_totalprice - m))', 2)} AS avedev FROM (SELECT o_orderstatus, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m FROM orders) GROUP BY 1")
def avedev(spark, folder):
    return ranking.mean_deviation(table(spark, folder, "orders"), "o_totalprice", ["o_orderstatus"]).select("o_orderstatus", r(F.col("avedev"), 2).alias("avedev"))


@query(
    "frequency_histogram",
    "SELECT bin, count(l_quantity) AS n FROM (VALUES (0), (1), (2), (3), (4)) t(bin) LEFT JOIN lineitem ON bin = CASE WHEN l_quantity <= 0 THEN 0 WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END GROUP BY 1",
)
def frequency_histogram(spark, folder):
    return ranking.frequency(table(spark, folder, "lineitem"), "l_quantity", [40, 10, 25, 0])


@query(
    "percentiles",
    f"SELECT o_orderstatus, {rs('quantile_cont(o_totalprice, 0.3)', 3)} AS p30, {rs('quantile_cont(o_totalprice, 0.75)', 3)} AS q3, mode(o_orderpriority) IS NOT NULL AS has_mode FROM orders GROUP BY 1",
)
def percentiles(spark, folder):
    from tabulon.functions.registry import value

    return table(spark, folder, "orders").groupBy("o_orderstatus").agg(
        r(value("PERCENTILE.INC", "o_totalprice", 0.3), 3).alias("p30"), r(value("QUARTILE", "o_totalprice", 3), 3).alias("q3"), F.mode("o_orderpriority").isNotNull().alias("has_mode")
    )
