"""Queries of aggregates: plain, coercing, conditional, database, grouped and crossed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.registry import value
from tabulon.operators import database, grouping
from tabulon.plans.registry import query, r, rs
from tabulon.sources.tables import table

_PLAIN = {
    "SUM": "sum(x)", "SUMSQ": "sum(x*x)", "AVERAGE": "avg(x)", "STDEV": "stddev_samp(x)", "STDEVP": "stddev_pop(x)", "VAR": "var_samp(x)", "VARP": "var_pop(x)",
    "MEDIAN": "median(x)", "MIN": "min(x)", "MAX": "max(x)", "DEVSQ": "var_pop(x)*count(x)", "GEOMEAN": "exp(avg(ln(x)))", "HARMEAN": "count(x)/sum(1/x)",
    "SKEW": "skewness(x)", "KURT": "kurtosis(x)",
}


def _alias(name: str) -> str:
    return name.lower().replace(".", "_")


@query(
    "agg_plain",
    "SELECT l_returnflag, l_linestatus, "
    + ", ".join(f"{rs(sql, 3)} AS {_alias(n)}" for n, sql in _PLAIN.items())
    + ", count(x)::BIGINT AS count_, count(*)::BIGINT AS counta FROM (SELECT *, l_quantity AS x FROM lineitem) GROUP BY ALL",
)
def agg_plain(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        *(r(value(n, "l_quantity"), 3).alias(_alias(n)) for n in _PLAIN), value("COUNT", "l_quantity").alias("count_"), value("COUNTA", "l_quantity").alias("counta")
    )


_COERCED = {"AVERAGEA": "avg", "MAXA": "max", "MINA": "min", "STDEVA": "stddev_samp", "STDEVPA": "stddev_pop", "VARA": "var_samp", "VARPA": "var_pop"}


@query(
    "agg_coercing",
    "SELECT l_returnflag, " + ", ".join(f"{rs(f'{f}(x)', 3)} AS {n.lower()}" for n, f in _COERCED.items()) + ", count_if(v IS NULL OR v = '')::BIGINT AS countblank FROM ("
    "SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 'n/a' WHEN l_linenumber = 2 THEN 'TRUE' WHEN l_linenumber = 3 THEN NULL ELSE l_quantity::VARCHAR END AS v,"
    " CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 1 WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS x FROM lineitem) GROUP BY 1",
)
def agg_coercing(spark, folder):
    n = F.col("l_linenumber")
    v = F.when(n == 1, "n/a").when(n == 2, "TRUE").when(n == 3, F.lit(None)).otherwise(F.col("l_quantity").cast("string"))
    df = table(spark, folder, "lineitem").withColumn("v", v)
    return df.groupBy("l_returnflag").agg(*(r(value(n, "v"), 3).alias(n.lower()) for n in _COERCED), value("COUNTBLANK", "v").alias("countblank"))


@query(
    "agg_conditional",
    f"""SELECT {rs("sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R')", 2)} AS sumif,
      {rs("sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 30)", 2)} AS sumifs,
      count(*) FILTER (WHERE l_returnflag <> 'N') AS countif,
      count(*) FILTER (WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_shipdate >= '1997-01-01') AS countifs,
      {rs("avg(l_quantity) FILTER (WHERE l_linestatus = 'O')")} AS averageif,
      {rs("avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O' AND l_discount = 0.05)")} AS averageifs,
      max(l_extendedprice) FILTER (WHERE l_returnflag = 'A' AND l_tax < 0.03) AS maxifs,
      min(l_extendedprice) FILTER (WHERE l_returnflag = 'A' AND l_tax < 0.03) AS minifs,
      {rs("sum(l_extendedprice * (1 - l_discount))", 2)} AS sumproduct,
      {rs("sum(l_quantity * l_quantity - l_linenumber * l_linenumber)", 2)} AS sumx2my2,
      {rs("sum(l_quantity * l_quantity + l_linenumber * l_linenumber)", 2)} AS sumx2py2,
      {rs("sum((l_quantity - l_linenumber) * (l_quantity - l_linenumber))", 2)} AS sumxmy2,
      {rs("sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / sum(l_quantity)", 8)} AS percentof,
      {rs("sum(l_tax) FILTER (WHERE l_quantity BETWEEN 5 AND 9)")} AS prob
    FROM lineitem""",
)
def agg_conditional(spark, folder):
    df = table(spark, folder, "lineitem")
    return df.agg(
        r(value("SUMIF", "l_returnflag", "r", "l_extendedprice"), 2).alias("sumif"),
        r(value("SUMIFS", "l_extendedprice", "l_returnflag", "R", "l_quantity", ">30"), 2).alias("sumifs"),
        value("COUNTIF", "l_returnflag", "<>N").alias("countif"),
        value("COUNTIFS", "l_quantity", ">=10", "l_quantity", "<=20", "l_shipdate", ">=1997-01-01").alias("countifs"),
        r(value("AVERAGEIF", "l_linestatus", "O", "l_quantity")).alias("averageif"),
        r(value("AVERAGEIFS", "l_extendedprice", "l_linestatus", "O", "l_discount", 0.05)).alias("averageifs"),
        value("MAXIFS", "l_extendedprice", "l_returnflag", "A", "l_tax", "<0.03").alias("maxifs"),
        value("MINIFS", "l_extendedprice", "l_returnflag", "A", "l_tax", "<0.03").alias("minifs"),
        r(value("SUMPRODUCT", "l_extendedprice", 1 - F.col("l_discount")), 2).alias("sumproduct"),
        *(r(value(n, "l_quantity", "l_linenumber"), 2).alias(n.lower()) for n in ("SUMX2MY2", "SUMX2PY2", "SUMXMY2")),
        r(value("PERCENTOF", "l_quantity", F.col("l_returnflag") == "R"), 8).alias("percentof"),
        r(value("PROB", "l_quantity", "l_tax", 5, 9)).alias("prob"),
    )


@query(
    "countif_wildcard",
    "SELECT count_if(p_name ILIKE 'small%') AS starts, count_if(p_name ILIKE '%ring') AS ends_, count_if(p_name ILIKE '_ed %') AS marks, count_if(p_name NOT ILIKE '%widget%') AS others FROM part",
)
def countif_wildcard(spark, folder):
    df = table(spark, folder, "part")
    return df.agg(*(value("COUNTIF", "p_name", c).alias(a) for a, c in {"starts": "SMALL*", "ends_": "*ring", "marks": "?ed *", "others": "<>*widget*"}.items()))


_CODES = {1: "avg(x)", 2: "count(x)", 3: "count(*)", 4: "max(x)", 5: "min(x)", 7: "stddev_samp(x)", 8: "stddev_pop(x)", 9: "sum(x)", 10: "var_samp(x)", 11: "var_pop(x)"}


@query(
    "subtotal_aggregate",
    "SELECT p_brand, " + ", ".join(f"{rs(s, 3)} AS sub{k}" for k, s in _CODES.items()) + f", {rs('median(x)', 3)} AS agg12, {rs('quantile_cont(x, 0.9)', 3)} AS agg16 FROM (SELECT *, p_size::DOUBLE AS x FROM part) GROUP BY 1",
)
def subtotal_aggregate(spark, folder):
    return table(spark, folder, "part").groupBy("p_brand").agg(
        *(r(value("SUBTOTAL", k if k % 2 else 100 + k, "p_size").cast("double"), 3).alias(f"sub{k}") for k in _CODES),
        r(value("AGGREGATE", 12, 4, "p_size"), 3).alias("agg12"),
        r(value("AGGREGATE", 16, 6, "p_size", 0.9), 3).alias("agg16"),
    )


_DB = {"dsum": "sum", "dcount": "count", "dmax": "max", "dmin": "min", "daverage": "avg", "dstdev": "stddev_samp", "dvar": "var_samp", "dstdevp": "stddev_pop", "dvarp": "var_pop"}


@query(
    "database_functions",
    "SELECT " + ", ".join(f"{rs(f'{f}(o_totalprice)', 2)} AS {a}" for a, f in _DB.items()) + ", count(o_orderpriority) AS dcounta, NULL::DOUBLE AS dproduct FROM orders"
    " WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderpriority ILIKE '1-%' AND o_orderstatus <> 'P')",
)
def database_functions(spark, folder):
    criteria = [{"o_orderstatus": "F", "o_totalprice": ">200000"}, {"o_orderpriority": "1-*", "o_orderstatus": "<>P", "o_totalprice": ""}]
    out = database.database(
        table(spark, folder, "orders"),
        {**{a: (a.upper(), "O_TotalPrice") for a in _DB}, "dcounta": ("DCOUNTA", 6), "dproduct": ("DPRODUCT", "o_totalprice")},
        criteria,
    )
    # The product of thousands of prices is beyond a double.
    return out.select(*(r(F.col(a).cast("double"), 2).alias(a) for a in _DB), "dcounta", F.when(F.col("dproduct") < float("inf"), F.col("dproduct")).alias("dproduct"))


@query("dget", "SELECT s_name AS value, NULL::VARCHAR AS error FROM supplier WHERE s_suppkey = 7")
def dget(spark, folder):
    return database.dget(table(spark, folder, "supplier"), "s_name", [{"s_suppkey": 7}])


_REVENUE = "sum(l_extendedprice * (1 - l_discount))"


def _revenue():
    return r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)


@query("groupby_total_row", f"SELECT lower(l_returnflag) AS l_returnflag, {rs(_REVENUE, 2)} AS revenue, count(*) AS n, grouping(lower(l_returnflag)) = 1 AS is_total FROM lineitem WHERE l_quantity > 5 GROUP BY GROUPING SETS ((lower(l_returnflag)), ())")
def groupby_total_row(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("l_returnflag", F.lower("l_returnflag"))
    return grouping.groupby(df, ["l_returnflag"], {"revenue": _revenue(), "n": F.count("*")}, total=True, where=F.col("l_quantity") > 5)


@query("groupby_flag", f"SELECT l_returnflag, l_linestatus, {rs(_REVENUE, 2)} AS revenue FROM lineitem GROUP BY 1, 2")
def groupby_flag(spark, folder):
    return grouping.groupby(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], {"revenue": _revenue()})


@query(
    "pivotby_totals",
    f"""WITH g AS (SELECT o_orderpriority, o_orderstatus, {rs("sum(o_totalprice)", 2)} AS v, grouping(o_orderpriority) AS t, grouping(o_orderstatus) AS c
      FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY CUBE (o_orderpriority, o_orderstatus))
    SELECT o_orderpriority, t = 1 AS is_total, max(v) FILTER (WHERE o_orderstatus = 'F') AS "F", max(v) FILTER (WHERE o_orderstatus = 'O') AS "O",
      max(v) FILTER (WHERE o_orderstatus = 'P') AS "P", max(v) FILTER (WHERE c = 1) AS "Total" FROM g GROUP BY 1, 2""",
)
def pivotby_totals(spark, folder):
    return grouping.pivotby(table(spark, folder, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], r(F.sum("o_totalprice"), 2), totals=True)


@query("get_pivot_data", f"SELECT {rs('sum(o_totalprice)', 2)} AS value FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def get_pivot_data(spark, folder):
    pivot = grouping.pivotby(table(spark, folder, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], r(F.sum("o_totalprice"), 2))
    return grouping.get_pivot_data(pivot, {"o_orderpriority": "1-urgent"}, "F")


@query(
    "rollup_region_nation",
    f"SELECT r_name, n_name, {rs('sum(c_acctbal)', 2)} AS balance, count(*) AS n, grouping(r_name, n_name)::BIGINT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def rollup_region_nation(spark, folder):
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return grouping.subtotals(joined, ["r_name", "n_name"], {"balance": r(F.sum("c_acctbal"), 2), "n": F.count("*")})
