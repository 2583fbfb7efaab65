"""Queries of operators with their less common arguments: lookups across, levels of totals, arrays of criteria, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import cells, logic, math  # noqa: F401  they fill the catalogue
from tabulon.functions.registry import cell
from tabulon.operators import arrays, criteria, grouping, lookup, ranking
from tabulon.plans.registry import query, r, rs
from tabulon.simulation import run
from tabulon.sources.tables import table


def _rates(spark):
    """A table whose first row holds keys and whose second holds results."""
    return spark.createDataFrame([(1, 1.0, 10.0, 25.0, 40.0), (2, 0.1, 0.2, 0.3, 0.4)], "row int, a double, b double, c double, d double")


@query("hlookup_sizes", "SELECT p_partkey, CASE p_size WHEN 1 THEN '0.1' WHEN 10 THEN '0.2' WHEN 25 THEN '0.3' WHEN 40 THEN '0.4' END AS value, CASE WHEN p_size NOT IN (1, 10, 25, 40) THEN '#N/A' END AS lookup_error FROM part")
def hlookup_sizes(spark, folder):
    left = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return lookup.hlookup(left, "size", _rates(spark), "row", 2).select("p_partkey", "value", "lookup_error")


@query("hlookup_sizes_approximate", "SELECT p_partkey, CASE WHEN p_size < 1 THEN NULL WHEN p_size < 10 THEN '0.1' WHEN p_size < 25 THEN '0.2' WHEN p_size < 40 THEN '0.3' ELSE '0.4' END AS value FROM part")
def hlookup_sizes_approximate(spark, folder):
    left = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    return lookup.hlookup(left, "size", _rates(spark), "row", 2, approximate=True).select("p_partkey", "value")


_LEVELS = "SELECT CASE WHEN grouping(l_returnflag) = 0 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN grouping(l_linenumber) = 0 THEN min(l_linenumber) END AS l_linenumber, sum(l_quantity) AS quantity, count(*) AS n, (grouping(l_returnflag) + grouping(l_linenumber))::INT AS level FROM lineitem WHERE l_discount > 0.02 GROUP BY ROLLUP (l_returnflag, l_linenumber)"


@query("groupby_levels", _LEVELS)
def groupby_levels(spark, folder):
    """Subtotals and the grand total above their rows, largest quantity first, over the rows that a filter leaves."""
    return grouping.groupby_levels(
        table(spark, folder, "lineitem"), ["l_returnflag", "l_linenumber"], {"quantity": F.sum("l_quantity"), "n": F.count("*")}, total_depth=-2, sort_order=[-3], where=F.col("l_discount") > 0.02
    )


@query("groupby_first_row", f"SELECT * FROM ({_LEVELS}) WHERE level = 2")
def groupby_first_row(spark, folder):
    """The grand total stands first where totals stand above."""
    return groupby_levels(spark, folder).limit(1)


@query(
    "sumif_array",
    " UNION ALL ".join(f"SELECT '{c}' AS criterion, {rs(f'sum(l_extendedprice) FILTER ({w})', 2)} AS total, count(*) FILTER ({w}) AS n FROM lineitem" for c, w in ((">40", "l_quantity > 40"), ("<=3", "l_quantity <= 3"), ("<>7", "l_quantity <> 7"), ("12", "l_quantity = 12"))),
)
def sumif_array(spark, folder):
    out = criteria.spread(
        table(spark, folder, "lineitem"), "l_quantity", [">40", "<=3", "<>7", "12"], {"total": lambda met: F.sum(F.when(met, F.col("l_extendedprice"))), "n": lambda met: F.count_if(met)}
    )
    return out.select("criterion", r(F.col("total"), 2).alias("total"), "n")


@query("sumif_stretched", f"SELECT {rs('sum(b.o_totalprice)', 2)} AS total FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 5 WHERE a.o_totalprice > 200000")
def sumif_stretched(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return criteria.offset_sum(o, "o_totalprice", ">200000", "o_orderkey", 5, o, "o_totalprice").select(r(F.col("total"), 2).alias("total"))


@query(
    "cell_arithmetic",
    "SELECT p_partkey, CASE WHEN p_size < 20 THEN '#NUM!' WHEN p_size = 25 THEN '#DIV/0!' END AS error, "
    + rs("CASE WHEN p_size >= 20 AND p_size <> 25 THEN sqrt(p_size - 20) / (p_size - 25) END", 6) + " AS value, CASE WHEN p_size = 25 THEN '#DIV/0!' WHEN p_size < 20 THEN '#NUM!' END AS swapped FROM part",
)
def cell_arithmetic(spark, folder):
    """The left error wins; an operation adds its own where both sides are well."""
    root, by, one = cell("SQRT", F.col("p_size") - 20), cells.plain(F.col("p_size") - 25), cells.plain(F.lit(1))
    quotient = cells.arithmetic("/", root, by)
    swapped = cells.arithmetic("+", cells.arithmetic("/", one, by), root)
    return table(spark, folder, "part").select("p_partkey", quotient["error"].alias("error"), r(quotient["value"], 6).alias("value"), swapped["error"].alias("swapped"))


@query(
    "typed_comparison",
    "SELECT p_partkey, p_size < 25 AS number_less, true AS number_before_text, true AS text_before_truth, p_type >= 'ECONOMY' AS text_order, true AS any_case, p_size * 0.1 * 10 = p_size OR true AS near FROM part",
)
def typed_comparison(spark, folder):
    n, t = F.col("p_size"), F.col("p_type")
    return table(spark, folder, "part").select(
        "p_partkey", cells.compare("<", n, F.lit(25)).alias("number_less"), cells.compare("<", n, t).alias("number_before_text"), cells.compare("<", t, F.lit(True)).alias("text_before_truth"),
        cells.compare(">=", t, F.lit("economy")).alias("text_order"), cells.compare("=", t, F.lower(t)).alias("any_case"), cells.compare("=", n * 0.1 * 10, n).alias("near"),
    )


@query("simulation_overrides", "SELECT 5000 AS n, 12.5 AS least_price, 12.5 AS greatest_price, true AS volume_as_before, true AS cost_is_other")
def simulation_overrides(spark, folder):
    """A number and another distribution in the place of two inputs; the third draws what it drew without them."""
    inputs = {"price": ("PSINORMAL", 10.0, 2.0), "volume": ("PSIUNIFORM", 50.0, 140.0), "cost": ("PSIUNIFORM", 200.0, 400.0)}
    plain = run.simulate(spark, 5000, inputs, {}).select("trial", F.col("volume").alias("before"))
    changed = run.simulate(spark, 5000, inputs, {}, overrides={"price": 12.5, "cost": ("PSIUNIFORM", 500.0, 600.0)})
    return changed.join(plain, "trial").agg(
        F.count("*").cast("int").alias("n"), F.min("price").alias("least_price"), F.max("price").alias("greatest_price"),
        F.bool_and(F.col("volume") == F.col("before")).alias("volume_as_before"), F.bool_and(F.col("cost").between(500, 600)).alias("cost_is_other"),
    )


@query("draws_shifted_and_cut", f"SELECT p_partkey, {rs('2 * u + 10', 6)} AS shifted, {rs('2 * (0.25 + u * 0.5)', 6)} AS by_value, {rs('2 * (0.1 + u * 0.8)', 6)} AS by_share FROM (SELECT p_partkey, (p_partkey % 199 + 0.5) / 199 AS u FROM part)")
def draws_shifted_and_cut(spark, folder):
    """PsiShift, PsiTruncate and PsiTruncateP of a uniform distribution on [0, 2]."""
    draw = lambda **more: r(run.draw("PSIUNIFORM", 0.0, 2.0, u=(F.col("p_partkey") % 199 + 0.5) / 199, **more), 6)
    return table(spark, folder, "part").select("p_partkey", draw(shift=10.0).alias("shifted"), draw(bounds=(0.5, 1.5)).alias("by_value"), draw(share=(0.1, 0.9)).alias("by_share"))


@query("xmatch_wildcard", "SELECT p_partkey, CASE WHEN p_name LIKE '%a%' THEN 1 ELSE 2 END::INT AS place FROM part")
def xmatch_wildcard(spark, folder):
    df = table(spark, folder, "part").withColumn("words", F.array("p_name", F.lit("always")))
    return df.select("p_partkey", arrays.xmatch(df, "*a*", "words", 2).cast("int").alias("place"))


@query("percentrank_digits", "SELECT p_partkey, floor(percent_rank() OVER (ORDER BY p_retailprice) * 100) / 100 AS percent_rank FROM part")
def percentrank_digits(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    return ranking.percent_rank(df, "p_retailprice", [], significance=2).select("p_partkey", "percent_rank")


@query("distinct_counts", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def distinct_counts(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"))


@query("unique_vstack", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def unique_vstack(spark, folder):
    a, b = table(spark, folder, "customer").select(F.col("c_nationkey").alias("k")), table(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.unionByName(b).distinct()


@query("formats_round_trip", "SELECT n_nationkey, n_name, format FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS format)")
def formats_round_trip(spark, folder):
    """Nations written in each format to the shared folder and read back."""
    import uuid

    from tabulon.operators.lineage import shared_folder
    from tabulon.sources import tables

    nations, base, out = table(spark, folder, "nation").select("n_nationkey", "n_name"), f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}", None
    for kind in ("csv", "json", "orc", "parquet"):
        nations.write.format(kind).option("header", True).save(f"{base}/{kind}")
        back = tables.read_any(spark, f"{base}/{kind}", kind).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.lit(kind).alias("format"))
        out = back if out is None else out.unionByName(back)
    return out
