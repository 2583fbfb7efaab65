"""Queries of financial functions over customers, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import finance
from tabulon.functions.registry import value
from tabulon.plans.registry import query, r, rs, scalars
from tabulon.sources.tables import spread, table

_RATE, _N, _PV = "(0.02 + c_nationkey / 1000)", "(12 + c_custkey % 48)", "(10000 + c_acctbal)"


def _args():
    return 0.02 + F.col("c_nationkey") / 1000, 12 + F.col("c_custkey") % 48, 10000 + F.col("c_acctbal")


_G = f"power(1 + {_RATE}, {_N})"
_PMT = f"(-{_PV} * {_G} * {_RATE} / ({_G} - 1))"


def _owed(k: str) -> str:
    """What is owed after k payments."""
    return f"(-({_PV} * power(1 + {_RATE}, {k}) + {_PMT} * (power(1 + {_RATE}, {k}) - 1) / {_RATE}))"


def _call(name, *extra, digits=4):
    def make():
        rate, n, pv = _args()
        return r(value(name, *(f(rate, n, pv) for f in extra)), digits)

    return make


_r, _n, _pv = (lambda a, b, c: a), (lambda a, b, c: b), (lambda a, b, c: c)


def _k(x):
    return lambda *_: x


scalars(
    "annuities",
    "customer",
    ["c_custkey"],
    {
        "pmt": (_call("PMT", _r, _n, _pv), rs(_PMT)),
        "pmt_zero": (_call("PMT", _k(0.0), _n, _pv), rs(f"-{_PV} / {_N}")),
        "fv": (_call("FV", _r, _n, _k(-100.0)), rs(f"100 * ({_G} - 1) / {_RATE}", 4)),
        "pv": (_call("PV", _r, _n, _k(-100.0)), rs(f"100 * (1 - 1 / {_G}) / {_RATE}")),
        "pv_due": (_call("PV", _r, _n, _k(-100.0), _k(0.0), _k(1)), rs(f"100 * (1 + {_RATE}) * (1 - 1 / {_G}) / {_RATE}")),
        "nper": (_call("NPER", _r, _k(-1500.0), _pv), rs(f"CASE WHEN 1500 > {_PV} * {_RATE} THEN ln(1500 / (1500 - {_PV} * {_RATE})) / ln(1 + {_RATE}) END")),
        "ipmt": (_call("IPMT", _r, _k(5), _n, _pv), rs(f"{_owed('4')} * {_RATE}")),
        "ppmt": (_call("PPMT", _r, _k(5), _n, _pv), rs(f"{_PMT} - {_owed('4')} * {_RATE}")),
        "cumprinc": (_call("CUMPRINC", _r, _n, _pv, _k(1), _k(6)), rs(f"-({_PV} + {_owed('6')})")),
        "cumipmt": (_call("CUMIPMT", _r, _n, _pv, _k(1), _k(6)), rs(f"6 * {_PMT} + ({_PV} + {_owed('6')})")),
        "ispmt": (_call("ISPMT", _r, _k(3), _n, _pv), rs(f"{_PV} * {_RATE} * (3 / {_N} - 1)")),
        "effect": (_call("EFFECT", _r, _k(12), digits=8), rs(f"power(1 + {_RATE} / 12, 12) - 1", 8)),
        "nominal": (_call("NOMINAL", _r, _k(12), digits=8), rs(f"12 * (power(1 + {_RATE}, 1 / 12) - 1)", 8)),
        "rri": (_call("RRI", _n, _k(100.0), _k(250.0), digits=8), rs(f"power(2.5, 1 / {_N}) - 1", 8)),
        "pduration": (_call("PDURATION", _r, _k(100.0), _k(250.0)), rs(f"ln(2.5) / ln(1 + {_RATE})")),
    },
)

_COST, _LIFE = "(p_retailprice * 10)", "(5 + p_size % 6)"


def _asset(name, *extra):
    return lambda: r(value(name, F.col("p_retailprice") * 10, F.col("p_retailprice"), 5 + F.col("p_size") % 6, *extra))


scalars(
    "depreciation",
    "part",
    ["p_partkey"],
    {
        "sln": (_asset("SLN"), rs(f"({_COST} - p_retailprice) / {_LIFE}")),
        "syd": (_asset("SYD", 2), rs(f"({_COST} - p_retailprice) * ({_LIFE} - 1) * 2 / ({_LIFE} * ({_LIFE} + 1))")),
        "db": (_asset("DB", 1), rs(f"{_COST} * round(1 - power(0.1, 1 / {_LIFE}), 3)")),
        "ddb": (_asset("DDB", 2, 2.0), rs(f"greatest(greatest({_COST} * (1 - 2 / {_LIFE}), p_retailprice) - greatest({_COST} * power(1 - 2 / {_LIFE}, 2), p_retailprice), 0)")),
        "vdb": (_asset("VDB", 0, 1, 2.0, 0), rs(f"{_COST} * 2 / {_LIFE}")),
        "dollarde": (lambda: r(value("DOLLARDE", 1 + F.col("p_size") % 16 / 100, 16), 6), rs("1 + (p_size % 16) / 16", 6)),
        "dollarfr": (lambda: r(value("DOLLARFR", 1 + F.col("p_size") % 16 / 16, 16), 6), rs("1 + (p_size % 16) / 100", 6)),
    },
)

_A = "o_orderdate"
_DAYS = "date_diff('day', o_orderdate, o_orderdate + INTERVAL 120 DAY)"


def _security(name, *extra):
    return lambda: r(value(name, F.col(_A), F.date_add(F.col(_A).cast("date"), 120), *extra), 6)


scalars(
    "discounted_securities",
    "orders",
    ["o_orderkey"],
    {
        "disc": (_security("DISC", 97.0, 100.0, 2), rs(f"0.03 / ({_DAYS} / 360)", 6)),
        "pricedisc": (_security("PRICEDISC", 0.05, 100.0, 2), rs(f"100 * (1 - 0.05 * {_DAYS} / 360)", 6)),
        "yielddisc": (_security("YIELDDISC", 97.0, 100.0, 3), rs(f"(100 / 97 - 1) / ({_DAYS} / 365)", 6)),
        "intrate": (_security("INTRATE", 97.0, 100.0, 2), rs(f"(3 / 97) / ({_DAYS} / 360)", 6)),
        "received": (_security("RECEIVED", 97.0, 0.05, 2), rs(f"97 / (1 - 0.05 * {_DAYS} / 360)", 6)),
        "accrintm": (_security("ACCRINTM", 0.06, 1000.0, 3), rs(f"1000 * 0.06 * {_DAYS} / 365", 6)),
        "tbillprice": (_security("TBILLPRICE", 0.05), rs(f"100 * (1 - 0.05 * {_DAYS} / 360)", 6)),
        "tbillyield": (_security("TBILLYIELD", 98.0), rs(f"2 / 98 * 360 / {_DAYS}", 6)),
        "tbilleq": (_security("TBILLEQ", 0.05), rs(f"365 * 0.05 / (360 - 0.05 * {_DAYS})", 6)),
    },
)


@query("bonds")
def bonds(spark, folder):
    """Prices, yields that give them back, durations and coupon dates of bonds that settle on order dates."""
    a, b = F.col("o_orderdate"), F.add_months(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60 + 7).cast("int"))
    rate, yld = 0.03 + F.col("o_custkey") % 5 / 100, 0.02 + F.col("o_custkey") % 7 / 100
    df = table(spark, folder, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), rate.alias("rate"), yld.alias("yld"))
    priced = df.withColumn("price", value("PRICE", F.col("a"), F.col("b"), F.col("rate"), F.col("yld"), 100.0, 2))
    return priced.select(
        "o_orderkey",
        "price",
        value("YIELD", F.col("a"), F.col("b"), F.col("rate"), F.col("price"), 100.0, 2).alias("yield_back"),
        "yld",
        value("DURATION", F.col("a"), F.col("b"), F.col("rate"), F.col("yld"), 2).alias("duration"),
        value("MDURATION", F.col("a"), F.col("b"), F.col("rate"), F.col("yld"), 2).alias("mduration"),
        *(value(n, F.col("a"), F.col("b"), 2).alias(n.lower()) for n in ("COUPNUM", "COUPPCD", "COUPNCD", "COUPDAYBS", "COUPDAYS", "COUPDAYSNC")),
        value("PRICEMAT", F.col("a"), F.col("b"), F.add_months(F.col("a"), -3), F.col("rate"), F.col("yld")).alias("pricemat"),
        value("ODDLPRICE", F.col("a"), F.col("b"), F.add_months(F.col("a"), -3), F.col("rate"), F.col("yld"), 100.0, 2).alias("oddlprice"),
        value("ODDFPRICE", F.col("a"), F.col("b"), F.add_months(F.col("a"), -2), F.add_months(F.col("a"), 4), F.col("rate"), F.col("yld"), 100.0, 2).alias("oddfprice"),
    )


@query(
    "npv_by_order",
    f"SELECT l_orderkey, {rs('sum(v / power(1.05, k))')} AS npv FROM (SELECT l_orderkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_extendedprice)) GROUP BY 1",
)
def npv_by_order(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("v"))
    return finance.present_value(rows, 0.05, "v", "l_linenumber", ["l_orderkey"]).select("l_orderkey", r(F.col("npv")).alias("npv"))


_FLOWS = "[-c_acctbal - 20000, 8000.0, 9000.0, 10000.0 + c_nationkey]"


@query(
    "cash_flow_arrays",
    f"SELECT c_custkey, {rs('f[1] / 1.1 + f[2] / 1.21 + f[3] / 1.331 + f[4] / 1.4641')} AS npv, {rs('c_acctbal * 1.01 * 1.02 * 1.03')} AS fvschedule,"
    f" {rs('power((8000 * 1.12 * 1.12 + 9000 * 1.12 + f[4]) / -f[1], 1 / 3) - 1', 6)} AS mirr FROM (SELECT *, {_FLOWS} AS f FROM customer WHERE c_acctbal > -19000)",
)
def cash_flow_arrays(spark, folder):
    flows = F.array(-F.col("c_acctbal") - 20000, F.lit(8000.0), F.lit(9000.0), F.col("c_nationkey") + 10000.0)
    return table(spark, folder, "customer").where("c_acctbal > -19000").select(
        "c_custkey", r(value("NPV", 0.1, flows)).alias("npv"),
        r(value("FVSCHEDULE", F.col("c_acctbal"), F.array(F.lit(0.01), F.lit(0.02), F.lit(0.03)))).alias("fvschedule"),
        r(value("MIRR", flows, 0.1, 0.12), 6).alias("mirr"),
    )


@query("rates_of_return")
def rates_of_return(spark, folder):
    """IRR, XIRR and RATE, each with the present value at the rate found, which is near zero."""
    flows = F.array(-F.col("c_acctbal") - 20000, F.lit(8000.0), F.lit(9000.0), F.col("c_nationkey") + 10000.0)
    days = F.array(*(F.lit(d).cast("date") for d in ("2024-01-01", "2024-07-01", "2025-01-01", "2026-01-01")))
    rows = table(spark, folder, "customer").where("c_acctbal > -19000").select("c_custkey", "c_acctbal", "c_nationkey")
    df = spread(rows, 10_000).select("c_custkey", flows.alias("f"), days.alias("d"))
    out = df.select("c_custkey", "f", "d", value("IRR", F.col("f")).alias("irr"), value("XIRR", F.col("f"), F.col("d")).alias("xirr"), value("RATE", 36, -300.0, 9000.0).alias("rate"))
    return out.select("c_custkey", "irr", "xirr", "rate", value("NPV", F.col("irr"), F.col("f")).alias("npv_at_irr"), value("XNPV", F.col("xirr"), F.col("f"), F.col("d")).alias("xnpv_at_xirr"))


@query("french_depreciation")
def french_depreciation(spark, folder):
    when = [F.lit(d).cast("date") for d in ("2023-08-19", "2023-12-31")]
    df = table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("cost"), (F.col("p_size") % 7).alias("period"))
    return df.select("p_partkey", *(value(n, F.col("cost"), *when, F.col("cost") / 10, F.col("period"), 0.15, 1).alias(n.lower()) for n in ("AMORLINC", "AMORDEGRC")))
