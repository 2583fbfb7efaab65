"""Queries of Monte-Carlo models, capability statistics, audits and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabulon.functions.registry import value
from tabulon.operators import audit, lineage
from tabulon.plans.registry import query, r, rs
from tabulon.simulation import quantiles, run
from tabulon.sources.tables import table
from tabulon.streaming import windows

_MODEL = {"price": ("PSINORMAL", 10.0, 2.0), "volume": ("PSITRIANGULAR", 50.0, 80.0, 140.0), "cost": ("PSIUNIFORM", 200.0, 400.0), "defects": ("PSIPOISSON", 3.0)}
TRIALS = 20_000


def _model(spark):
    return run.simulate(spark, TRIALS, _MODEL, {"profit": lambda: F.col("price") * F.col("volume") - F.col("cost") - 5 * F.col("defects")})


@query("simulation_trials")
def simulation_trials(spark, folder):
    return _model(spark)


@query("simulation_statistics")
def simulation_statistics(spark, folder):
    plain = ("PSIMEAN", "PSISTDDEV", "PSIVARIANCE", "PSISKEWNESS", "PSIKURTOSIS", "PSIRANGE", "PSICOUNT", "PSICOEFFVAR", "PSISTDERR")
    at = {"PSIPERCENTILE": 0.9, "PSIPTOX": 0.9, "PSIQTOX": 0.1, "PSIBVAR": 0.95, "PSITARGET": 500.0, "PSIXTOP": 500.0, "PSIXTOQ": 500.0, "PSIEXPGAIN": 500.0, "PSIEXPLOSS": 500.0, "PSIEXPGAINRATIO": 500.0, "PSIEXPLOSSRATIO": 500.0, "PSIEXPVALMARGIN": 500.0, "PSISEMIVAR2": 500.0, "PSISEMIDEV2": 500.0}
    df = _model(spark)
    out = df.agg(
        *(value(n, "profit").alias(n.lower()) for n in plain), *(value(n, "profit", x).alias(n.lower()) for n, x in at.items()),
        value("PSIFREQUENCY", "profit", 300.0, 600.0).alias("psifrequency"), value("PSICORRELATION", "profit", "price").alias("psicorrelation"),
    )
    return out.join(F.broadcast(run.two_pass(df, "profit")))


@query("simulation_convergence")
def simulation_convergence(spark, folder):
    return run.convergence(_model(spark), "profit")


#: One set of parameters for each distribution.
SPECIMENS = {
    "PSIUNIFORM": (1.0, 2.0), "PSINORMAL": (0.0, 1.0), "PSIERF": (1.0,), "PSILOGNORM2": (0.0, 1.0), "PSILOGNORMAL": (10.0, 2.0), "PSITRIANGULAR": (0.0, 1.0, 3.0), "PSIDBLTRIANG": (0.0, 1.0, 3.0, 0.4),
    "PSITRIANGGEN": (1.0, 2.0, 4.0, 0.1, 0.9), "PSIBERNOULLI": (0.3,), "PSIINTUNIFORM": (1, 6), "PSIEXPONENTIAL": (2.0,), "PSIGEOMETRIC": (0.3,), "PSIWEIBULL": (2.0, 3.0), "PSIRAYLEIGH": (2.0,),
    "PSICAUCHY": (0.0, 1.0), "PSILOGISTIC": (0.0, 1.0), "PSILOGLOGISTIC": (0.0, 1.0, 3.0), "PSILAPLACE": (0.0, 1.0), "PSIMAXEXTREME": (0.0, 1.0), "PSIMINEXTREME": (0.0, 1.0), "PSIFRECHET": (0.0, 1.0, 3.0),
    "PSIPARETO": (1.0, 3.0), "PSIPARETO2": (1.0, 3.0), "PSIRECIPROCAL": (1.0, 10.0), "PSIHYPSECANT": (0.0, 1.0), "PSIBURR12": (0.0, 1.0, 2.0, 3.0), "PSIDAGUM": (0.0, 1.0, 3.0, 2.0),
    "PSIKUMARASWAMY": (2.0, 3.0, 0.0, 1.0), "PSIJOHNSONSB": (0.5, 1.5, 0.0, 1.0), "PSIJOHNSONSU": (0.5, 1.5, 0.0, 1.0), "PSILEVY": (0.0, 1.0), "PSIFATIGUELIFE": (0.0, 1.0, 0.5), "PSIMYERSON": (1.0, 2.0, 4.0),
    "PSINORMALSKEW": (0.0, 1.0, 4.0), "PSIGAMMA": (2.0, 3.0), "PSIERLANG": (2, 3.0), "PSICHISQUARE": (4,), "PSIPEARSON5": (3.0, 2.0), "PSIBETA": (2.0, 3.0), "PSIBETAGEN": (2.0, 3.0, 0.0, 10.0),
    "PSIPEARSON6": (2.0, 4.0, 3.0), "PSISTUDENT": (5,), "PSIFDIST": (3, 7), "PSIPERT": (0.0, 1.0, 4.0), "PSIBETASUBJ": (0.0, 0.3, 0.4, 1.0), "PSIINVNORMAL": (1.0, 2.0), "PSIBINOMIAL": (10, 0.3),
    "PSIPOISSON": (3.0,), "PSINEGBINOMIAL": (3, 0.4), "PSIHYPERGEO": (5, 10, 30), "PSILOGARITHMIC": (0.5,), "PSIDISCRETE": ([1, 2, 5], [0.2, 0.3, 0.5]), "PSICUMULD": (0.0, 4.0, [1, 2], [0.3, 0.7]),
    "PSIDISUNIFORM": ([1, 4, 9],), "PSIRESAMPLE": ([1, 4, 9],), "PSISHUFFLE": ([1, 4, 9],), "PSICUMUL": (0.0, 4.0, [1, 2], [0.3, 0.7]), "PSIHISTOGRAM": (0.0, 3.0, [1, 2, 1]), "PSIGENERAL": (0.0, 3.0, [1, 2], [1, 1]),
    "PSIMETALOG2": ([1.0, 2.0, 0.1],), "PSIMETALOG": (0.0, 10.0, [0.1, 0.5]), "PSIMETALOG2FIT": (3, [1.0, 2.0, 4.0, 7.0], [0.1, 0.4, 0.7, 0.9]), "PSIMETALOGFIT": (3, [1.0, 2.0, 4.0, 7.0], [0.1, 0.4, 0.7, 0.9]),
    "PSIMETALOGSPT": (0.0, 10.0, [2.0, 4.0, 7.0], 0.1), "PSIMOMENTFIT": (5.0, 2.0, 0.3, 3.2), "PSIFIT": ([1.0, 2.0, 2.5, 3.0, 6.0],), "PSIAR1": (0.0, 1.0, 0.5, 2.0), "PSIAR2": (0.0, 1.0, 0.5, 0.2, 2.0, 1.0),
    "PSIMA1": (0.0, 1.0, 0.5, 0.3), "PSIMA2": (0.0, 1.0, 0.5, 0.2, 0.3, 0.1), "PSIARMA11": (0.0, 1.0, 0.5, 0.3, 2.0, 0.1), "PSIARCH1": (0.0, 1.0, 0.5, 2.0), "PSIGARCH11": (0.0, 1.0, 0.3, 0.5, 2.0, 1.0),
    "PSIEGARCH11": (0.0, 1.0, -0.1, 0.2, 0.3, 0.5, 2.0, 1.0), "PSIAPARCH11": (0.0, 1.0, 2.0, 0.1, 0.3, 0.5, 2.0, 1.0),
}


@query("simulation_distributions")
def simulation_distributions(spark, folder):
    """Mean, spread and three quantiles of 2,000 draws from every distribution, from the same uniform numbers."""
    df = spark.range(2000).select(F.col("id").alias("trial"), run.uniform(1, "u", F.col("id")).alias("u"))
    out = None
    for name, parameters in SPECIMENS.items():
        x = quantiles.QUANTILES[name](quantiles.Columns, F.col("u"), *parameters)
        row = df.select(x.cast("double").alias("x")).agg(
            F.lit(name).alias("distribution"), F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.percentile("x", 0.1).alias("p10"), F.percentile("x", 0.5).alias("p50"), F.percentile("x", 0.9).alias("p90")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("simulation_percentile_forms")
def simulation_percentile_forms(spark, folder):
    """Two-parameter families given by their 10 % and 90 % points; the draws' percentiles come near them."""
    df = spark.range(2000).select(run.uniform(2, "u", F.col("id")).alias("u"))
    out = None
    for name in ("PSINORMALALT", "PSILOGNORMALALT", "PSIUNIFORMALT", "PSIGAMMAALT", "PSIWEIBULLALT", "PSILOGISTICALT", "PSICAUCHYALT", "PSILAPLACEALT"):
        x = run.draw(name, [(0.1, 2.0), (0.9, 9.0)], u=F.col("u"))
        row = df.select(x.alias("x")).agg(F.lit(name).alias("distribution"), F.percentile("x", 0.1).alias("p10"), F.percentile("x", 0.9).alias("p90"))
        out = row if out is None else out.unionByName(row)
    return out


@query("simulation_correlated")
def simulation_correlated(spark, folder):
    df = run.correlated(spark, TRIALS, [1.0, 2.0], [[1.0, 0.6], [0.6, 2.0]])
    return df.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("x1", "x2")), F.covar_samp("x1", "x2").alias("covariance"))


@query("theoretical_statistics")
def theoretical_statistics(spark, folder):
    out = None
    for name in ("PSINORMAL", "PSITRIANGULAR", "PSIEXPONENTIAL", "PSIGAMMA", "PSIBETA"):
        parameters = SPECIMENS[name]
        row = run.theoretical(spark, name, *parameters).select(F.lit(name).alias("distribution"), "*", F.lit(run.theoretical_at(name, *parameters, p=0.9)).alias("p90"), F.lit(run.theoretical_mode(name, *parameters)).alias("mode"))
        out = row if out is None else out.unionByName(row)
    return out


_S = {
    "psisigmacp": "8 / (6 * s)", "psisigmacpk": "least(29 - m, m - 21) / s / 3", "psisigmacpklower": "(m - 21) / s / 3", "psisigmacpkupper": "(29 - m) / s / 3",
    "psisigmacpm": "8 / (6 * sqrt(s * s + power(m - 25, 2)))", "psisigmak": "(m - 25) / 4", "psisigmazlower": "(m - 21) / s", "psisigmazupper": "(29 - m) / s", "psisigmazmin": "least(29 - m, m - 21) / s",
    "psisigmayield": "1 - d", "psisigmadefectppm": "d * 1e6",
}


@query("six_sigma", "SELECT l_returnflag, " + ", ".join(f"{rs(s, 4)} AS {a}" for a, s in _S.items()) + " FROM (SELECT l_returnflag, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg((l_quantity < 21 OR l_quantity > 29)::INT) AS d FROM lineitem GROUP BY 1)")
def six_sigma(spark, folder):
    stats = run.six_sigma("l_quantity", 21.0, 29.0)
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(*(r(stats[a.upper()], 4).alias(a) for a in _S))


@query("six_sigma_shifted")
def six_sigma_shifted(spark, folder):
    stats = run.six_sigma("l_quantity", 21.0, 29.0)
    names = [n for n in stats if "SHIFT" in n or "BOUND" in n or "LEVEL" in n]
    moments = table(spark, folder, "lineitem").select("l_quantity")
    return moments.agg(*(stats[n].alias(n.lower()) for n in names))


# -- audits: the orders as a sheet whose column 2 doubles column 1, with planted faults ------------------------------


def _sheet(spark, folder):
    row = F.col("o_orderkey") + 1
    odd, stale = F.col("o_orderkey") % 997 == 5, F.col("o_orderkey") % 501 == 7
    formula = F.concat(F.lit("=A"), F.when(odd, row + 1).otherwise(row).cast("string"), F.when(F.col("o_orderkey") % 1501 == 9, "*NOW()").otherwise("*2"))
    return table(spark, folder, "orders").select(
        F.lit("orders").alias("sheet"), row.alias("row"), F.lit(2).alias("col"), formula.alias("formula"),
        F.when(stale, "999").otherwise((F.col("o_totalprice") * 2).cast("string")).alias("cached"), (F.col("o_totalprice") * 2).cast("string").alias("computed"),
    )


@query("audit_inconsistent", "SELECT 'orders' AS sheet, o_orderkey + 1 AS \"row\" FROM orders WHERE o_orderkey % 997 = 5 OR o_orderkey % 1501 = 9")
def audit_inconsistent(spark, folder):
    return audit.inconsistent(_sheet(spark, folder)).select("sheet", "row")


@query("audit_stale", "SELECT o_orderkey + 1 AS \"row\" FROM orders WHERE o_orderkey % 501 = 7 AND o_orderkey % 1501 <> 9")
def audit_stale(spark, folder):
    return audit.stale(_sheet(spark, folder)).select("row")


@query("audit_outcomes", "SELECT CASE WHEN o_orderkey % 501 = 7 THEN 'differed' ELSE 'agreed' END AS outcome, count(*) AS n FROM orders GROUP BY 1")
def audit_outcomes(spark, folder):
    return audit.compared(_sheet(spark, folder))


@query("audit_circles", "SELECT unnest([2 * o_orderkey, 2 * o_orderkey + 1]) AS cell FROM orders WHERE o_orderkey % 100 = 3")
def audit_circles(spark, folder):
    """Every hundredth order refers to a cell that refers back; a running total over all orders is one long chain."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"))
    odd = o.where("k % 100 = 3")
    there, back = odd.selectExpr("2 * k AS from_cell", "2 * k + 1 AS to_cell"), odd.selectExpr("2 * k + 1 AS from_cell", "2 * k AS to_cell")
    chain = o.selectExpr("-k - 1 AS from_cell", "-k - 2 AS to_cell")
    return audit.unresolved(there.unionByName(back).unionByName(chain))


# -- streams ---------------------------------------------------------------------------------------------------------


@query("stream_tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, {rs('sum(value)', 3)} AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, folder):
    """The events as a stream of files: hourly windows, processed to the end, and read back.

    A batch writes the windows that it changed to a folder of its own, so that a batch that is done again leaves the same,
    and the last word on each window counts. Files come in no order of time: the watermark spans them all.
    """
    from pyspark.sql import DataFrame

    like = table(spark, folder, "events")
    stream = windows.read_stream(spark, f"{folder}/events*", like)
    counted = windows.windowed(stream, "ts", "1 hour", {"n": F.count("*"), "total": F.sum("value")}, ["event_type"], late="3650 days")
    base = f"{lineage.shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={k}")

    started = counted.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    started.awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("_last")).select("window_start", "event_type", "_last.*")
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r(F.col("total"), 3).alias("total"))


@query("windows_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR])::TIMESTAMP AS w FROM events) GROUP BY 1")
def windows_sliding(spark, folder):
    out = windows.windowed(table(spark, folder, "events"), "ts", "2 hours", {"n": F.count("*")}, slide="1 hour")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "windows_sessions",
    "WITH g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) SELECT user_id, min(ts) AS window_start, count(*) AS n FROM g GROUP BY user_id, s",
)
def windows_sessions(spark, folder):
    out = windows.sessions(table(spark, folder, "events"), "ts", "6 hours", {"n": F.count("*")}, ["user_id"])
    return out.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")
