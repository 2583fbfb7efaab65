"""Every registered query of the library against its SQL in DuckDB, on sf0.001; and that registering needs no session."""

import math
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return float(f"{v:.8g}") if isinstance(v, float) else v


def _rows(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted((tuple(_plain(r[k]) for k in at) for r in rows), key=repr)


def test_registering_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def _names():
    sys.path.insert(0, str(ROOT))
    from tabulon.plans import load

    registry = load()
    return sorted(registry.ORACLES), sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", _names()[0])
def test_query_equals_sql(spark, duck, name):
    from tabulon.plans import load

    df = load().QUERIES[name](spark, FOLDER)
    cursor = duck.execute(load().ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.collect(), df.columns) == _rows(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in _names()[1] if n not in ("bonds", "complex_numbers", "simulation_distributions", "distributions_inverse")])
def test_other_queries_run(spark, name):
    from tabulon.plans import load

    assert load().QUERIES[name](spark, FOLDER).count() > 0


def test_quantiles_give_their_probabilities_back(spark):
    from tabulon.plans import load

    for r in load().QUERIES["distributions_inverse"](spark, FOLDER).limit(40).collect():
        for name in ("norm_s", "lognorm", "t", "f", "chisq", "gamma", "beta"):
            assert math.isclose(r[f"{name}_p"], r.p, rel_tol=1e-8), name


def test_run_statistics_have_closed_forms(spark):
    from tabulon.functions.registry import value
    from tabulon.simulation import run

    df = spark.range(1, 101).selectExpr("id - 1 AS trial", "CAST(id AS DOUBLE) AS x")
    got = df.agg(value("PSIMEAN", "x").alias("m"), value("PSITARGET", "x", 50.0).alias("t"), value("PSIPERCENTILE", "x", 0.5).alias("p"), value("PSIEXPGAIN", "x", 90.0).alias("g")).first()
    assert (got.m, got.t, got.p, got.g) == (50.5, 0.5, 50.5, 0.55)
    a, b = (run.simulate(spark, 500, {"x": ("PSINORMAL", 10.0, 2.0)}, {}, partitions=n).agg({"x": "avg"}).first()[0] for n in (1, 7))
    assert math.isclose(a, b, rel_tol=1e-12) and abs(a - 10) < 0.4


def test_holt_follows_every_value(spark):
    from tabulon.operators import forecast

    values = [3.0, 5.0, 4.0, 8.0, 9.0]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "g string, k int, v double")
    level, trend = values[0], values[1] - values[0]
    for x in values[1:]:
        before = level
        level = 0.4 * x + 0.6 * (level + trend)
        trend = 0.2 * (level - before) + 0.8 * trend
    assert math.isclose(forecast.double_exponential(df, "v", "k", ["g"], 0.4, 0.2, 2).first().forecast, level + 2 * trend)


def test_hypothesis_tests_use_every_row(spark, monkeypatch):
    from tabulon.operators import inference
    from tabulon.plans import load

    sizes, chisq = [], inference.chisq_test
    monkeypatch.setattr(inference, "chisq_test", lambda df, *args: sizes.append(df.count()) or chisq(df, *args))
    load().QUERIES["hypothesis_tests"](spark, FOLDER)
    assert sizes == [spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()]


def _on_or_between_circles(edges):
    """Cells that some circle reaches and that reach some circle, by plain search."""
    out, into = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)

    def reach(start, links):
        seen, todo = set(), list(links.get(start, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links.get(x, ())
        return seen

    circles = {x for x in out if x in reach(x, out)}
    return {x for x in {*out, *into} if x in circles or reach(x, out) & circles and reach(x, into) & circles}


def test_unresolved_cells_equal_a_plain_search(spark):
    import random

    from tabulon.operators import audit

    rng = random.Random(5)
    chain = [(1000 + k, 1001 + k) for k in range(300)]
    ring = [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)]
    lollipop = [(3000, 3001), (3001, 3000), *((3001 + k, 3002 + k) for k in range(20)), (3021, 3022), (3022, 3021), (3010, 4000), (4000, 4001), (5, 5), (6, 6), (6, 7)]
    graphs = [chain + ring + lollipop, [], chain, ring, *([(rng.randrange(40), rng.randrange(40)) for _ in range(n)] for n in (20, 36, 60))]
    for edges in graphs:
        df = spark.createDataFrame(edges + edges[:3], "from_cell bigint, to_cell bigint")
        got = [r.cell for r in audit.unresolved(df).collect()]
        assert len(got) == len(set(got)) and set(got) == _on_or_between_circles(edges)


def test_a_long_chain_is_written_a_few_times_only(spark, monkeypatch):
    import random

    from tabulon.operators import audit

    n, rows, keep = 4000, [], audit.written
    names = list(range(10, 10 + n))
    random.Random(3).shuffle(names)
    edges = [*zip(names, names[1:]), (1, 1), (2, 3), (3, 2), (3, names[0]), (names[2000], 4), (4, 5), (5, 6), (6, 4)]

    def counted(df):
        out = keep(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(audit, "written", counted)
    monkeypatch.setattr(audit.unresolved, "__defaults__", (50,))
    df = spark.createDataFrame([*edges, (None, 7), (7, None)], "from_cell bigint, to_cell bigint")
    got = [r.cell for r in audit.unresolved(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _on_or_between_circles(edges) == {1, 2, 3, 4, 5, 6, *names[:2001]}
    assert sum(rows) < 7 * n


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_spreads_a_hot_group_and_finds_the_nearest(spark, direction):
    import random

    from tabulon.operators import lookup

    rng = random.Random(2)
    groups = [1] * 6 + [2, 3, None]
    left = [(k, rng.choice(groups), float(rng.randrange(500))) for k in range(600)]
    right = [(rng.choice([1, 1, 1, 2, None]), float(rng.randrange(-20, 520)), k) for k in range(150)]
    probes = spark.createDataFrame(left, "k int, g int, at double")
    table = spark.createDataFrame(right, "g int, key double, v int")
    got = lookup.asof(probes, "at", table, "key", ["v"], by=["g"], direction=direction, ranges=16)
    backward = direction == "backward"

    def nearest(g, at):
        hits = [(key, v) for h, key, v in right if h == g and (key <= at if backward else key >= at)]
        return (max if backward else min)(hits, default=(None, None))[1]

    assert {r.k: r.v for r in got.collect()} == {k: nearest(g, at) for k, g, at in left}


def test_rows_later_than_the_watermark_are_left_out(spark, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    from tabulon.streaming import windows

    # The second row of ten o'clock comes when its window is closed; a batch tells by the watermark of the one before it.
    batches = [[10, 14], [15], [10, 14, 16], [19]]
    for k, hours in enumerate(batches):
        rows = spark.createDataFrame([(datetime(2024, 1, 1, h, 5 + k),) for h in hours], "ts timestamp").coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")), files_per_trigger=1)
    counted = windows.windowed(stream, "ts", "1 hour", {"n": F.count("*")}, late="1 hour")
    windows.run_available(counted, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {r.window_start.hour: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {10: 1, 14: 2, 15: 1, 16: 1}


def test_percentiles_of_all_rows_are_made_in_ranges(spark):
    from tabulon.operators import ranking
    from tabulon.plans import load

    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    df = spark.range(1, 1001).selectExpr("CASE WHEN id % 9 = 0 THEN NULL ELSE pow(id * 7919 % 1009 % 400, 1.5) END AS x")
    from pyspark.sql import functions as F

    wanted = df.agg(*(F.percentile("x", p).alias(n) for n, p in shares.items())).first()
    got = ranking.percentiles(df, "x", shares).first()
    assert all(math.isclose(got[n], wanted[n], rel_tol=1e-14) for n in shares)
    assert tuple(ranking.percentiles(df.where("x < 0"), "x", shares).first() or [None]) in ((None,) * 5, (None,))
    plan = load().QUERIES["run_statistics"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and "-percentile(" not in plan


def test_complex_numbers_are_worked_on_by_all_cores(spark):
    from tabulon.plans import load

    df = load().QUERIES["complex_closed"](spark, FOLDER)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["returns_closed", "rates_of_return"])
def test_rates_of_a_small_file_are_found_by_more_than_one_task(spark, tmp_path, name):
    from tabulon.plans import load

    rows = spark.range(25_000).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id % 1000 AS DOUBLE) AS c_acctbal")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = load().QUERIES[name](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.count() == df.select("c_custkey").distinct().count() == 25_000
