"""Audits of a cell relation (sheet, row, col, formula, cached, computed) and of its references (from_cell, to_cell)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.lineage import written
from tabulon.operators.ranking import rank

#: Fixed value: functions whose results change by themselves, so that a stale value says nothing.
VOLATILE = "NOW|TODAY|RAND|RANDBETWEEN|RANDARRAY|OFFSET|INDIRECT"


def shape(formula: Column, row: Column, col: Column) -> Column:
    """A formula with its references written relative to its cell, so that filled-down formulas look alike."""
    ref = r"(?<![A-Za-z_])(\$?)([A-Z]{1,3})(\$?)([0-9]{1,7})(?![0-9A-Za-z_(])"
    parts = F.regexp_extract_all(formula, F.lit(ref), 0)
    between = F.split(formula, ref, -1)

    def relative(r: Column) -> Column:
        letters, digits = F.regexp_extract(r, r"\$?([A-Z]+)", 1), F.regexp_extract(r, r"([0-9]+)$", 1).cast("int")
        number = F.reduce(F.split(letters, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))
        up = F.when(r.rlike(r"\$[0-9]+$"), digits.cast("string")).otherwise(F.concat(F.lit("["), (digits - row).cast("string"), F.lit("]")))
        side = F.when(F.startswith(r, F.lit("$")), number.cast("string")).otherwise(F.concat(F.lit("["), (number - col).cast("string"), F.lit("]")))
        return F.concat(F.lit("R"), up, F.lit("C"), side)

    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(relative(F.get(parts, i)), F.lit("")))), "")


def inconsistent(cells: DataFrame, quorum: int = 3) -> DataFrame:
    """Formulas whose shape differs from at least ``quorum`` others in the same unbroken run of a column.

    A run is a stretch of rows without a gap; the shape that most of its cells have is the expected one. Rows are
    numbered by ``ranking.rank``, which cuts a long column into ranges.
    """
    shaped = cells.where(F.col("formula").isNotNull()).withColumn("shape", shape(F.col("formula"), F.col("row"), F.col("col")))
    runs = rank(shaped, "row", ["sheet", "col"], ascending=True).withColumn("_run", F.col("row") - F.col("rank_eq"))
    counts = runs.groupBy("sheet", "col", "_run", "shape").agg(F.count("*").alias("n"))
    usual = counts.groupBy("sheet", "col", "_run").agg(F.max_by("shape", F.struct("n", "shape")).alias("expected"), F.max("n").alias("quorum"))
    return (
        runs.join(usual, ["sheet", "col", "_run"])
        .where((F.col("shape") != F.col("expected")) & (F.col("quorum") >= quorum))
        .select("sheet", "row", "col", "formula", "expected", "quorum")
    )


def outcome(cached: Column, computed: Column, error: Column | None = None) -> Column:
    """agreed, differed, agreedOnError, threw or notComparable; numbers agree within 1e-9 of their size."""
    a, b = cached.try_cast("double"), computed.try_cast("double")
    near = F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    out = (
        F.when(cached.isNull() & computed.isNull(), "notComparable")
        .when(F.startswith(cached, F.lit("#")) & (cached == computed), "agreedOnError")
        .when(a.isNotNull() & b.isNotNull(), F.when(near, "agreed").otherwise("differed"))
        .when(F.lower(cached).eqNullSafe(F.lower(computed)), "agreed")
        .otherwise("differed")
    )
    return out if error is None else F.when(error.isNotNull() & ~F.startswith(F.coalesce(cached, F.lit("")), F.lit("#")), "threw").otherwise(out)


def compared(cells: DataFrame) -> DataFrame:
    """Cells counted by outcome."""
    return cells.groupBy(outcome(F.col("cached"), F.col("computed")).alias("outcome")).agg(F.count("*").alias("n"))


def stale(cells: DataFrame) -> DataFrame:
    """Cells whose cached value is not what they compute, leaving out those that change by themselves."""
    fixed = ~F.coalesce(F.upper("formula").rlike(rf"\b({VOLATILE})\("), F.lit(False))
    return cells.where(fixed & (outcome(F.col("cached"), F.col("computed")) == "differed"))


def _peeled(edges: DataFrame) -> DataFrame:
    """Without the edges out of cells that read nothing and into cells that nothing reads."""
    reads, read = edges.select(F.col("from_cell").alias("_a")), edges.select(F.col("to_cell").alias("_b"))
    return edges.join(reads, F.col("to_cell") == F.col("_a"), "left_semi").join(read, F.col("from_cell") == F.col("_b"), "left_semi")


def _thinned(now: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Cells of chains (cell, a, b, first, last) parted by a draw: those left, pointing past the cells taken out, and those
    taken out.

    A cell goes whose draw is above those of both its neighbours, so no two neighbours go; about a third does. The first
    cell of a chain stays, and who comes last is handed on. Circles shrink to a cell that points at itself.
    """
    draw = lambda c: F.xxhash64(F.lit(k), F.col(c))
    goes = ~F.col("first") & (draw("cell") > draw("a")) & (F.col("last") | (draw("cell") > draw("b")))
    gone = now.where(goes)
    up = gone.where("NOT last").select(F.col("b").alias("cell"), F.col("a").alias("a2"))
    down = gone.select(F.col("a").alias("cell"), F.col("b").alias("b2"), F.col("last").alias("last2"))
    left = now.where(~goes).join(up, "cell", "left").join(down, "cell", "left")
    return written(left.select("cell", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), "first", F.coalesce("last2", "last").alias("last"))), gone.select("cell", "a", "b")


def _contracted(edges: DataFrame, few: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Edges with each chain of cells of one edge in and one out made a single edge, the chains' cells (cell, a, b) with
    two cells between which they stand, last the ones to be put back first, and the cells of circles that consist of such
    cells alone.

    Cells are first thinned out, which costs a share of the chains that is less in each round, down to a two-hundredth or
    ``few``. Then every cell points at the next ones of its chain on both sides, and the reach of the pointers doubles in
    each round. A round settles more cells as long as a chain is open; what stays open then runs in circles.
    """
    out, into = F.lit(None).cast(edges.schema["to_cell"].dataType), F.lit(None).cast(edges.schema["from_cell"].dataType)
    ends = edges.select(F.col("from_cell").alias("cell"), into.alias("a"), F.col("to_cell").alias("b")).unionByName(edges.select(F.col("to_cell").alias("cell"), F.col("from_cell").alias("a"), out.alias("b")))
    met = ends.groupBy("cell").agg(F.min("a").alias("a"), F.max("a").alias("a2"), F.min("b").alias("b"), F.max("b").alias("b2"))
    inner = F.coalesce((F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), F.lit(False))
    cells = written(met.select("cell", "a", "b", inner.alias("inner")))
    now, others = cells.where("inner").drop("inner"), written(cells.where("NOT inner").select("cell"))
    for c in ("from_cell", "to_cell"):
        edges = edges.join(others.select(F.col("cell").alias(c)), c, "left_semi")
    for c, name in (("a", "first"), ("b", "last")):
        now = now.join(others.select(F.col("cell").alias(c), F.lit(True).alias(name)), c, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    now = written(now.select("cell", "a", "b", "first", "last"))
    # Chains shrunk to one cell are done, and so are circles.
    whole, loop = F.col("first") & F.col("last"), F.col("cell") == F.col("a")
    done, circles, steps = [], [], []
    while True:
        done, circles, now = [*done, now.where(whole)], [*circles, now.where(loop)], now.where(~whole & ~loop)
        n = now.count()
        most = max(n // 200, few) if not steps else most
        if n <= most:
            break
        now, gone = _thinned(now, len(steps))
        steps.append(gone)
    now, before = written(now.select("cell", "a", "b")), None
    inner = now.select("cell")
    while (left := now.join(inner.select(F.col("cell").alias("a")), "a", "left_semi").count()) not in (before, 0):
        before = left
        up, down = now.select(F.col("cell").alias("a"), F.col("a").alias("a2")), now.select(F.col("cell").alias("b"), F.col("b").alias("b2"))
        now = written(now.join(up, "a", "left").join(down, "b", "left").select("cell", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b")))
    ends = inner.select(F.col("cell").alias("a"))
    chains = reduce(DataFrame.unionByName, (*(d.select("cell", "a", "b") for d in done), now.join(ends, "a", "left_anti")))
    short = edges.select("from_cell", "to_cell").unionByName(chains.select(F.col("a").alias("from_cell"), F.col("b").alias("to_cell"))).distinct()
    circles = [c.select("cell") for c in (*circles, now.join(ends, "a", "left_semi"))]
    return short, [*steps, chains], reduce(DataFrame.unionByName, circles)


def unresolved(edges: DataFrame, few: int = 20_000) -> DataFrame:
    """Cells that take part in a circular reference or stand between two of them.

    Edges into cells that read nothing, or out of cells that nothing reads, are taken away until none goes; what is
    left lies on circles or between them. Chains become single edges before each such step, so that the rounds grow
    with the logarithm of the longest chain and with the depth of branching, and the rows moved with the edges and
    that depth; a chain's cells are among the result if both their neighbours are. Each round is written to the shared
    folder. Chains of up to ``few`` cells in all are not thinned out.
    """
    now = written(edges.select("from_cell", "to_cell").where("from_cell IS NOT NULL AND to_cell IS NOT NULL"))
    before, steps = None, []
    while (left := now.count()) not in (before, 0):
        before = left
        short, chains, circles = _contracted(now, few)
        steps.append((chains, circles))
        now = written(_peeled(_peeled(written(short))))
    cells = written(now.select(F.col("from_cell").alias("cell")).unionByName(now.select(F.col("to_cell").alias("cell"))).distinct())
    for chains, circles in reversed(steps):
        cells = cells.unionByName(circles)
        for chain in reversed(chains):
            between = chain.join(cells.select(F.col("cell").alias("a")), "a", "left_semi").join(cells.select(F.col("cell").alias("b")), "b", "left_semi")
            cells = cells.unionByName(written(between.select("cell")))
    return cells


def ordered(findings: DataFrame) -> DataFrame:
    """Worst first, then in reading order."""
    return findings.orderBy(F.col("severity").desc(), "sheet", "row", "col")
