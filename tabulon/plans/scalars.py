"""Queries of row-wise functions: mathematics, text, dates, logic, engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import datetime as D
from tabulon.functions import engineering, logic, math, matrix, text  # noqa: F401  they fill the catalogue
from tabulon.functions.registry import cell, error, value
from tabulon.plans.registry import later, made, query, r, rs, scalars
from tabulon.sources.tables import table


def _v(name, *args, digits=None):
    call = lambda: value(name, *map(made, args))
    return call if digits is None else (lambda: r(call(), digits))


_KEY = ["l_orderkey", "l_linenumber"]
_X = "(l_discount * 10)"
_M = lambda: F.col("l_discount") * 10


def _m(name, sql, *args, digits=6):
    """A function of l_discount * 10, which lies in [0, 1]."""
    return lambda: r(value(name, _M(), *args), digits), rs(sql.replace("@", _X), digits)


scalars(
    "math_functions",
    "lineitem",
    _KEY,
    {
        **{n.lower(): _m(n, f"{n.lower()}(@)") for n in ("ABS", "SQRT", "EXP", "SIN", "COS", "TAN", "ATAN", "ASIN", "ACOS", "SINH", "COSH", "TANH", "ASINH", "DEGREES", "RADIANS")},
        "sign_": _m("SIGN", "sign(@)"),
        "ln_": (lambda: r(value("LN", F.col("l_quantity")), 6), rs("ln(l_quantity)", 6)),
        "log10_": (lambda: r(value("LOG10", F.col("l_quantity")), 6), rs("log10(l_quantity)", 6)),
        "log_": (lambda: r(value("LOG", F.col("l_quantity"), 2), 6), rs("log2(l_quantity)", 6)),
        "atanh_": _m("ATANH", "CASE WHEN abs(@) < 1 THEN atanh(@) END"),
        "acosh_": (lambda: r(value("ACOSH", F.col("l_quantity")), 6), rs("acosh(l_quantity)", 6)),
        "sec_": _m("SEC", "1 / cos(@)"),
        "csc_": _m("CSC", "CASE WHEN @ <> 0 THEN 1 / sin(@) END", digits=4),
        "cot_": _m("COT", "CASE WHEN @ <> 0 THEN 1 / tan(@) END", digits=4),
        "sech_": _m("SECH", "1 / cosh(@)"),
        "csch_": _m("CSCH", "CASE WHEN @ <> 0 THEN 1 / sinh(@) END", digits=4),
        "coth_": _m("COTH", "CASE WHEN @ <> 0 THEN 1 / tanh(@) END", digits=4),
        "acot_": _m("ACOT", "pi() / 2 - atan(@)"),
        "acoth_": (lambda: r(value("ACOTH", F.col("l_quantity")), 6), rs("CASE WHEN l_quantity > 1 THEN 0.5 * ln((l_quantity + 1) / (l_quantity - 1)) END", 6)),
        "atan2_": (lambda: r(value("ATAN2", F.col("l_quantity"), F.col("l_linenumber")), 6), rs("atan2(l_linenumber, l_quantity)", 6)),
        "sqrtpi_": _m("SQRTPI", "sqrt(@ * pi())"),
        "pi_": (lambda: r(value("PI"), 6), rs("pi()", 6)),
        "power_": (lambda: r(value("POWER", F.col("l_linenumber"), 2.5), 6), rs("power(l_linenumber, 2.5)", 6)),
        "sqrt_error": (lambda: error("SQRT", F.col("l_linenumber") - 3), "CASE WHEN l_linenumber < 3 THEN '#NUM!' END"),
    },
)

_P = later
scalars(
    "rounding_functions",
    "orders",
    ["o_orderkey"],
    {
        "round_2": (_v("ROUND", _P("o_totalprice") / 7, 2, digits=6), rs("floor(o_totalprice / 7 * 100 + 0.5) / 100", 6)),
        "round_m2": (_v("ROUND", _P("o_totalprice"), -2), "floor(o_totalprice / 100 + 0.5) * 100"),
        "roundup_0": (_v("ROUNDUP", _P("o_totalprice"), 0), "ceil(o_totalprice)"),
        "rounddown_m3": (_v("ROUNDDOWN", _P("o_totalprice"), -3), "floor(o_totalprice / 1000) * 1000"),
        "trunc_": (_v("TRUNC", 0 - _P("o_totalprice")), "trunc(-o_totalprice)"),
        "int_": (_v("INT", 0 - _P("o_totalprice")), "floor(-o_totalprice)"),
        "mod_": (_v("MOD", 0 - _P("o_orderkey"), 7), "(((-o_orderkey) % 7) + 7) % 7::DOUBLE"),
        "quotient_": (_v("QUOTIENT", 0 - _P("o_orderkey"), 7), "trunc(-o_orderkey / 7)"),
        "ceiling_": (_v("CEILING", _P("o_totalprice"), 50), "ceil(o_totalprice / 50) * 50"),
        "floor_": (_v("FLOOR", _P("o_totalprice"), 50), "floor(o_totalprice / 50) * 50"),
        "ceiling_math": (_v("CEILING.MATH", 0 - _P("o_totalprice"), 50, 1), "floor(-o_totalprice / 50) * 50"),
        "floor_math": (_v("FLOOR.MATH", 0 - _P("o_totalprice"), 50, 1), "ceil(-o_totalprice / 50) * 50"),
        "ceiling_precise": (_v("CEILING.PRECISE", 0 - _P("o_totalprice"), 50), "ceil(-o_totalprice / 50) * 50"),
        "iso_ceiling": (_v("ISO.CEILING", 0 - _P("o_totalprice"), 50), "ceil(-o_totalprice / 50) * 50"),
        "floor_precise": (_v("FLOOR.PRECISE", 0 - _P("o_totalprice"), 50), "floor(-o_totalprice / 50) * 50"),
        "mround_": (_v("MROUND", _P("o_orderkey"), 12), "floor(o_orderkey / 12 + 0.5) * 12"),
        "even_": (_v("EVEN", _P("o_orderkey")), "ceil(o_orderkey / 2) * 2"),
        "odd_": (_v("ODD", _P("o_orderkey")), "CASE WHEN o_orderkey = 0 THEN 1 ELSE 2 * ceil((o_orderkey + 1) / 2) - 1 END"),
    },
)

scalars(
    "counting_functions",
    "nation",
    ["n_nationkey"],
    {
        "fact_": (_v("FACT", _P("n_regionkey") + 3), "factorial(n_regionkey + 3)::DOUBLE"),
        "combin_": (_v("COMBIN", _P("n_nationkey") + 5, 4), "round(factorial((n_nationkey + 5)::INT)::DOUBLE / factorial((n_nationkey + 1)::INT)::DOUBLE / 24)"),
        "combina_": (_v("COMBINA", _P("n_regionkey") + 2, 3), "round(factorial(n_regionkey + 4)::DOUBLE / factorial(n_regionkey + 1)::DOUBLE / 6)"),
        "permut_": (_v("PERMUT", _P("n_regionkey") + 5, 3), "factorial(n_regionkey + 5)::DOUBLE / factorial(n_regionkey + 2)::DOUBLE"),
        "permutationa_": (_v("PERMUTATIONA", _P("n_regionkey") + 2, 3), "power(n_regionkey + 2, 3)"),
        "gcd_": (_v("GCD", _P("n_nationkey") * 6, 20), "gcd(n_nationkey * 6, 20)::DOUBLE"),
        "lcm_": (_v("LCM", _P("n_nationkey") + 1, 12), "lcm(n_nationkey + 1, 12)::DOUBLE"),
        "multinomial_": (_v("MULTINOMIAL", _P("n_regionkey"), 2, 3), "round(factorial(n_regionkey + 5)::DOUBLE / factorial(n_regionkey)::DOUBLE / 12)"),
        "seriessum_": (lambda: value("SERIESSUM", 2, F.col("n_regionkey"), 1, F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25))), "power(2, n_regionkey) * 3"),
        "dec2bin": (_v("DEC2BIN", _P("n_nationkey"), 8), "lpad(bin(n_nationkey), 8, '0')"),
        "dec2hex": (_v("DEC2HEX", _P("n_nationkey") * 1000), "upper(to_hex(n_nationkey * 1000))"),
        "dec2oct": (_v("DEC2OCT", _P("n_nationkey")), "CASE WHEN n_nationkey >= 8 THEN (n_nationkey // 8)::VARCHAR ELSE '' END || (n_nationkey % 8)::VARCHAR"),
        "hex2dec": (lambda: value("HEX2DEC", value("DEC2HEX", 0 - F.col("n_nationkey"))), "-n_nationkey::DOUBLE"),
        "base_": (_v("BASE", _P("n_nationkey"), 2, 6), "lpad(bin(n_nationkey), 6, '0')"),
        "bitand_": (_v("BITAND", _P("n_nationkey"), 13), "(n_nationkey & 13)::DOUBLE"),
        "bitor_": (_v("BITOR", _P("n_nationkey"), 13), "(n_nationkey | 13)::DOUBLE"),
        "bitxor_": (_v("BITXOR", _P("n_nationkey"), 13), "xor(n_nationkey, 13)::DOUBLE"),
        "bitlshift_": (_v("BITLSHIFT", _P("n_nationkey"), 3), "n_nationkey * 8.0"),
        "bitrshift_": (_v("BITRSHIFT", _P("n_nationkey"), 1), "floor(n_nationkey / 2)"),
        "delta_": (_v("DELTA", _P("n_nationkey"), 5), "(n_nationkey = 5)::INT"),
        "gestep_": (_v("GESTEP", _P("n_nationkey"), 5), "(n_nationkey >= 5)::INT"),
        "miles": (_v("CONVERT", _P("n_nationkey"), "mi", "km", digits=6), rs("n_nationkey * 1.609344", 6)),
        "fahrenheit": (_v("CONVERT", _P("n_nationkey"), "C", "F", digits=6), rs("n_nationkey * 1.8 + 32", 6)),
        "convert_error": (lambda: error("CONVERT", F.col("n_nationkey"), "mi", "kg"), "'#N/A'"),
    },
)


_ROMAN = " || ".join(
    f"list_extract(['', '{a}', '{a}{a}', '{a}{a}{a}', '{a}{b}', '{b}', '{b}{a}', '{b}{a}{a}', '{b}{a}{a}{a}', '{a}{c}'], (n // {place} % 10 + 1)::INT)"
    for a, b, c, place in (("M", "", "", 1000), ("C", "D", "M", 100), ("X", "L", "C", 10), ("I", "V", "X", 1))
)


@query("roman_numerals", f"SELECT p_partkey, n, {_ROMAN} AS roman, n AS back FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)")
def roman_numerals(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 3999 + 1).alias("n"))
    out = df.select("p_partkey", "n", value("ROMAN", F.col("n")).alias("roman"))
    return out.select("*", value("ARABIC", F.col("roman")).alias("back"))


scalars(
    "text_functions",
    "customer",
    ["c_custkey"],
    {
        "len_": (_v("LEN", _P("c_name")), "length(c_name)"),
        "left_": (_v("LEFT", _P("c_name"), 4), "left(c_name, 4)"),
        "right_": (_v("RIGHT", _P("c_name"), 3), "right(c_name, 3)"),
        "mid_": (_v("MID", _P("c_name"), 3, 5), "substring(c_name, 3, 5)"),
        "upper_": (_v("UPPER", _P("c_name")), "upper(c_name)"),
        "lower_": (_v("LOWER", _P("c_mktsegment")), "lower(c_mktsegment)"),
        "trim_": (lambda: value("TRIM", F.concat(F.lit("  a   b "), F.col("c_name"))), "'a b ' || c_name"),
        "proper_": (_v("PROPER", _P("c_mktsegment")), "upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2))"),
        "concat_": (_v("CONCAT", _P("c_name"), "-", _P("c_mktsegment")), "c_name || '-' || c_mktsegment"),
        "textjoin_": (_v("TEXTJOIN", "; ", True, _P("c_name"), "", _P("c_mktsegment")), "c_name || '; ' || c_mktsegment"),
        "rept_": (_v("REPT", "*", _P("c_nationkey") % 4), "repeat('*', c_nationkey % 4)"),
        "find_": (_v("FIND", "U", _P("c_mktsegment")), "nullif(strpos(c_mktsegment, 'U'), 0)"),
        "search_": (_v("SEARCH", "u*n", _P("c_mktsegment")), "nullif(strpos(lower(c_mktsegment), regexp_extract(lower(c_mktsegment), 'u.*n')) * (lower(c_mktsegment) ~ '.*u.*n.*')::INT, 0)"),
        "find_error": (lambda: error("FIND", F.lit("U"), F.col("c_mktsegment")), "CASE WHEN strpos(c_mktsegment, 'U') = 0 THEN '#VALUE!' END"),
        "substitute_": (_v("SUBSTITUTE", _P("c_name"), "0", "o"), "replace(c_name, '0', 'o')"),
        "replace_": (_v("REPLACE", _P("c_name"), 2, 3, "__"), "left(c_name, 1) || '__' || substring(c_name, 5)"),
        "exact_": (lambda: value("EXACT", F.col("c_mktsegment"), F.lit("BUILDING")), "c_mktsegment = 'BUILDING'"),
        "code_": (_v("CODE", _P("c_name")), "unicode(c_name)"),
        "char_": (_v("CHAR", _P("c_nationkey") + 65), "chr(c_nationkey + 65)"),
        "unichar_": (_v("UNICHAR", _P("c_nationkey") + 945), "chr(c_nationkey + 945)"),
        "clean_": (lambda: value("CLEAN", F.concat(F.lit("\t"), F.col("c_name"))), "c_name"),
        "value_": (lambda: value("VALUE", F.concat(F.lit("$1,"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))), "1000.0 + c_nationkey"),
        "numbervalue_": (lambda: value("NUMBERVALUE", F.concat(F.col("c_nationkey").cast("string"), F.lit(",5")), ",", "."), "c_nationkey + 0.5"),
        "text_": (lambda: value("TEXT", F.col("c_nationkey"), "0.00"), "c_nationkey || '.00'"),
        "text_pad": (lambda: value("TEXT", F.col("c_nationkey"), "000"), "lpad(c_nationkey::VARCHAR, 3, '0')"),
        "fixed_": (lambda: value("FIXED", F.col("c_custkey") * 1000, 1), "replace(format('{:,}', c_custkey * 1000), ',', ',') || '.0'"),
        "before_": (_v("TEXTBEFORE", _P("c_name"), "#"), "CASE WHEN strpos(c_name, '#') > 0 THEN split_part(c_name, '#', 1) END"),
        "after_": (_v("TEXTAFTER", _P("c_name"), "#"), "CASE WHEN strpos(c_name, '#') > 0 THEN split_part(c_name, '#', 2) END"),
        "split_": (lambda: F.element_at(value("TEXTSPLIT", F.col("c_name"), "0"), 1)[0], "split_part(c_name, '0', 1)"),
        "regextest_": (lambda: value("REGEXTEST", F.col("c_name"), "[13579]$"), "regexp_matches(c_name, '[13579]$')"),
        "regexextract_": (lambda: value("REGEXEXTRACT", F.col("c_name"), "[1-9][0-9]*"), "nullif(regexp_extract(c_name, '[1-9][0-9]*'), '')"),
        "regexreplace_": (lambda: value("REGEXREPLACE", F.col("c_name"), "[0-9]", "#"), "regexp_replace(c_name, '[0-9]', '#', 'g')"),
        "dbcs_back": (lambda: value("ASC", value("DBCS", F.col("c_name"))), "c_name"),
    },
)

scalars(
    "date_functions",
    "orders",
    ["o_orderkey"],
    {
        "year_": (_v("YEAR", "o_orderdate"), "year(o_orderdate)::INT"),
        "month_": (_v("MONTH", "o_orderdate"), "month(o_orderdate)::INT"),
        "day_": (_v("DAY", "o_orderdate"), "day(o_orderdate)::INT"),
        "weekday_1": (_v("WEEKDAY", "o_orderdate"), "dayofweek(o_orderdate)::INT + 1"),
        "weekday_2": (_v("WEEKDAY", "o_orderdate", 2), "isodow(o_orderdate)::INT"),
        "weekday_3": (_v("WEEKDAY", "o_orderdate", 3), "isodow(o_orderdate)::INT - 1"),
        "isoweek": (_v("ISOWEEKNUM", "o_orderdate"), "weekofyear(o_orderdate)::INT"),
        "weeknum_": (_v("WEEKNUM", "o_orderdate"), "((dayofyear(o_orderdate) - 1 + dayofweek(date_trunc('year', o_orderdate))) // 7 + 1)::INT"),
        "edate_": (_v("EDATE", "o_orderdate", 13), "(o_orderdate + INTERVAL 13 MONTH)::DATE"),
        "eomonth_": (_v("EOMONTH", "o_orderdate", -1), "last_day(o_orderdate - INTERVAL 1 MONTH)"),
        "days_": (lambda: value("DAYS", F.lit("2002-01-01").cast("date"), "o_orderdate"), "date_diff('day', o_orderdate, DATE '2002-01-01')::INT"),
        "serial": (lambda: D.serial("o_orderdate"), "date_diff('day', DATE '1899-12-30', o_orderdate)::DOUBLE"),
        "date_": (lambda: value("DATE", F.year("o_orderdate"), F.lit(14), F.day("o_orderdate")), "(make_date(year(o_orderdate) + 1, 2, 1) + (day(o_orderdate) - 1)::INT)::DATE"),
        "datedif_m": (lambda: value("DATEDIF", "o_orderdate", F.lit("2001-12-31").cast("date"), "M"), "datesub('month', o_orderdate::DATE, DATE '2001-12-31')::INT"),
        "datedif_y": (lambda: value("DATEDIF", "o_orderdate", F.lit("2001-12-31").cast("date"), "Y"), "datesub('year', o_orderdate::DATE, DATE '2001-12-31')::INT"),
        "days360_": (lambda: value("DAYS360", "o_orderdate", F.lit("2001-12-15").cast("date"), True), "((2001 - year(o_orderdate)) * 360 + (12 - month(o_orderdate)) * 30 + 15 - least(day(o_orderdate), 30))::INT"),
        "yearfrac_2": (lambda: r(value("YEARFRAC", "o_orderdate", F.lit("2001-12-15").cast("date"), 2), 8), rs("date_diff('day', o_orderdate, DATE '2001-12-15') / 360", 8)),
        "yearfrac_3": (lambda: r(value("YEARFRAC", "o_orderdate", F.lit("2001-12-15").cast("date"), 3), 8), rs("date_diff('day', o_orderdate, DATE '2001-12-15') / 365", 8)),
        "networkdays_": (
            lambda: value("NETWORKDAYS", F.col("o_orderdate"), F.date_add(F.col("o_orderdate").cast("date"), 40)),
            "len(list_filter(generate_series(o_orderdate, o_orderdate + INTERVAL 40 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6))::INT",
        ),
        "workday_": (
            lambda: value("WORKDAY", F.col("o_orderdate"), 10),
            "(list_filter(generate_series(o_orderdate + INTERVAL 1 DAY, o_orderdate + INTERVAL 20 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 6))[10]::DATE",
        ),
        "workday_back": (
            lambda: value("WORKDAY.INTL", F.col("o_orderdate"), -5, 11),
            "(list_reverse(list_filter(generate_series(o_orderdate - INTERVAL 20 DAY, o_orderdate - INTERVAL 1 DAY, INTERVAL 1 DAY), lambda d: isodow(d) < 7)))[5]::DATE",
        ),
        "datevalue_": (lambda: value("DATEVALUE", F.date_format("o_orderdate", "M/d/yyyy")), "date_diff('day', DATE '1899-12-30', o_orderdate)::DOUBLE"),
        "text_date": (lambda: value("TEXT", F.col("o_orderdate"), "dd/mm/yyyy"), "strftime(o_orderdate, '%d/%m/%Y')"),
    },
)

scalars(
    "time_functions",
    "events",
    ["event_id"],
    {
        "hour_": (_v("HOUR", "ts"), "hour(ts)::INT"),
        "minute_": (_v("MINUTE", "ts"), "minute(ts)::INT"),
        "second_": (_v("SECOND", "ts"), "second(ts)::INT"),
        "time_": (lambda: r(value("TIME", F.hour("ts"), F.minute("ts"), F.second("ts")), 8), rs("(hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400", 8)),
        "timevalue_": (lambda: r(value("TIMEVALUE", F.date_format("ts", "h:mm a")), 8), rs("(hour(ts) * 60 + minute(ts)) / 1440", 8)),
    },
)

scalars(
    "logic_functions",
    "part",
    ["p_partkey"],
    {
        "and_": (lambda: value("AND", F.col("p_size") > 10, F.col("p_size") < 40), "p_size > 10 AND p_size < 40"),
        "or_": (lambda: value("OR", F.col("p_size") < 10, F.col("p_size") > 40), "p_size < 10 OR p_size > 40"),
        "not_": (lambda: value("NOT", F.col("p_size") > 10), "NOT p_size > 10"),
        "xor_": (lambda: value("XOR", F.col("p_size") > 10, F.col("p_size") > 30), "xor((p_size > 10)::INT, (p_size > 30)::INT) = 1"),
        "if_": (lambda: value("IF", F.col("p_size") > 25, F.lit("big"), F.lit("small")), "CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END"),
        "ifs_": (lambda: value("IFS", F.col("p_size") < 10, F.lit("a"), F.col("p_size") < 20, F.lit("b")), "CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' END"),
        "ifs_error": (lambda: error("IFS", F.col("p_size") < 10, F.lit("a"), F.col("p_size") < 20, F.lit("b")), "CASE WHEN p_size >= 20 THEN '#N/A' END"),
        "switch_": (lambda: value("SWITCH", F.col("p_type"), "economy", 1, "STANDARD", 2, 0), "CASE upper(p_type) WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 0 END"),
        "choose_": (lambda: value("CHOOSE", F.col("p_size") % 4, F.lit("x"), F.lit("y"), F.lit("z")), "CASE p_size % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'y' WHEN 3 THEN 'z' END"),
        "iferror_": (lambda: value("IFERROR", cell("LN", F.col("p_size") - 20), -1.0).cast("double").isNotNull(), "true"),
        "isna_": (lambda: value("ISNA", cell("IFS", F.col("p_size") < 10, F.lit("a"))), "p_size >= 10"),
        "errortype": (lambda: value("ERROR.TYPE", cell("SQRT", F.col("p_size") - 20)), "CASE WHEN p_size < 20 THEN 6 END"),
        "iseven_": (_v("ISEVEN", "p_size"), "p_size % 2 = 0"),
        "isodd_": (_v("ISODD", "p_size"), "p_size % 2 = 1"),
        "isblank_": (_v("ISBLANK", "p_name"), "p_name IS NULL"),
        "isnumber_": (_v("ISNUMBER", "p_size"), "true"),
        "istext_": (_v("ISTEXT", "p_name"), "true"),
        "isnontext_": (_v("ISNONTEXT", "p_size"), "true"),
        "n_": (_v("N", "p_size"), "p_size::DOUBLE"),
        "type_": (_v("TYPE", "p_name"), "2"),
        "let_": (lambda: value("LET", [("a", lambda: F.col("p_size") + 1), ("b", lambda a: a * 2)], lambda a, b: a + b), "(p_size + 1) * 3"),
        "map_": (lambda: value("MAP", F.array(F.col("p_size"), F.lit(2)), lambda x: x * 10), "[p_size * 10, 20]"),
        "reduce_": (lambda: value("REDUCE", 0, F.array(F.col("p_size"), F.lit(2)), lambda a, x: a + x), "p_size + 2"),
        "scan_": (lambda: value("SCAN", F.lit(0.0), F.array(F.col("p_size").cast("double"), F.lit(2.0)), lambda a, x: a + x), "[p_size::DOUBLE, p_size + 2.0]"),
        "lambda_": (lambda: value("LAMBDA", lambda x, y: x * y, F.col("p_size"), F.lit(3)), "p_size * 3"),
    },
)


@query("complex_numbers")
def complex_numbers(spark, folder):
    df = table(spark, folder, "supplier").select("s_suppkey", value("COMPLEX", F.col("s_suppkey") % 7 - 3, F.col("s_suppkey") % 5 - 2).alias("z"))
    one = ("IMREAL", "IMAGINARY", "IMABS", "IMARGUMENT", "IMCONJUGATE", "IMSQRT", "IMEXP", "IMLN", "IMLOG10", "IMLOG2", "IMSIN", "IMCOS", "IMTAN", "IMSINH", "IMCOSH", "IMSEC", "IMSECH", "IMCSC", "IMCSCH", "IMCOT")
    two = ("IMSUM", "IMSUB", "IMPRODUCT", "IMDIV")
    return df.select(
        "s_suppkey", "z", *(value(n, F.col("z")).alias(n.lower()) for n in one), *(value(n, F.col("z"), F.lit("1-2i")).alias(n.lower()) for n in two),
        value("IMPOWER", F.col("z"), 3).alias("impower"),
    )


@query("error_bessel_functions")
def error_bessel_functions(spark, folder):
    x = F.col("s_suppkey") % 30 / 10.0 + 0.1
    return table(spark, folder, "supplier").select(
        "s_suppkey", *(value(n, x).alias(n.lower().replace(".", "_")) for n in ("ERF", "ERF.PRECISE", "ERFC", "ERFC.PRECISE")),
        *(value(n, x, 1).alias(n.lower()) for n in ("BESSELJ", "BESSELI", "BESSELK", "BESSELY")),
    )


@query("small_matrices")
def small_matrices(spark, folder):
    k = F.col("n_nationkey").cast("double")
    m = F.array(F.array(k + 1, F.lit(2.0)), F.array(F.lit(3.0), k + 5))
    df = table(spark, folder, "nation").select("n_nationkey", m.alias("m"))
    inverse = value("MINVERSE", F.col("m"))
    return df.select("n_nationkey", value("MDETERM", F.col("m")).alias("mdeterm"), inverse.alias("minverse"), value("MMULT", F.col("m"), F.col("m")).alias("mmult"), value("TRANSPOSE", F.col("m")).alias("transpose"))


@query("random_numbers")
def random_numbers(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", value("RAND", 7).alias("rand"), value("RANDBETWEEN", 1, 6, 8).alias("randbetween"), value("RANDARRAY", 2, 2, 0, 1, False, 9, F.col("n_nationkey")).alias("randarray"))
