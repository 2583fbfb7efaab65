"""Scalar mathematics, number bases, rounding, and small matrices held in arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import DIV0, NUM, VALUE, function, num

FAMILY = "math"


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


def _pow10(d) -> Column:
    return F.pow(F.lit(10.0), F.round(num(d), 0))


def whole(x) -> Column:
    """Towards zero."""
    x = num(x)
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


def half_away(x) -> Column:
    """To the nearest whole number, halves away from zero, on the binary value."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")


_neg = lambda x, *_: num(x) < 0
_nonpos = lambda x, *_: num(x) <= 0

for _name, _fn in {
    "ABS": F.abs, "EXP": F.exp, "SIGN": F.signum, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "ATAN": F.atan, "SINH": F.sinh,
    "COSH": F.cosh, "TANH": F.tanh, "ASINH": F.asinh, "DEGREES": F.degrees, "RADIANS": F.radians, "SEC": F.sec,
}.items():
    _f(_name)(lambda x, fn=_fn: fn(num(x)))

_f("SQRT", (_neg, NUM))(lambda x: F.sqrt(num(x)))
_f("LN", (_nonpos, NUM))(lambda x: F.ln(num(x)))
_f("LOG10", (_nonpos, NUM))(lambda x: F.log10(num(x)))
_f("LOG", (lambda x, b=10.0: (num(x) <= 0) | (num(b) <= 0), NUM), (lambda x, b=10.0: num(b) == 1, DIV0))(
    lambda x, b=10.0: F.ln(num(x)) / F.ln(num(b))
)
_f("ASIN", (lambda x: F.abs(num(x)) > 1, NUM))(lambda x: F.asin(num(x)))
_f("ACOS", (lambda x: F.abs(num(x)) > 1, NUM))(lambda x: F.acos(num(x)))
_f("ACOSH", (lambda x: num(x) < 1, NUM))(lambda x: F.acosh(num(x)))
_f("ATANH", (lambda x: F.abs(num(x)) >= 1, NUM))(lambda x: F.atanh(num(x)))
_f("ATAN2", (lambda x, y: (num(x) == 0) & (num(y) == 0), DIV0))(lambda x, y: F.atan2(num(y), num(x)))
_f("ACOT")(lambda x: F.lit(math.pi / 2) - F.atan(num(x)))
_f("ACOTH", (lambda x: F.abs(num(x)) <= 1, NUM))(lambda x: 0.5 * F.ln((num(x) + 1) / (num(x) - 1)))
for _name, _fn in {"CSC": F.sin, "COT": F.tan, "CSCH": F.sinh, "COTH": F.tanh}.items():
    _f(_name, (lambda x: num(x) == 0, DIV0))(lambda x, fn=_fn: F.lit(1.0) / fn(num(x)))
_f("SECH")(lambda x: F.lit(1.0) / F.cosh(num(x)))
_f("PI")(lambda: F.lit(math.pi))
_f("SQRTPI", (_neg, NUM))(lambda x: F.sqrt(num(x) * math.pi))
_f("INT")(lambda x: F.floor(num(x)).cast("double"))


@_f("MOD", (lambda x, y: num(y) == 0, DIV0))
def mod(x, y) -> Column:
    """The remainder with the sign of the divisor."""
    return num(x) - num(y) * F.floor(F.try_divide(num(x), num(y)))


@_f("QUOTIENT", (lambda x, y: num(y) == 0, DIV0))
def quotient(x, y) -> Column:
    return whole(F.try_divide(num(x), num(y)))


@_f("POWER", (lambda x, p: (num(x) == 0) & (num(p) == 0), NUM), (lambda x, p: (num(x) == 0) & (num(p) < 0), DIV0))
def power(x, p) -> Column:
    """A negative base has a real power for whole exponents and for odd roots."""
    x, p = num(x), num(p)
    root = F.try_divide(F.lit(1.0), p)
    nearest = F.round(root, 0)
    odd = (F.abs(root - nearest) < 1e-9) & (F.pmod(F.abs(nearest), F.lit(2.0)) == 1)
    out = F.when((x < 0) & (p != F.floor(p)) & odd, -F.pow(-x, p)).otherwise(F.pow(x, p))
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)


@_f("ROUND")
def round_(x, d=0) -> Column:
    """Scale, round half away from zero, scale back."""
    return half_away(num(x) * _pow10(d)) / _pow10(d)


@_f("ROUNDUP")
def roundup(x, d=0) -> Column:
    x = num(x)
    return F.signum(x) * F.ceil(F.abs(x) * _pow10(d)) / _pow10(d)


@_f("ROUNDDOWN")
def rounddown(x, d=0) -> Column:
    x = num(x)
    return F.signum(x) * F.floor(F.abs(x) * _pow10(d)) / _pow10(d)


_f("TRUNC")(rounddown)


@_f("EVEN")
def even(x) -> Column:
    x = num(x)
    return F.signum(x) * 2 * F.ceil(F.abs(x) / 2)


@_f("ODD")
def odd(x) -> Column:
    x = num(x)
    return F.when(x == 0, 1.0).otherwise(F.signum(x) * (2 * F.ceil((F.abs(x) + 1) / 2) - 1))


@_f("CEILING", (lambda x, s: (num(x) > 0) & (num(s) < 0), NUM))
def ceiling(x, s) -> Column:
    return F.when(num(s) == 0, 0.0).otherwise(F.ceil(F.try_divide(num(x), num(s))) * num(s))


@_f("FLOOR", (lambda x, s: (num(x) > 0) & (num(s) < 0), NUM), (lambda x, s: num(s) == 0, DIV0))
def floor(x, s) -> Column:
    q = F.try_divide(num(x), num(s))
    return F.when(num(s) < 0, F.ceil(q)).otherwise(F.floor(q)) * num(s)


@_f("CEILING.MATH")
def ceiling_math(x, s=1.0, mode=0) -> Column:
    x, s = num(x), F.abs(num(s))
    q = F.try_divide(x, s)
    return F.when(s == 0, 0.0).otherwise(F.when((x < 0) & (num(mode) != 0), F.floor(q)).otherwise(F.ceil(q)) * s)


@_f("FLOOR.MATH")
def floor_math(x, s=1.0, mode=0) -> Column:
    x, s = num(x), F.abs(num(s))
    q = F.try_divide(x, s)
    return F.when(s == 0, 0.0).otherwise(F.when((x < 0) & (num(mode) != 0), F.ceil(q)).otherwise(F.floor(q)) * s)


_f("CEILING.PRECISE")(lambda x, s=1.0: ceiling_math(x, s))
_f("ISO.CEILING")(lambda x, s=1.0: ceiling_math(x, s))
_f("FLOOR.PRECISE")(lambda x, s=1.0: floor_math(x, s))


@_f("MROUND", (lambda x, m: num(x) * num(m) < 0, NUM))
def mround(x, m) -> Column:
    return F.when(num(m) == 0, 0.0).otherwise(half_away(F.try_divide(num(x), num(m))) * num(m))


# -- counting ------------------------------------------------------------------------------------------------------


def _choose(n: Column, k: Column) -> Column:
    """n choose k of whole columns, as a product that stays exact while it fits a double."""
    k = F.least(k, n - k)
    terms = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.round(F.reduce(terms, F.lit(1.0), lambda acc, i: acc * (n - k + i) / i), 0)


def _fact(n: Column) -> Column:
    terms = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.reduce(terms, F.lit(1.0), lambda acc, i: acc * i)


_f("FACT", (_neg, NUM), (lambda n: num(n) > 170, NUM))(lambda n: _fact(whole(n)))
_bad_choice = (lambda n, k: (num(n) < 0) | (num(k) < 0) | (whole(n) < whole(k)), NUM)
_f("COMBIN", _bad_choice)(lambda n, k: _choose(whole(n), whole(k)))
_f("COMBINA", (lambda n, k: (num(n) < 0) | (num(k) < 0), NUM))(
    lambda n, k: F.when(whole(n) + whole(k) == 0, 1.0).otherwise(_choose(whole(n) + whole(k) - 1, whole(k)))
)


@_f("PERMUT", _bad_choice)
def permut(n, k) -> Column:
    n, k = whole(n), whole(k)
    terms = F.when(k >= 1, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.reduce(terms, F.lit(1.0), lambda acc, i: acc * (n - i))


_f("PERMUTATIONA", (lambda n, k: (num(n) < 0) | (num(k) < 0), NUM))(lambda n, k: F.pow(whole(n), whole(k)))


@_f("FACTDOUBLE", (lambda n: num(n) < -1, NUM))
def factdouble(n) -> Column:
    n = whole(n)
    terms = F.when(n >= 1, F.sequence(n.cast("int"), F.lit(1), F.lit(-2))).otherwise(F.array().cast("array<int>"))
    terms = F.when(F.pmod(n, F.lit(2.0)) == 0, F.when(n >= 2, F.sequence(n.cast("int"), F.lit(2), F.lit(-2))).otherwise(F.array().cast("array<int>"))).otherwise(terms)
    return F.reduce(terms, F.lit(1.0), lambda acc, i: acc * i)


@_f("MULTINOMIAL")
def multinomial(*xs) -> Column:
    """(sum)! / product of factorials, as a product of binomials."""
    out, total = F.lit(1.0), F.lit(0.0)
    for x in xs:
        total = total + whole(x)
        out = out * _choose(total, whole(x))
    return out


def _gcd2(a: Column, b: Column) -> Column:
    """Euclid's steps as a fold; a pair below 2**53 is done within 78 of them."""
    step = F.reduce(
        F.sequence(F.lit(1), F.lit(78)),
        F.struct(a.alias("a"), b.alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b"))),
    )
    return step["a"]


@_f("GCD", (lambda *xs: _any_negative(xs), NUM))
def gcd(*xs) -> Column:
    out = whole(xs[0])
    for x in xs[1:]:
        out = _gcd2(out, whole(x))
    return out


@_f("LCM", (lambda *xs: _any_negative(xs), NUM))
def lcm(*xs) -> Column:
    out = whole(xs[0])
    for x in xs[1:]:
        x = whole(x)
        out = F.when((out == 0) | (x == 0), 0.0).otherwise(F.try_divide(out, _gcd2(out, x)) * x)
    return out


def _any_negative(xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | (num(x) < 0)
    return out


# -- number bases --------------------------------------------------------------------------------------------------

#: Binary digits that the two's complement of each base has.
_WIDTH = {2: 10, 8: 30, 16: 40}
_NAME = {2: "BIN", 8: "OCT", 16: "HEX"}


def _to_base(n: Column, base: int, places) -> Column:
    limit = 2 ** _WIDTH[base]
    digits = F.upper(F.conv(F.when(n < 0, n + limit).otherwise(n).cast("bigint").cast("string"), 10, base))
    if places is None:
        return digits
    return F.when(n < 0, digits).otherwise(F.lpad(digits, int(places) if not isinstance(places, Column) else places, "0"))


def _from_base(text: Column, base: int) -> Column:
    n = F.conv(text.cast("string"), base, 10).cast("double")
    limit = 2 ** _WIDTH[base]
    return F.when(n >= limit / 2, n - limit).otherwise(n)


def _outside(base: int):
    half = 2 ** (_WIDTH[base] - 1)
    return lambda n, *_: (whole(n) < -half) | (whole(n) >= half), NUM


def _bad_digits(base: int):
    allowed = {2: "[01]{1,10}", 8: "[0-7]{1,10}", 16: "[0-9A-Fa-f]{1,10}"}[base]
    return lambda t, *_: ~t.cast("string").rlike(f"^{allowed}$"), NUM


for _base in (2, 8, 16):
    _f(f"DEC2{_NAME[_base]}", _outside(_base))(lambda n, places=None, b=_base: _to_base(whole(n), b, places))
    _f(f"{_NAME[_base]}2DEC", _bad_digits(_base))(lambda t, b=_base: _from_base(t, b))
    for _to in (2, 8, 16):
        if _to != _base:
            function(
                f"{_NAME[_base]}2{_NAME[_to]}",
                _bad_digits(_base),
                (lambda t, places=None, a=_base, b=_to: _outside(b)[0](_from_base(t, a)), NUM),
                family="engineering",
            )(lambda t, places=None, a=_base, b=_to: _to_base(_from_base(t, a), b, places))


@_f("BASE", (lambda n, radix, *_: (num(n) < 0) | (num(radix) < 2) | (num(radix) > 36), NUM))
def base_(n, radix: int, min_length: int = 0) -> Column:
    digits = F.upper(F.conv(whole(n).cast("bigint").cast("string"), 10, radix))
    return F.when(F.length(digits) < min_length, F.lpad(digits, min_length, "0")).otherwise(digits)


@_f("DECIMAL")
def decimal(text, radix: int) -> Column:
    return F.conv(text, radix, 10).cast("double")


# The Roman letters, and those of one decimal place for each digit as places among (one, five, ten).
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
_ROMAN_DIGITS = ["", "0", "00", "000", "01", "1", "10", "100", "1000", "02"]
_ROMAN_PLACES = ["IVX", "XLC", "CDM", "M"]


@_f("ROMAN", (lambda n: (whole(n) < 0) | (whole(n) > 3999), VALUE))
def roman(n) -> Column:
    n, parts = whole(n), []
    for place in (3, 2, 1, 0):
        letters = _ROMAN_PLACES[place]
        words = [
            "".join(letters[int(k)] for k in digit) if all(int(k) < len(letters) for k in digit) else "" for digit in _ROMAN_DIGITS
        ]
        parts.append(F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.floor(n / 10**place), F.lit(10)) + 1).cast("int")))
    return F.concat(*parts)


@_f("ARABIC", (lambda t: ~F.upper(F.trim(t)).rlike("^-?[MDCLXVI]*$"), VALUE))
def arabic(t) -> Column:
    """A letter before a larger one counts negative."""
    t = F.upper(F.trim(t))
    worth = F.create_map(*(F.lit(x) for letter, size in _ROMAN.items() for x in (letter, float(size))))
    values = F.transform(F.split(F.replace(t, F.lit("-"), F.lit("")), ""), lambda c: F.coalesce(F.try_element_at(worth, c), F.lit(0.0)))
    total = F.reduce(
        F.reverse(values),
        F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("most")),
        lambda s, v: F.struct((s["sum"] + F.when(v < s["most"], -v).otherwise(v)).alias("sum"), F.greatest(s["most"], v).alias("most")),
    )["sum"]
    return F.when(F.startswith(t, F.lit("-")), -total).otherwise(total)


@_f("SERIESSUM")
def seriessum(x, n, m, coefficients: Column) -> Column:
    terms = F.transform(coefficients, lambda c, i: c.cast("double") * F.pow(num(x), num(n) + i * num(m)))
    return F.reduce(terms, F.lit(0.0), lambda acc, t: acc + t)


# -- random numbers ------------------------------------------------------------------------------------------------


@_f("RAND")
def rand(seed: int) -> Column:
    """Uniform in [0, 1); the seed is required, so that a plan gives the same numbers each time."""
    return F.rand(seed)


@_f("RANDBETWEEN", (lambda a, b, seed: num(a) > num(b), NUM))
def randbetween(a, b, seed: int) -> Column:
    low, high = F.ceil(num(a)), F.floor(num(b))
    return (low + F.floor(F.rand(seed) * (high - low + 1))).cast("double")


@_f("RANDARRAY")
def randarray(rows: int, columns: int, low, high, whole_number: bool, seed: int, key: Column) -> Column:
    """An array of arrays of uniform numbers, made from hashes of ``key``, the seed and the place."""
    width = num(high) - num(low)

    def one(i: Column) -> Column:
        u = F.pmod(F.xxhash64(key, F.lit(seed), i), F.lit(2**53)) / float(2**53)
        return F.floor(num(low) + u * (width + 1)).cast("double") if whole_number else num(low) + u * width

    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: one(r * columns + c)))


@_f("SEQUENCE")
def sequence(rows: int, columns: int = 1, start=1.0, step=1.0) -> Column:
    cell = lambda r, c: num(start) + num(step) * (r * columns + c)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: cell(r, c)))


@_f("MUNIT")
def munit(n: int) -> Column:
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(steps, lambda r: F.transform(steps, lambda c: F.when(r == c, 1.0).otherwise(0.0)))
