"""Bits, error and Bessel functions, complex numbers and unit conversion."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import special as S
from tabulon.functions.math import whole
from tabulon.functions.registry import NA, NUM, function, num, once
from tabulon.functions.text import shown_number, txt
from tabulon.functions.vector import vector

FAMILY = "engineering"


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


# -- bits: whole numbers from 0 below 2**48 ------------------------------------------------------------------------


def _not_bits(*xs) -> Column:
    out = F.lit(False)
    for x in xs:
        out = out | (num(x) < 0) | (num(x) >= 2.0**48) | (num(x) != F.floor(num(x)))
    return out


def _big(x) -> Column:
    return num(x).cast("bigint")


_f("BITAND", (_not_bits, NUM))(lambda a, b: _big(a).bitwiseAND(_big(b)).cast("double"))
_f("BITOR", (_not_bits, NUM))(lambda a, b: _big(a).bitwiseOR(_big(b)).cast("double"))
_f("BITXOR", (_not_bits, NUM))(lambda a, b: _big(a).bitwiseXOR(_big(b)).cast("double"))
_bad_shift = (lambda a, n: _not_bits(a) | (F.abs(num(n)) > 53), NUM)
_f("BITLSHIFT", _bad_shift)(lambda a, n: F.floor(num(a) * F.pow(F.lit(2.0), whole(n))).cast("double"))
_f("BITRSHIFT", _bad_shift)(lambda a, n: F.floor(num(a) / F.pow(F.lit(2.0), whole(n))).cast("double"))
_f("DELTA")(lambda a, b=0.0: (num(a) == num(b)).cast("int"))
_f("GESTEP")(lambda x, step=0.0: (num(x) >= num(step)).cast("int"))

_f("ERF")(lambda a, b=None: vector(S.erf, a) if b is None else vector(S.erf, b) - vector(S.erf, a))
_f("ERF.PRECISE")(lambda x: vector(S.erf, x))
_f("ERFC")(lambda x: vector(S.erfc, x))
_f("ERFC.PRECISE")(lambda x: vector(S.erfc, x))
_bad_order = (lambda x, n: num(n) < 0, NUM)
_f("BESSELJ", _bad_order)(lambda x, n: vector(S.bessel_j, x, n))
_f("BESSELI", _bad_order)(lambda x, n: vector(S.bessel_i, x, n))
_f("BESSELK", _bad_order, (lambda x, n: num(x) <= 0, NUM))(lambda x, n: vector(S.bessel_k, x, n))
_f("BESSELY", _bad_order, (lambda x, n: num(x) <= 0, NUM))(lambda x, n: vector(S.bessel_y, x, n))

# -- complex numbers: text such as 3+4i in, text out; inside, a pair of columns ------------------------------------

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


_IMAGINARY = f"^({_NUMBER})?([+-]?(?:(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)?)[ij]$"

_Pair = tuple[Column, Column]


def parsed(t) -> Column:
    """struct(re, im) of a complex text; null parts where it is none."""

    def split(t: Column) -> Column:
        body, unit = F.regexp_extract(t, _IMAGINARY, 1), F.regexp_extract(t, _IMAGINARY, 2)
        plain = t.rlike(f"^{_NUMBER}$")
        # A lone imaginary part such as 4i is matched as the first number with nothing before the unit.
        lone = (unit == "") & (body != "")
        coefficient = F.when(unit.isin("", "+"), "1").when(unit == "-", "-1").otherwise(unit)
        none = F.lit(None).cast("string")
        good = plain | t.rlike(_IMAGINARY)
        re = F.when(~good, none).when(plain, t).when(lone | (body == ""), "0").otherwise(body)
        im = F.when(~good, none).when(plain, "0").when(lone, body).otherwise(coefficient)
        return F.struct(re.try_cast("double").alias("re"), im.try_cast("double").alias("im"))

    return once(F.trim(txt(t)), split)


def _no_complex(*ts) -> Column:
    out = F.lit(False)
    for t in ts:
        out = out | ~(txt(t).rlike(_IMAGINARY) | F.trim(txt(t)).rlike(f"^{_NUMBER}$"))
    return out


def complex_text(re: Column, im: Column, suffix: str = "i") -> Column:
    """15 significant digits of each part; a part that is zero is left out."""

    def digits(x: Column) -> Column:
        scale = F.pow(F.lit(10.0), 14 - F.floor(F.log10(F.abs(x))))
        return F.when(x == 0, 0.0).otherwise(F.round(x * scale, 0) / scale)

    def shown(z: Column) -> Column:
        re, im = z["re"], z["im"]
        unit = F.when(im == 1, "").when(im == -1, "-").otherwise(shown_number(im))
        plus = F.when((re != 0) & (im > 0), "+").otherwise("")
        return F.when(im == 0, shown_number(re)).otherwise(F.concat(F.when(re == 0, "").otherwise(shown_number(re)), plus, unit, F.lit(suffix)))

    rounded = lambda z: F.struct(digits(z["re"]).alias("re"), digits(z["im"]).alias("im"))
    return once(once(F.struct(re.alias("re"), im.alias("im")), rounded), shown)


_f("COMPLEX")(lambda re, im, suffix="i": complex_text(num(re), num(im), suffix))
_wrong = (lambda *ts: _no_complex(*ts), NUM)


def _of(f):
    """A column of f(re, im), the text parsed once."""
    return lambda t: once(parsed(t), lambda z: f(z["re"], z["im"]))


def _complex(f):
    """The text of a function of one complex number, given as a pair."""
    return lambda t: once(parsed(t), lambda z: complex_text(*f((z["re"], z["im"]))))


def _complex2(f):
    return lambda a, b: once(F.struct(parsed(a).alias("a"), parsed(b).alias("b")), lambda z: complex_text(*f((z["a"]["re"], z["a"]["im"]), (z["b"]["re"], z["b"]["im"]))))


_f("IMREAL", _wrong)(_of(lambda re, im: re))
_f("IMAGINARY", _wrong)(_of(lambda re, im: im))
_f("IMABS", _wrong)(_of(F.hypot))
_f("IMARGUMENT", _wrong)(_of(lambda re, im: F.atan2(im, re)))
_f("IMCONJUGATE", _wrong)(_complex(lambda z: (z[0], -z[1])))


def _mul(a: _Pair, b: _Pair) -> _Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _div(a: _Pair, b: _Pair) -> _Pair:
    size = b[0] * b[0] + b[1] * b[1]
    return F.try_divide(a[0] * b[0] + a[1] * b[1], size), F.try_divide(a[1] * b[0] - a[0] * b[1], size)


def _polar(r: Column, angle: Column) -> _Pair:
    return r * F.cos(angle), r * F.sin(angle)


def _log(z: _Pair, base: float = math.e) -> _Pair:
    return F.ln(F.hypot(*z)) / math.log(base), F.atan2(z[1], z[0]) / math.log(base)


def _sin(z: _Pair) -> _Pair:
    return F.sin(z[0]) * F.cosh(z[1]), F.cos(z[0]) * F.sinh(z[1])


def _cos(z: _Pair) -> _Pair:
    return F.cos(z[0]) * F.cosh(z[1]), -F.sin(z[0]) * F.sinh(z[1])


def _sinh(z: _Pair) -> _Pair:
    return F.sinh(z[0]) * F.cos(z[1]), F.cosh(z[0]) * F.sin(z[1])


def _cosh(z: _Pair) -> _Pair:
    return F.cosh(z[0]) * F.cos(z[1]), F.sinh(z[0]) * F.sin(z[1])


def _inverse(f):
    return lambda z: _div((F.lit(1.0), F.lit(0.0)), f(z))


def _folded(step):
    def run(*ts) -> Column:
        pairs = F.array(*map(parsed, ts))
        total = F.reduce(
            F.slice(pairs, 2, len(ts)),
            F.element_at(pairs, 1),
            lambda a, b: F.struct(*(c.alias(n) for c, n in zip(step((a["re"], a["im"]), (b["re"], b["im"])), ("re", "im"), strict=True))),
        )
        return once(total, lambda z: complex_text(z["re"], z["im"]))

    return run


_f("IMSUM", _wrong)(_folded(lambda a, b: (a[0] + b[0], a[1] + b[1])))
_f("IMPRODUCT", _wrong)(_folded(_mul))
_f("IMSUB", _wrong)(_complex2(lambda a, b: (a[0] - b[0], a[1] - b[1])))
_f("IMDIV", _wrong, (lambda a, b: _of(F.hypot)(b) == 0, NUM))(_complex2(_div))
_f("IMPOWER", (lambda t, n: _no_complex(t), NUM))(
    lambda t, n: once(parsed(t), lambda z: complex_text(*_polar(F.pow(F.hypot(z["re"], z["im"]), num(n)), F.atan2(z["im"], z["re"]) * num(n))))
)
_f("IMSQRT", _wrong)(_complex(lambda z: _polar(F.sqrt(F.hypot(*z)), F.atan2(z[1], z[0]) / 2)))
_f("IMEXP", _wrong)(_complex(lambda z: _polar(F.exp(z[0]), z[1])))
_zero = (lambda t: _of(F.hypot)(t) == 0, NUM)
_f("IMLN", _wrong, _zero)(_complex(_log))
_f("IMLOG10", _wrong, _zero)(_complex(lambda z: _log(z, 10)))
_f("IMLOG2", _wrong, _zero)(_complex(lambda z: _log(z, 2)))
for _name, _fn in {
    "IMSIN": _sin, "IMCOS": _cos, "IMSINH": _sinh, "IMCOSH": _cosh, "IMTAN": lambda z: _div(_sin(z), _cos(z)), "IMSEC": _inverse(_cos), "IMSECH": _inverse(_cosh),
}.items():
    _f(_name, _wrong)(_complex(_fn))
for _name, _fn in {"IMCOT": lambda z: _div(_cos(z), _sin(z)), "IMCSC": _inverse(_sin), "IMCSCH": _inverse(_sinh)}.items():
    _f(_name, _wrong, _zero)(_complex(_fn))

# -- units ---------------------------------------------------------------------------------------------------------

# The size of each unit in its dimension's base unit.
_UNITS = {
    "mass": {"g": 1, "sg": 14593.9029372064, "lbm": 453.59237, "u": 1.66053886e-24, "ozm": 28.349523125, "grain": 0.06479891, "cwt": 45359.237, "uk_cwt": 50802.34544, "stone": 6350.29318, "ton": 907184.74, "uk_ton": 1016046.9088},
    "distance": {"m": 1, "mi": 1609.344, "Nmi": 1852, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "ang": 1e-10, "ell": 1.143, "ly": 9.46073047258e15, "parsec": 3.08567758128155e16, "pc": 3.08567758128155e16, "Pica": 0.0254 / 72, "Picapt": 0.0254 / 72, "pica": 0.0254 / 6, "survey_mi": 1609.347218694438},
    "time": {"sec": 1, "s": 1, "mn": 60, "min": 60, "hr": 3600, "day": 86400, "d": 86400, "yr": 31557600},
    "pressure": {"Pa": 1, "p": 1, "atm": 101325, "at": 101325, "mmHg": 133.322, "psi": 6894.757293168, "Torr": 133.3223684211},
    "force": {"N": 1, "dyn": 1e-5, "dy": 1e-5, "lbf": 4.4482216152605, "pond": 0.00980665},
    "energy": {"J": 1, "e": 1e-7, "c": 4.184, "cal": 4.1868, "eV": 1.602176487e-19, "ev": 1.602176487e-19, "HPh": 2684519.537696173, "hh": 2684519.537696173, "Wh": 3600, "wh": 3600, "flb": 1.3558179483314, "BTU": 1055.05585262, "btu": 1055.05585262},
    "power": {"W": 1, "w": 1, "HP": 745.69987158227, "h": 745.69987158227, "PS": 735.49875},
    "magnetism": {"T": 1, "ga": 1e-4},
    "volume": {"l": 1e-3, "L": 1e-3, "lt": 1e-3, "m3": 1, "m^3": 1, "tsp": 4.92892159375e-6, "tspm": 5e-6, "tbs": 1.478676478125e-5, "oz": 2.95735295625e-5, "cup": 2.365882365e-4, "pt": 4.73176473e-4, "us_pt": 4.73176473e-4, "uk_pt": 5.6826125e-4, "qt": 9.46352946e-4, "uk_qt": 1.1365225e-3, "gal": 3.785411784e-3, "uk_gal": 4.54609e-3, "ft3": 0.028316846592, "in3": 1.6387064e-5, "yd3": 0.764554857984, "barrel": 0.158987294928, "bushel": 0.03523907016688},
    "area": {"m2": 1, "m^2": 1, "ha": 1e4, "ar": 100, "uk_acre": 4046.8564224, "us_acre": 4046.87260987425, "ft2": 0.09290304, "in2": 6.4516e-4, "yd2": 0.83612736, "mi2": 2589988.110336, "Morgen": 2500},
    "information": {"bit": 1, "byte": 8},
    "speed": {"m/s": 1, "m/sec": 1, "m/h": 1 / 3600, "m/hr": 1 / 3600, "mph": 0.44704, "kn": 1852 / 3600, "admkn": 0.514773333333333},
}
# Metric and binary prefixes.
_PREFIXES = {"Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 10, "e": 10, "d": 0.1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15, "a": 1e-18, "z": 1e-21, "y": 1e-24}
_BINARY = {"ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60, "Zi": 2.0**70, "Yi": 2.0**80}
_METRIC = frozenset("g u m ang ly parsec pc sec s Pa p atm at mmHg N dyn dy J e c cal eV ev Wh wh W w T ga l L lt m3 m^3 m2 m^2 ar bit byte m/s m/sec m/h m/hr".split())
# Temperature scales as (factor, offset) to kelvin.
_HEAT = {"K": (1.0, 0.0), "kel": (1.0, 0.0), "C": (1.0, 273.15), "cel": (1.0, 273.15), "F": (5 / 9, 459.67 * 5 / 9), "fah": (5 / 9, 459.67 * 5 / 9), "Rank": (5 / 9, 0.0), "Reau": (1.25, 273.15)}


def unit(name: str) -> tuple[str, float, float] | None:
    """(dimension, factor, offset) of a unit, with or without a prefix."""
    if name in _HEAT:
        return ("temperature", *_HEAT[name])
    for dimension, units in _UNITS.items():
        if name in units:
            return dimension, float(units[name]), 0.0
    for table, allowed in ((_BINARY, {"bit", "byte"}), (_PREFIXES, _METRIC)):
        for prefix, factor in table.items():
            rest = name.removeprefix(prefix)
            if rest != name and rest in allowed:
                dimension, size, _ = unit(rest)
                power = 2 if rest[-1] == "2" else 3 if rest[-1] == "3" else 1
                return dimension, size * factor**power, 0.0
    return None


def _mismatch(_, a: str, b: str) -> Column:
    x, y = unit(a), unit(b)
    return F.lit(x is None or y is None or x[0] != y[0])


@_f("CONVERT", (_mismatch, NA))
def convert(x, a: str, b: str) -> Column:
    """Both units are known when the plan is made, so a conversion is one multiplication and one addition."""
    u, v = unit(a), unit(b)
    if u is None or v is None or u[0] != v[0]:
        return F.lit(None).cast("double")
    return (num(x) * u[1] + (u[2] - v[2])) / v[1]
