"""The function catalogue.

Every spreadsheet function of the catalogue is a builder of a Spark ``Column`` together with the conditions under
which it answers an error. ``value`` gives the plain result (null where the answer is an error or a blank), ``error``
the error code or null, and ``cell`` both as a struct, so that null never has to mean an error.
Names are found without regard to case, and with or without the prefixes of newer functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM, DIV0, VALUE, NA, REF, NAME, NULL, CALC = "#NUM!", "#DIV/0!", "#VALUE!", "#N/A", "#REF!", "#NAME?", "#NULL!", "#CALC!"
#: The code that ERROR.TYPE gives each error.
ERROR_CODES = {NULL: 1, DIV0: 2, VALUE: 3, REF: 4, NAME: 5, NUM: 6, NA: 7, CALC: 14}

Guard = tuple[Callable[..., Column], str]


@dataclass(frozen=True)
class Function:
    name: str
    build: Callable[..., Column]
    guards: tuple[Guard, ...] = ()
    family: str = ""
    kind: str = "scalar"  # or "aggregate"
    doc: str = field(default="", compare=False)


CATALOGUE: dict[str, Function] = {}
ALIASES: dict[str, str] = {}


def col(x) -> Column:
    """A column for a column, the name of one, or a literal number; text literals are given with ``F.lit``."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def num(x) -> Column:
    return col(x).cast("double")


def function(name: str, *guards: Guard, family: str, kind: str = "scalar"):
    """Register the decorated builder under ``name``."""

    def wrap(build: Callable[..., Column]) -> Callable[..., Column]:
        CATALOGUE[name] = Function(name, build, guards, family, kind, (build.__doc__ or "").strip())
        return build

    return wrap


def alias(name: str, target: str) -> None:
    ALIASES[name] = target


def lookup(name: str) -> Function:
    key = name.upper()
    for prefix in ("_XLL.", "_XLFN."):
        key = key.removeprefix(prefix)
    key = ALIASES.get(key, key)
    if key not in CATALOGUE:
        raise KeyError(f"{NAME} {name}")
    return CATALOGUE[key]


def error(name: str, *args) -> Column:
    """The error code of a call, or null."""
    out = F.lit(None).cast("string")
    for wrong, code in reversed(lookup(name).guards):
        out = F.when(wrong(*args), F.lit(code)).otherwise(out)
    return out


def value(name: str, *args) -> Column:
    """The result of a call; null where it is an error."""
    f = lookup(name)
    if not f.guards:
        return f.build(*args)
    wrong = F.lit(False)
    for test, _ in f.guards:
        wrong = wrong | F.coalesce(test(*args), F.lit(False))
    return F.when(~wrong, f.build(*args))


def cell(name: str, *args) -> Column:
    return F.struct(value(name, *args).alias("value"), error(name, *args).alias("error"))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out a single time, however often ``f`` names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
