"""Small matrices held in array<array<double>> cells: determinant, inverse, product, transpose."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import NUM, VALUE, function

FAMILY = "matrix"
_MATRIX = "array<array<double>>"


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


def _square(m: Column) -> Column:
    return F.forall(m, lambda r: F.size(r) == F.size(m))


_not_square = (lambda m: ~_square(m), VALUE)


def _dense(m) -> np.ndarray:
    return np.array([list(r) for r in m], float)


@_f("MDETERM", _not_square)
def mdeterm(m: Column) -> Column:
    return F.pandas_udf(lambda ms: pd.Series([float(np.linalg.det(_dense(x))) if x is not None else None for x in ms], dtype=float), "double")(m)


def _inverse(m: Column) -> Column:
    def one(x):
        try:
            return np.linalg.inv(_dense(x)).tolist()
        except (np.linalg.LinAlgError, TypeError):
            return None

    return F.pandas_udf(lambda ms: pd.Series([one(x) for x in ms], dtype=object), _MATRIX)(m)


_f("MINVERSE", _not_square, (lambda m: _inverse(m).isNull(), NUM))(_inverse)


@_f("MMULT", (lambda a, b: F.size(F.element_at(a, 1)) != F.size(b), VALUE))
def mmult(a: Column, b: Column) -> Column:
    def dot(row: Column, j: Column) -> Column:
        return F.reduce(F.zip_with(row, b, lambda x, r: x * F.get(r, j)), F.lit(0.0), lambda s, x: s + x)

    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(0), F.size(F.element_at(b, 1)) - 1), lambda j: dot(row, j)))


@_f("TRANSPOSE")
def transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.element_at(m, 1)) - 1), lambda j: F.transform(m, lambda r: F.get(r, j)))
