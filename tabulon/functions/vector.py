"""Column functions backed by numpy code: Arrow batches in, Arrow batches out, one call per batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import num


def vector(compute: Callable, *args) -> Column:
    """``compute``, value by value, over double columns; NaN and infinity come back as null.

    Where one column varies and the others are constant, repeated values of it are computed once per batch; where none
    varies, one value is. Plain numbers stay with the function and are no columns.
    """
    import numpy as np

    fixed = {k: float(x) for k, x in enumerate(args) if isinstance(x, (int, float))}
    if len(fixed) == len(args):
        fixed = {}

    n = len(args)

    def run(*columns: pd.Series) -> pd.Series:
        given, back = iter(columns), slice(None)
        arrays = [np.full(len(columns[0]), fixed[k]) if k in fixed else next(given).to_numpy(float) for k in range(n)]
        varied = [k for k, a in enumerate(arrays) if len(a) and not (a == a[0]).all()]
        if len(varied) == 1:
            back, values = pd.factorize(arrays[varied[0]], use_na_sentinel=False)
            arrays = [values if k == varied[0] else a[: len(values)] for k, a in enumerate(arrays)]
        elif not varied and arrays:
            arrays, back = [a[:1] for a in arrays], np.zeros(len(arrays[0]), int)
        with np.errstate(all="ignore"):
            out = np.asarray(compute(*arrays), float)[back]
        return pd.Series(np.where(np.isfinite(out), out, np.nan))

    return F.pandas_udf(run, "double")(*(num(x) for k, x in enumerate(args) if k not in fixed))
