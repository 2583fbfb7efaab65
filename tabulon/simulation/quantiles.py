"""Quantile functions: each distribution turns one uniform number into a draw.

Every function takes a set of operations first, so that the same formula builds a Spark column (``Columns``) or works
on numpy arrays (``Arrays``) for theoretical statistics and parameter search. Closed forms stay in the JVM; inverse
incomplete gamma and beta functions and the normal quantile run on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import distributions as D
from tabulon.functions import special as S
from tabulon.functions.vector import vector


class Columns:
    log, exp, sqrt, tan, sinh, floor, ceil = F.ln, F.exp, F.sqrt, F.tan, F.sinh, staticmethod(lambda x: F.floor(x).cast("double")), staticmethod(lambda x: F.ceil(x).cast("double"))
    pow = staticmethod(lambda x, y: F.pow(x if isinstance(x, Column) else F.lit(float(x)), y if isinstance(y, Column) else F.lit(float(y))))
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    custom = staticmethod(lambda f, u, *args: vector(f, u, *args))
    pick = staticmethod(lambda xs, k: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), F.least(k.cast("int") + 1, F.lit(len(xs)))))


class Arrays:
    log, exp, sqrt, tan, sinh, floor, ceil, pow, where = np.log, np.exp, np.sqrt, np.tan, np.sinh, np.floor, np.ceil, np.power, np.where
    custom = staticmethod(lambda f, u, *args: f(u, *(np.full_like(u, a) if np.isscalar(a) else a for a in args)))
    pick = staticmethod(lambda xs, k: np.asarray(xs, float)[np.minimum(k.astype(int), len(xs) - 1)])


Quantile = Callable[..., object]
QUANTILES: dict[str, Quantile] = {}


def quantile(*names: str):
    def wrap(f: Quantile) -> Quantile:
        for name in names:
            QUANTILES[name] = f
        return f

    return wrap


def _z(m, u):
    return m.custom(S.norm_inv, u)


def _q(name: str, f: Quantile) -> None:
    QUANTILES[name] = f


_q("PSIUNIFORM", lambda m, u, a, b: a + (b - a) * u)
_q("PSINORMAL", lambda m, u, mean, sd: mean + sd * _z(m, u))
_q("PSIERF", lambda m, u, h: _z(m, u) / (h * math.sqrt(2)))
_q("PSILOGNORM2", lambda m, u, mu, s: m.exp(mu + s * _z(m, u)))


@quantile("PSILOGNORMAL")
def lognormal(m, u, mean, sd):
    """By the arithmetic mean and standard deviation."""
    s2 = math.log(1 + (sd / mean) ** 2)
    return m.exp(math.log(mean) - s2 / 2 + math.sqrt(s2) * _z(m, u))


@quantile("PSITRIANGULAR")
def triangular(m, u, a, c, b):
    share = (c - a) / (b - a)
    return m.where(u < share, a + m.sqrt(u * ((b - a) * (c - a))), b - m.sqrt((1 - u) * ((b - a) * (b - c))))


@quantile("PSIDBLTRIANG")
def double_triangular(m, u, a, c, b, p):
    return m.where(u < p, a + (c - a) * m.sqrt(u / p), b - (b - c) * m.sqrt((1 - u) / (1 - p)))


@quantile("PSITRIANGGEN")
def triangular_from_percentiles(m, u, low, c, high, p, r):
    """``low`` and ``high`` are the percentiles p and r; the ends are found by search on the driver."""
    a, b = low - (high - low) * 0.1, high + (high - low) * 0.1
    for _ in range(500):
        share_low, share_high = p * (b - a) * (c - a), (1 - r) * (b - a) * (b - c)
        a, b = (a + low - math.sqrt(max(share_low, 0))) / 2, (b + high + math.sqrt(max(share_high, 0))) / 2
    return triangular(m, u, a, c, b)


_q("PSIBERNOULLI", lambda m, u, p: m.where(u >= 1 - p, 1.0, 0.0))
_q("PSIINTUNIFORM", lambda m, u, a, b: m.floor(a + u * (b - a + 1)))
_q("PSIEXPONENTIAL", lambda m, u, beta: -beta * m.log(1 - u))
_q("PSIGEOMETRIC", lambda m, u, p: m.floor(m.log(1 - u) / math.log(1 - p)))
_q("PSIWEIBULL", lambda m, u, a, b: b * m.pow(-m.log(1 - u), 1 / a))
_q("PSIRAYLEIGH", lambda m, u, b: b * m.sqrt(-2 * m.log(1 - u)))
_q("PSICAUCHY", lambda m, u, loc, scale: loc + scale * m.tan(math.pi * (u - 0.5)))
_q("PSILOGISTIC", lambda m, u, mu, s: mu + s * m.log(u / (1 - u)))
_q("PSILOGLOGISTIC", lambda m, u, g, b, a: g + b * m.pow(u / (1 - u), 1 / a))
_q("PSILAPLACE", lambda m, u, loc, b: m.where(u < 0.5, loc + b * m.log(2 * u), loc - b * m.log(2 * (1 - u))))
_q("PSIMAXEXTREME", lambda m, u, mode, s: mode - s * m.log(-m.log(u)))
_q("PSIMINEXTREME", lambda m, u, mode, s: mode + s * m.log(-m.log(1 - u)))
_q("PSIFRECHET", lambda m, u, loc, scale, a: loc + scale * m.pow(-m.log(u), -1 / a))
_q("PSIPARETO", lambda m, u, theta, a: theta * m.pow(1 - u, -1 / a))
_q("PSIPARETO2", lambda m, u, b, q: b * (m.pow(1 - u, -1 / q) - 1))
_q("PSIRECIPROCAL", lambda m, u, a, b: a * m.pow(b / a, u))
_q("PSIHYPSECANT", lambda m, u, loc, scale: loc + scale * 2 / math.pi * m.log(m.tan(math.pi / 2 * u)))
_q("PSIBURR12", lambda m, u, loc, scale, c, k: loc + scale * m.pow(m.pow(1 - u, -1 / k) - 1, 1 / c))
_q("PSIDAGUM", lambda m, u, loc, scale, c, k: loc + scale * m.pow(m.pow(u, -1 / k) - 1, -1 / c))
_q("PSIKUMARASWAMY", lambda m, u, a, b, low, high: low + (high - low) * m.pow(1 - m.pow(1 - u, 1 / b), 1 / a))
_q("PSIJOHNSONSB", lambda m, u, g, d, low, high: low + (high - low) / (1 + m.exp(-(_z(m, u) - g) / d)))
_q("PSIJOHNSONSU", lambda m, u, g, d, loc, scale: loc + scale * m.sinh((_z(m, u) - g) / d))
_q("PSILEVY", lambda m, u, loc, scale: loc + scale / m.custom(lambda u: S.norm_inv(1 - u / 2) ** 2, u))


@quantile("PSIFATIGUELIFE")
def fatigue_life(m, u, loc, scale, shape):
    w = shape * _z(m, u) / 2
    root = w + m.sqrt(w * w + 1)
    return loc + scale * root * root


@quantile("PSIMYERSON")
def myerson(m, u, low, mid, high, tail=0.1):
    """Through its percentiles ``tail``, 0.5 and 1 - ``tail``."""
    ratio, z = (high - mid) / (mid - low), _z(m, u) / float(S.norm_inv(np.array([1 - tail]))[0])
    if abs(ratio - 1) < 1e-12:
        return mid + (high - mid) * z
    return mid + (high - mid) * (m.pow(ratio, z) - 1) / (ratio - 1)


@quantile("PSINORMALSKEW")
def normal_skew(m, u, low, mode, high):
    """Two half normals that meet at the mode; the ends lie three deviations off."""
    left, right = (mode - low) / 3, (high - mode) / 3
    share = left / (left + right)
    return m.where(u < share, mode + left * m.custom(S.norm_inv, u / (2 * share)), mode + right * m.custom(S.norm_inv, 0.5 + (u - share) / (2 * (1 - share))))


_q("PSIGAMMA", lambda m, u, a, b: m.custom(lambda u, a, b: b * S.gamma_inv(u, a), u, a, b))
_q("PSIERLANG", lambda m, u, k, b: m.custom(lambda u, a, b: b * S.gamma_inv(u, np.floor(a)), u, k, b))
_q("PSICHISQUARE", lambda m, u, k: m.custom(lambda u, k: 2 * S.gamma_inv(u, k / 2), u, k))
_q("PSIPEARSON5", lambda m, u, a, b: m.custom(lambda u, a, b: b / S.gamma_inv(1 - u, a), u, a, b))
_q("PSIBETA", lambda m, u, a, b: m.custom(S.beta_inv, u, a, b))
_q("PSIBETAGEN", lambda m, u, a, b, low, high: low + (high - low) * m.custom(S.beta_inv, u, a, b))
_q("PSIPEARSON6", lambda m, u, a, b, scale: m.custom(lambda u, a, b, s: s * S.beta_inv(u, a, b) / (1 - S.beta_inv(u, a, b)), u, a, b, scale))
_q("PSISTUDENT", lambda m, u, k: m.custom(S.t_inv, u, k))
_q("PSIFDIST", lambda m, u, a, b: m.custom(S.f_inv, u, a, b))


@quantile("PSIPERT")
def pert(m, u, a, c, b):
    return QUANTILES["PSIBETAGEN"](m, u, 1 + 4 * (c - a) / (b - a), 1 + 4 * (b - c) / (b - a), a, b)


@quantile("PSIBETASUBJ")
def beta_subjective(m, u, low, mode, mean, high):
    """The beta on [low, high] with a given mode and mean."""
    mid = (low + high) / 2
    a = 2 * (mean - low) * (mid - mode) / ((mean - mode) * (high - low))
    return QUANTILES["PSIBETAGEN"](m, u, a, a * (high - mean) / (mean - low), low, high)


def _inverse_gaussian(u, mean, shape):
    def cdf(x):
        r = np.sqrt(shape / x)
        return S.norm_cdf(r * (x / mean - 1)) + np.exp(np.minimum(2 * shape / mean, 700)) * S.norm_cdf(-r * (x / mean + 1))

    return S.invert(cdf, u, 1e-12, mean * 2)


_q("PSIINVNORMAL", lambda m, u, mean, shape: m.custom(_inverse_gaussian, u, mean, shape))

# -- discrete: the smallest number whose cumulative probability reaches u -------------------------------------------

_q("PSIBINOMIAL", lambda m, u, n, p: m.custom(lambda u, n, p: D.smallest(lambda k: D.binom_cdf(k, n, p), u, n), u, n, p))
_q("PSIPOISSON", lambda m, u, rate: m.custom(lambda u, r: D.smallest(lambda k: D.poisson_cdf(k, r), u, r + 1), u, rate))
_q("PSINEGBINOMIAL", lambda m, u, s, p: m.custom(lambda u, s, p: D.smallest(lambda k: np.where(k < 0, 0, S.betainc(s, k + 1, p)), u, s / p), u, s, p))
_q("PSIHYPERGEO", lambda m, u, n, d, size: m.custom(lambda u, n, d, s: D.smallest(lambda k: D.hypgeom_cdf(k, n, d, s), u, n), u, n, d, size))


def _logarithmic(u, p):
    k, total, out = 1, np.zeros_like(u), np.zeros_like(u)
    while (out == 0).any() and k < 100_000:
        total = total - p**k / (k * np.log1p(-p))
        out = np.where((out == 0) & (total >= u), k, out)
        k += 1
    return np.where(out == 0, k, out)


_q("PSILOGARITHMIC", lambda m, u, p: m.custom(_logarithmic, u, p))


def _stepped(values, weights):
    total = np.cumsum(np.asarray(weights, float)) / np.sum(weights)
    xs = np.asarray(values, float)
    return lambda u: xs[np.minimum(np.searchsorted(total, u, "left"), len(xs) - 1)]


_q("PSIDISCRETE", lambda m, u, values, weights: m.custom(_stepped(values, weights), u))
_q("PSICUMULD", lambda m, u, low, high, xs, ps: m.custom(_stepped([*xs, high] if ps[-1] < 1 else xs, np.diff([0, *ps, 1] if ps[-1] < 1 else [0, *ps])), u))
_q("PSIDISUNIFORM", lambda m, u, xs: m.pick(xs, m.floor(u * len(xs))))
_q("PSIRESAMPLE", lambda m, u, xs: m.pick(xs, m.floor(u * len(xs))))
_q("PSISHUFFLE", lambda m, u, xs: m.pick(xs, m.floor(u * len(xs))))

# -- piecewise ------------------------------------------------------------------------------------------------------

_q("PSICUMUL", lambda m, u, low, high, xs, ps: m.custom(lambda v: np.interp(v, [0, *ps, 1], [low, *xs, high]), u))


@quantile("PSIHISTOGRAM")
def histogram(m, u, low, high, weights):
    total = np.concatenate(([0], np.cumsum(weights))) / np.sum(weights)
    edges = np.linspace(low, high, len(weights) + 1)
    return m.custom(lambda v: np.interp(v, total, edges), u)


@quantile("PSIGENERAL")
def general(m, u, low, high, xs, weights):
    """A density that is linear between its points and 0 at both ends."""
    x, w = np.array([low, *xs, high], float), np.array([0, *weights, 0], float)
    area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(x))))

    def inverse(v):
        target = v * area[-1]
        k = np.clip(np.searchsorted(area, target, "right") - 1, 0, len(x) - 2)
        rest, slope = target - area[k], (w[k + 1] - w[k]) / (x[k + 1] - x[k])
        flat = np.abs(slope) < 1e-12
        root = (-w[k] + np.sqrt(np.maximum(w[k] ** 2 + 2 * slope * rest, 0))) / np.where(flat, 1, slope)
        return x[k] + np.where(flat, rest / np.where(w[k] == 0, 1, w[k]), root)

    return m.custom(inverse, u)


# -- metalogs: a polynomial in the log odds ------------------------------------------------------------------------


def metalog_basis(p: np.ndarray, k: int) -> np.ndarray:
    odds, half = np.log(p / (1 - p)), p - 0.5
    cols = [np.ones_like(p), odds, half * odds, half]
    for j in range(4, k):
        cols.append(half ** (j // 2) * (odds if j % 2 else 1.0))
    return np.stack(cols[:k], 1)


def _metalog(u, coefficients):
    return metalog_basis(u, len(coefficients)) @ np.asarray(coefficients, float)


_q("PSIMETALOG2", lambda m, u, coefficients: m.custom(lambda v: _metalog(v, coefficients), u))


@quantile("PSIMETALOG")
def metalog(m, u, low, high, coefficients):
    def inverse(v):
        y = np.exp(_metalog(v, coefficients))
        return (low + high * y) / (1 + y)

    return m.custom(inverse, u)


def fit_metalog(k: int, xs, ps, low=None, high=None) -> list[float]:
    x = np.asarray(xs, float)
    y = np.log((x - low) / (high - x)) if low is not None else x
    return np.linalg.lstsq(metalog_basis(np.asarray(ps, float), k), y, rcond=None)[0].tolist()


_q("PSIMETALOG2FIT", lambda m, u, k, xs, ps: QUANTILES["PSIMETALOG2"](m, u, fit_metalog(k, xs, ps)))
_q("PSIMETALOGFIT", lambda m, u, k, xs, ps: QUANTILES["PSIMETALOG2"](m, u, fit_metalog(k, xs, ps)))
_q("PSIMETALOGSPT", lambda m, u, low, high, xs, p: metalog(m, u, low, high, fit_metalog(3, xs, [p, 0.5, 1 - p], low, high)))


# -- four moments: the Cornish-Fisher expansion ---------------------------------------------------------------------


@quantile("PSIMOMENTFIT")
def moment_fit(m, u, mean, sd, skew=0.0, kurtosis=3.0):
    z, excess = _z(m, u), kurtosis - 3
    w = z + (z * z - 1) * (skew / 6) + (z * z * z - 3 * z) * (excess / 24) - (2 * z * z * z - 5 * z) * (skew * skew / 36)
    return mean + sd * w


@quantile("PSIFIT")
def fit_sample(m, u, xs):
    x = np.asarray(xs, float)
    c = x - x.mean()
    s = c.std()
    return moment_fit(m, u, float(x.mean()), float(x.std(ddof=1)), float((c**3).mean() / s**3), float((c**4).mean() / s**4))


# -- one step of a time series --------------------------------------------------------------------------------------

_q("PSIAR1", lambda m, u, mean, vol, a, x0: mean + a * (x0 - mean) + vol * _z(m, u))
_q("PSIAR2", lambda m, u, mean, vol, a, b, x0, x1: mean + a * (x1 - mean) + b * (x0 - mean) + vol * _z(m, u))
_q("PSIMA1", lambda m, u, mean, vol, b, e0: mean + b * e0 + vol * _z(m, u))
_q("PSIMA2", lambda m, u, mean, vol, b, c, e0, e1: mean + b * e1 + c * e0 + vol * _z(m, u))
_q("PSIARMA11", lambda m, u, mean, vol, a, b, x0, e0: mean + a * (x0 - mean) + b * e0 + vol * _z(m, u))
_q("PSIARCH1", lambda m, u, mean, vol, a, x0: mean + math.sqrt(vol**2 + a * (x0 - mean) ** 2) * _z(m, u))
_q("PSIGARCH11", lambda m, u, mean, vol, a, b, x0, s0: mean + math.sqrt(vol**2 + a * (x0 - mean) ** 2 + b * s0**2) * _z(m, u))


@quantile("PSIEGARCH11")
def egarch(m, u, mean, vol, theta, gamma, a, b, x0, s0):
    e = (x0 - mean) / s0
    log_var = math.log(vol**2) + a * (theta * e + gamma * (abs(e) - math.sqrt(2 / math.pi))) + b * math.log(s0**2)
    return mean + math.exp(log_var / 2) * _z(m, u)


@quantile("PSIAPARCH11")
def aparch(m, u, mean, vol, delta, gamma, a, b, x0, s0):
    e = x0 - mean
    sd = (vol**delta + a * (abs(e) - gamma * e) ** delta + b * s0**delta) ** (1 / delta)
    return mean + sd * _z(m, u)


def array_quantile(name: str, *parameters) -> Callable[[np.ndarray], np.ndarray]:
    """The quantile function on numpy arrays."""
    f = QUANTILES[name.upper()]
    return lambda u: f(Arrays, np.asarray(u, float), *parameters)


# -- distributions given by percentiles -----------------------------------------------------------------------------

#: Names of the parameters that the percentile forms search for, and where the search starts.
_ALTS = {
    "NORMAL": 2, "LOGNORMAL": 2, "UNIFORM": 2, "TRIANGULAR": 3, "EXPONENTIAL": 1, "WEIBULL": 2, "GAMMA": 2, "BETAGEN": 4, "CAUCHY": 2, "LAPLACE": 2,
    "LEVY": 2, "LOGISTIC": 2, "LOGLOGISTIC": 3, "PARETO": 2, "PARETO2": 2, "PEARSON5": 2, "PEARSON6": 3, "RAYLEIGH": 1, "MAXEXTREME": 2,
    "MINEXTREME": 2, "FRECHET": 3, "FATIGUELIFE": 3, "HYPSECANT": 2, "INVNORMAL": 2, "CHISQUARE": 1, "STUDENT": 1, "ERF": 1, "PERT": 3,
}
_LOCATED = {"NORMAL": 1, "CAUCHY": 1, "LAPLACE": 1, "LEVY": 1, "LOGISTIC": 1, "LOGLOGISTIC": 1, "MAXEXTREME": 1, "MINEXTREME": 1, "FRECHET": 1, "FATIGUELIFE": 1, "HYPSECANT": 1}


def _decoded(name: str, free: np.ndarray) -> list[float]:
    """Search variables to parameters: places stay, sizes are exponentials, ends follow each other upwards."""
    if name in ("UNIFORM", "TRIANGULAR", "PERT"):
        return [float(free[0] + np.exp(free[1 : k + 1]).sum()) for k in range(len(free))]
    if name == "BETAGEN":
        return [float(np.exp(free[0])), float(np.exp(free[1])), float(free[2]), float(free[2] + np.exp(free[3]))]
    k = _LOCATED.get(name, 0)
    return [*map(float, free[:k]), *map(float, np.exp(np.clip(free[k:], -30, 30)))]


def solve_percentiles(name: str, pairs: list[tuple[float, float]], moments: dict[str, float] | None = None) -> list[float]:
    """Parameters of a family (without the suffix ALT) for (percentile, value) pairs and moments; Levenberg-Marquardt."""
    name = name.upper().removeprefix("PSI").removesuffix("ALT")
    q = QUANTILES[f"PSI{name}"]
    ps, xs = np.array([p for p, _ in pairs], float), np.array([x for _, x in pairs], float)
    grid = (np.arange(2000) + 0.5) / 2000
    span = max(float(np.ptp(xs)), abs(float(xs.mean())), 1e-9) if len(xs) else 1.0

    def misses(free: np.ndarray) -> np.ndarray:
        p = _decoded(name, free)
        with np.errstate(all="ignore"):
            out = list((np.asarray(q(Arrays, ps, *p), float) - xs) / span) if len(ps) else []
            if moments:
                v = np.asarray(q(Arrays, grid, *p), float)
                out += [(v.mean() - moments["mean"]) / span] * ("mean" in moments) + [(v.std() - moments["stdev"]) / span] * ("stdev" in moments)
        return np.nan_to_num(np.array(out, float), nan=1e6, posinf=1e6, neginf=-1e6)

    n, best = _ALTS[name], None
    centre = float(np.median(xs)) if len(xs) else (moments or {}).get("mean", 0.0)
    for shape in (0.0, 1.0, -1.0, 2.0):
        free = np.full(n, math.log(span) if name not in ("STUDENT",) else 1.0)
        k = _LOCATED.get(name, 0) or (1 if name in ("UNIFORM", "TRIANGULAR", "PERT") else 0)
        free[:k] = centre - (span if name in ("UNIFORM", "TRIANGULAR", "PERT") else 0)
        if n - k > 1 or name == "BETAGEN":
            free[-1 if name != "BETAGEN" else 0] = shape
        if name == "BETAGEN":
            free[1], free[2], free[3] = shape, centre - span, math.log(3 * span)
        damp, now = 1e-2, misses(free)
        for _ in range(300):
            step = 1e-6 * np.maximum(1, np.abs(free))
            jac = np.stack([(misses(free + np.eye(n)[i] * step[i]) - now) / step[i] for i in range(n)], 1)
            move = np.linalg.lstsq(jac.T @ jac + damp * np.eye(n), -jac.T @ now, rcond=None)[0]
            tried = misses(free + move)
            if tried @ tried < now @ now:
                free, now, damp = free + move, tried, max(damp / 3, 1e-12)
            else:
                damp *= 4
            if now @ now < 1e-22 or damp > 1e12:
                break
        if best is None or now @ now < best[0]:
            best = (float(now @ now), _decoded(name, free))
    return best[1]


ALT_NAMES = [f"PSI{n}ALT" for n in _ALTS]
