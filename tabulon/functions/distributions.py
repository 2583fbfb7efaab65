"""Probability distributions: densities, cumulative probabilities and quantiles.

Closed forms are plain column expressions; incomplete gamma and beta functions run on Arrow batches. The first name of
each row is the current one, further names are older ones for the same thing.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import special as S
from tabulon.functions.math import whole
from tabulon.functions.registry import CATALOGUE, NUM, alias, function, num
from tabulon.functions.vector import vector

FAMILY = "distribution"


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


def _bad_p(p, *_) -> Column:
    return (num(p) <= 0) | (num(p) >= 1)


_positive = lambda *ks: (lambda *a: _any_below(a, ks), NUM)  # noqa: E731  arguments at these places are positive


def _any_below(args, places) -> Column:
    out = F.lit(False)
    for k in places:
        if k < len(args):
            out = out | (num(args[k]) <= 0)
    return out


# -- normal family -------------------------------------------------------------------------------------------------


def _phi(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


_f("PHI")(lambda x: _phi(num(x)))
_f("GAUSS")(lambda x: vector(lambda z: S.norm_cdf(z) - 0.5, x))
_f("NORM.S.DIST")(lambda z, cumulative=True: vector(S.norm_cdf, z) if cumulative else _phi(num(z)))
_f("NORM.S.INV", (_bad_p, NUM))(lambda p: vector(S.norm_inv, p))
_f("NORM.DIST", _positive(2))(lambda x, m, s, cumulative=True: vector(S.norm_cdf, (num(x) - num(m)) / num(s)) if cumulative else _phi((num(x) - num(m)) / num(s)) / num(s))
_f("NORM.INV", (_bad_p, NUM), _positive(2))(lambda p, m, s: num(m) + num(s) * vector(S.norm_inv, p))
_f("LOGNORM.DIST", _positive(0, 2))(
    lambda x, m, s, cumulative=True: vector(S.norm_cdf, (F.ln(num(x)) - num(m)) / num(s)) if cumulative else _phi((F.ln(num(x)) - num(m)) / num(s)) / (num(x) * num(s))
)
_f("LOGNORM.INV", (_bad_p, NUM), _positive(2))(lambda p, m, s: F.exp(num(m) + num(s) * vector(S.norm_inv, p)))
_f("STANDARDIZE", _positive(2))(lambda x, m, s: (num(x) - num(m)) / num(s))
_f("FISHER", (lambda x: F.abs(num(x)) >= 1, NUM))(lambda x: F.atanh(num(x)))
_f("FISHERINV")(lambda y: F.tanh(num(y)))
_f("CONFIDENCE.NORM", (_bad_p, NUM), _positive(1))(lambda a, s, n: num(s) / F.sqrt(whole(n)) * vector(lambda p: S.norm_inv(1 - p / 2), a))
_f("CONFIDENCE.T", (_bad_p, NUM), _positive(1))(lambda a, s, n: num(s) / F.sqrt(whole(n)) * vector(lambda p, k: S.t_inv(1 - p / 2, k - 1), a, whole(n)))

# -- gamma, beta ---------------------------------------------------------------------------------------------------

_f("GAMMA", (lambda x: (num(x) <= 0) & (num(x) == F.floor(num(x))), NUM))(lambda x: vector(S.gamma, x))
_f("GAMMALN.PRECISE", _positive(0))(lambda x: vector(S.lgamma, x))
_negative_x = (lambda x, *_: num(x) < 0, NUM)


def gamma_pdf(x, a, b):
    out = np.exp((a - 1) * np.log(x) - x / b - S.lgamma(a) - a * np.log(b))
    return np.where(x == 0, np.where(a == 1, 1 / b, np.where(a > 1, 0.0, np.nan)), out)


_f("GAMMA.DIST", _negative_x, _positive(1, 2))(lambda x, a, b, cumulative=True: vector(lambda x, a, b: S.gammainc(a, x / b), x, a, b) if cumulative else vector(gamma_pdf, x, a, b))
_f("GAMMA.INV", (lambda p, *_: (num(p) < 0) | (num(p) >= 1), NUM), _positive(1, 2))(lambda p, a, b: vector(lambda p, a, b: b * S.gamma_inv(p, a), p, a, b))


def beta_pdf(x, a, b, low, high):
    z = (x - low) / (high - low)
    out = np.exp((a - 1) * np.log(z) + (b - 1) * np.log1p(-z) + S.lgamma(a + b) - S.lgamma(a) - S.lgamma(b)) / (high - low)
    return np.where(z == 0, np.where(a > 1, 0.0, np.nan), np.where(z == 1, np.where(b > 1, 0.0, np.nan), out))


@_f("BETA.DIST", _positive(1, 2), (lambda x, a, b, c=True, low=0.0, high=1.0: (num(x) < num(low)) | (num(x) > num(high)), NUM))
def beta_dist(x, a, b, cumulative=True, low=0.0, high=1.0) -> Column:
    if cumulative:
        return vector(lambda x, a, b, lo, hi: S.betainc(a, b, (x - lo) / (hi - lo)), x, a, b, low, high)
    return vector(beta_pdf, x, a, b, low, high)


_f("BETADIST", _positive(1, 2))(lambda x, a, b, low=0.0, high=1.0: beta_dist(x, a, b, True, low, high))
_f("BETA.INV", (_bad_p, NUM), _positive(1, 2))(lambda p, a, b, low=0.0, high=1.0: num(low) + (num(high) - num(low)) * vector(S.beta_inv, p, a, b))

# -- chi squared, t, F: degrees of freedom are whole and at least 1 ------------------------------------------------

_df = lambda *ks: (lambda *a: _any_outside(a, ks), NUM)


def _any_outside(args, places) -> Column:
    out = F.lit(False)
    for k in places:
        out = out | (num(args[k]) < 1) | (num(args[k]) >= 1e10)
    return out


def chi_pdf(x, k):
    return gamma_pdf(x, k / 2, np.full_like(x, 2.0))


_f("CHISQ.DIST", _negative_x, _df(1))(lambda x, k, cumulative=True: vector(lambda x, k: S.gammainc(k / 2, x / 2), x, whole(k)) if cumulative else vector(chi_pdf, x, whole(k)))
_f("CHISQ.DIST.RT", _negative_x, _df(1))(lambda x, k: vector(lambda x, k: 1 - S.gammainc(k / 2, x / 2), x, whole(k)))
_f("CHISQ.INV", (lambda p, *_: (num(p) < 0) | (num(p) >= 1), NUM), _df(1))(lambda p, k: vector(lambda p, k: 2 * S.gamma_inv(p, k / 2), p, whole(k)))
_f("CHISQ.INV.RT", (lambda p, *_: (num(p) <= 0) | (num(p) > 1), NUM), _df(1))(lambda p, k: vector(lambda p, k: 2 * S.gamma_inv(1 - p, k / 2), p, whole(k)))


def t_pdf(x, k):
    return np.exp(S.lgamma((k + 1) / 2) - S.lgamma(k / 2) - (k + 1) / 2 * np.log1p(x * x / k)) / np.sqrt(k * np.pi)


_f("T.DIST", _df(1))(lambda x, k, cumulative=True: vector(S.t_cdf, x, whole(k)) if cumulative else vector(t_pdf, x, whole(k)))
_f("T.DIST.RT", _df(1))(lambda x, k: vector(lambda x, k: S.t_cdf(-x, k), x, whole(k)))
_f("T.DIST.2T", _negative_x, _df(1))(lambda x, k: vector(lambda x, k: 2 * S.t_cdf(-x, k), x, whole(k)))
_f("TDIST", _negative_x, _df(1))(lambda x, k, tails: vector(lambda x, k: tails * S.t_cdf(-x, k), x, whole(k)))
_f("T.INV", (_bad_p, NUM), _df(1))(lambda p, k: vector(S.t_inv, p, whole(k)))
_f("T.INV.2T", (lambda p, *_: (num(p) <= 0) | (num(p) > 1), NUM), _df(1))(lambda p, k: vector(lambda p, k: S.t_inv(1 - p / 2, k), p, whole(k)))


def f_pdf(x, a, b):
    return np.exp(S.lgamma((a + b) / 2) - S.lgamma(a / 2) - S.lgamma(b / 2) + a / 2 * np.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b))


_f("F.DIST", _negative_x, _df(1, 2))(lambda x, a, b, cumulative=True: vector(S.f_cdf, x, whole(a), whole(b)) if cumulative else vector(f_pdf, x, whole(a), whole(b)))
_f("F.DIST.RT", _negative_x, _df(1, 2))(lambda x, a, b: vector(lambda x, a, b: 1 - S.f_cdf(x, a, b), x, whole(a), whole(b)))
_f("F.INV", (lambda p, *_: (num(p) < 0) | (num(p) >= 1), NUM), _df(1, 2))(lambda p, a, b: vector(S.f_inv, p, whole(a), whole(b)))
_f("F.INV.RT", (lambda p, *_: (num(p) <= 0) | (num(p) > 1), NUM), _df(1, 2))(lambda p, a, b: vector(lambda p, a, b: S.f_inv(1 - p, a, b), p, whole(a), whole(b)))

# -- closed forms --------------------------------------------------------------------------------------------------

_f("EXPON.DIST", _negative_x, _positive(1))(lambda x, rate, cumulative=True: 1 - F.exp(-num(rate) * num(x)) if cumulative else num(rate) * F.exp(-num(rate) * num(x)))


@_f("WEIBULL.DIST", _negative_x, _positive(1, 2))
def weibull_dist(x, a, b, cumulative=True) -> Column:
    x, a, b = num(x), num(a), num(b)
    if cumulative:
        return 1 - F.exp(-F.pow(x / b, a))
    return F.when(x == 0, 0.0).otherwise(a / F.pow(b, a) * F.pow(x, a - 1) * F.exp(-F.pow(x / b, a)))


# -- discrete ------------------------------------------------------------------------------------------------------


def log_choose(n, k):
    return S.lgamma(n + 1) - S.lgamma(k + 1) - S.lgamma(n - k + 1)


def binom_pmf(k, n, p):
    out = np.exp(log_choose(n, k) + k * np.log(np.where(p > 0, p, 1)) + (n - k) * np.log1p(-np.where(p < 1, p, 0)))
    return np.where(p == 0, k == 0, np.where(p == 1, k == n, out)) * 1.0


def binom_cdf(k, n, p):
    return np.where(k >= n, 1.0, np.where(k < 0, 0.0, S.betainc(np.maximum(n - k, 0.5), k + 1, 1 - p)))


def smallest(cdf, target, start):
    """Smallest whole k >= 0 with cdf(k) >= target, by bisection on whole numbers."""
    low, high = np.full(target.shape, -1.0), np.maximum(np.ceil(start), 1.0)
    for _ in range(60):
        short = cdf(high) < target
        if not short.any():
            break
        high = np.where(short, high * 2, high)
    while ((high - low) > 1).any():
        mid = np.floor((low + high) / 2)
        below = cdf(mid) < target
        move = high - low > 1
        low, high = np.where(below & move, mid, low), np.where(~below & move, mid, high)
    return high


_bad_share = lambda k: (lambda *a: (num(a[k]) < 0) | (num(a[k]) > 1), NUM)
_f("BINOM.DIST", _bad_share(2), (lambda k, n, p, c=True: (whole(k) < 0) | (whole(k) > whole(n)), NUM))(
    lambda k, n, p, cumulative=True: vector(binom_cdf if cumulative else binom_pmf, whole(k), whole(n), p)
)
_f("BINOM.INV", _bad_share(1), _bad_share(2))(lambda n, p, a: vector(lambda n, p, a: smallest(lambda k: binom_cdf(k, n, p), a, n), whole(n), p, a))


@_f("BINOM.DIST.RANGE", _bad_share(1))
def binom_range(n, p, low, high=None) -> Column:
    return vector(lambda n, p, a, b: binom_cdf(b, n, p) - binom_cdf(a - 1, n, p), whole(n), p, whole(low), whole(low if high is None else high))


def poisson_pmf(k, m):
    return np.exp(k * np.log(np.where(m > 0, m, 1)) - m - S.lgamma(k + 1)) * np.where((m == 0) & (k > 0), 0, 1)


def poisson_cdf(k, m):
    return np.where(k < 0, 0.0, np.where(m == 0, 1.0, 1 - S.gammainc(k + 1, m)))


_f("POISSON.DIST", _negative_x, (lambda k, m, c=True: num(m) < 0, NUM))(lambda k, m, cumulative=True: vector(poisson_cdf if cumulative else poisson_pmf, whole(k), m))


def negbinom_pmf(f, s, p):
    return np.exp(log_choose(f + s - 1, f) + s * np.log(p) + f * np.log1p(-p))


_f("NEGBINOM.DIST", _negative_x, _positive(1), _bad_share(2))(
    lambda f, s, p, cumulative=True: vector(lambda f, s, p: S.betainc(s, f + 1, p), whole(f), whole(s), p) if cumulative else vector(negbinom_pmf, whole(f), whole(s), p)
)
_f("NEGBINOMDIST", _negative_x, _positive(1), _bad_share(2))(lambda f, s, p: vector(negbinom_pmf, whole(f), whole(s), p))


def hypgeom_pmf(k, n, d, m):
    out = np.exp(log_choose(d, k) + log_choose(m - d, n - k) - log_choose(m, n))
    return np.where((k < np.maximum(0, n + d - m)) | (k > np.minimum(n, d)), 0.0, out)


def hypgeom_cdf(k, n, d, m):
    out = np.zeros(k.shape)
    for i in range(int(np.nanmax(k, initial=-1)) + 1):
        out += np.where(i <= k, hypgeom_pmf(np.full(k.shape, float(i)), n, d, m), 0.0)
    return np.minimum(out, 1.0)


_f("HYPGEOM.DIST", _negative_x)(lambda k, n, d, m, cumulative=True: vector(hypgeom_cdf if cumulative else hypgeom_pmf, whole(k), whole(n), whole(d), whole(m)))
_f("HYPGEOMDIST", _negative_x)(lambda k, n, d, m: vector(hypgeom_pmf, whole(k), whole(n), whole(d), whole(m)))
_f("LOGNORMDIST", _positive(0, 2))(lambda x, m, s: CATALOGUE["LOGNORM.DIST"].build(x, m, s, True))

# Older names of the same functions.
for _old, _new in {
    "NORMSINV": "NORM.S.INV", "NORMSDIST": "NORM.S.DIST", "NORMDIST": "NORM.DIST", "NORMINV": "NORM.INV", "GAMMALN": "GAMMALN.PRECISE",
    "BETAINV": "BETA.INV", "BINOMDIST": "BINOM.DIST", "CHIDIST": "CHISQ.DIST.RT", "CHIINV": "CHISQ.INV.RT", "CONFIDENCE": "CONFIDENCE.NORM",
    "CRITBINOM": "BINOM.INV", "EXPONDIST": "EXPON.DIST", "FDIST": "F.DIST.RT", "FINV": "F.INV.RT", "GAMMADIST": "GAMMA.DIST",
    "GAMMAINV": "GAMMA.INV", "LOGINV": "LOGNORM.INV", "POISSON": "POISSON.DIST", "TINV": "T.INV.2T", "WEIBULL": "WEIBULL.DIST",
}.items():
    alias(_old, _new)
