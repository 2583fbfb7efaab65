"""Financial functions: annuities, depreciation, discounted securities, bonds, cash flows in arrays.

Closed forms are column expressions; yields and rates without one are found by bracketed root search on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.datetime import date, days360, yearfrac
from tabulon.functions.math import whole
from tabulon.functions.registry import DIV0, NUM, col, function, num
from tabulon.functions.vector import vector

FAMILY = "finance"


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


# -- annuities -----------------------------------------------------------------------------------------------------


def _growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def _series(rate: Column, n: Column) -> Column:
    """((1 + r)^n - 1) / r, and n where r is 0."""
    return F.when(rate == 0, n).otherwise(F.try_divide(_growth(rate, n) - 1, rate))


def _due(rate: Column, kind) -> Column:
    return F.when(num(kind) != 0, 1 + rate).otherwise(1.0)


@_f("PMT", (lambda rate, nper, pv, fv=0.0, kind=0: num(nper) == 0, NUM))
def pmt(rate, nper, pv, fv=0.0, kind=0) -> Column:
    rate, n = num(rate), num(nper)
    return -(num(pv) * _growth(rate, n) + num(fv)) / (_series(rate, n) * _due(rate, kind))


@_f("FV")
def fv(rate, nper, payment, pv=0.0, kind=0) -> Column:
    rate, n = num(rate), num(nper)
    return -(num(pv) * _growth(rate, n) + num(payment) * _due(rate, kind) * _series(rate, n))


@_f("PV")
def pv(rate, nper, payment, fv=0.0, kind=0) -> Column:
    rate, n = num(rate), num(nper)
    return -(num(fv) + num(payment) * _due(rate, kind) * _series(rate, n)) / _growth(rate, n)


@_f("NPER")
def nper(rate, payment, pv, fv=0.0, kind=0) -> Column:
    rate, pv, fv = num(rate), num(pv), num(fv)
    level = num(payment) * _due(rate, kind)
    general = F.ln(F.try_divide(level - fv * rate, pv * rate + level)) / F.ln(1 + rate)
    return F.when(rate == 0, F.try_divide(-(pv + fv), num(payment))).otherwise(general)


_bad_period = (lambda rate, per, nper, *_: (num(per) < 1) | (num(per) > num(nper)), NUM)


@_f("IPMT", _bad_period)
def ipmt(rate, per, nper, pv, fv_=0.0, kind=0) -> Column:
    """Interest on what is owed before the period; due payments pay none in period 1."""
    payment = pmt(rate, nper, pv, fv_, kind)
    before = fv(rate, num(per) - 1, payment, pv, kind)
    due = num(kind) != 0
    interest = before * num(rate) / F.when(due, 1 + num(rate)).otherwise(1.0)
    return F.when(due & (num(per) == 1), 0.0).otherwise(interest)


_f("PPMT", _bad_period)(lambda rate, per, nper, pv, fv=0.0, kind=0: pmt(rate, nper, pv, fv, kind) - ipmt(rate, per, nper, pv, fv, kind))
_f("ISPMT")(lambda rate, per, nper, pv: num(pv) * num(rate) * (num(per) / num(nper) - 1))


def _interest(rate, nper, pv, start, end, kind) -> Column:
    """Interest of all periods from start to end: what is owed grows by interest and shrinks by payments, so their sum is
    a difference of two balances. Due payments pay none in period 1 and lag by one period."""
    payment, due, last = pmt(rate, nper, pv, 0.0, kind), num(kind) != 0, whole(end)
    first = F.when(due, F.greatest(whole(start), F.lit(2.0))).otherwise(whole(start))
    lag = F.when(due, 1.0).otherwise(0.0)
    grown = fv(rate, last - lag, payment, pv, kind) - fv(rate, first - 1 - lag, payment, pv, kind)
    return F.when(last < first, 0.0).otherwise(grown + (last - first + 1) * payment)


_bad_range = (lambda rate, nper, pv, a, b, kind=0: (num(rate) <= 0) | (num(a) < 1) | (num(b) < num(a)) | (num(b) > num(nper)), NUM)
_f("CUMIPMT", _bad_range)(lambda rate, nper, pv, a, b, kind=0: _interest(rate, nper, pv, a, b, kind))
_f("CUMPRINC", _bad_range)(lambda rate, nper, pv, a, b, kind=0: (whole(b) - whole(a) + 1) * pmt(rate, nper, pv, 0.0, kind) - _interest(rate, nper, pv, a, b, kind))
_f("EFFECT", (lambda r, n: (num(r) <= 0) | (num(n) < 1), NUM))(lambda r, n: F.pow(1 + num(r) / whole(n), whole(n)) - 1)
_f("NOMINAL", (lambda r, n: (num(r) <= 0) | (num(n) < 1), NUM))(lambda r, n: whole(n) * (F.pow(1 + num(r), 1 / whole(n)) - 1))
_f("RRI", (lambda n, a, b: num(n) <= 0, NUM))(lambda n, a, b: F.pow(num(b) / num(a), 1 / num(n)) - 1)
_f("PDURATION", (lambda r, a, b: (num(r) <= 0) | (num(a) <= 0) | (num(b) <= 0), NUM))(lambda r, a, b: F.ln(num(b) / num(a)) / F.ln(1 + num(r)))
_f("DOLLARDE", (lambda x, n: num(n) < 0, NUM), (lambda x, n: whole(n) == 0, DIV0))(lambda x, n: whole(x) + (num(x) - whole(x)) * F.pow(F.lit(10.0), F.ceil(F.log10(whole(n)))) / whole(n))
_f("DOLLARFR", (lambda x, n: num(n) < 0, NUM), (lambda x, n: whole(n) == 0, DIV0))(lambda x, n: whole(x) + (num(x) - whole(x)) * whole(n) / F.pow(F.lit(10.0), F.ceil(F.log10(whole(n)))))


def _root(f, low, high, steps: int = 200):
    """Roots in brackets, on arrays, by Chandrupatla's method: inverse quadratic steps where three points allow one, else
    halves, down to the last places; NaN where the ends have the same sign."""
    fa, fb = f(low), f(high)
    a, b = np.broadcast_to(low, fa.shape).astype(float), np.broadcast_to(high, fb.shape).astype(float)
    good, out = np.sign(fa) * np.sign(fb) <= 0, np.where(fa == 0, a, b)
    done, t = ~good | (fa == 0) | (fb == 0), 0.5
    with np.errstate(all="ignore"):
        for _ in range(steps):
            if done.all():
                break
            x = a + t * (b - a)
            fx = f(x)
            none, same = np.isnan(fx), np.sign(fx) == np.sign(fa)
            c, fc = np.where(same, a, b), np.where(same, fa, fb)
            b, fb = np.where(none, x, np.where(same, b, a)), np.where(none, fx, np.where(same, fb, fa))
            a, fa = np.where(none, a, x), np.where(none, fa, fx)
            best = np.where(np.abs(fb) < np.abs(fa), b, a)
            out = np.where(done, out, best)
            least = 4.5e-16 * np.abs(best) / np.abs(b - a)
            done = done | (fa == 0) | ~(least <= 0.5)
            xi, phi = (a - b) / (c - b), (fa - fb) / (fc - fb)
            t = fa / (fb - fa) * fc / (fb - fc) + (c - a) / (b - a) * fa / (fc - fa) * fb / (fc - fb)
            t = np.where((phi * phi < xi) & ((1 - phi) ** 2 < 1 - xi) & np.isfinite(t), np.clip(t, least, 1 - least), 0.5)
    return np.where(good, out, np.nan)


def _rate(n, payment, pv, fv, kind):
    def left(r):
        g = (1 + r) ** n
        s = np.where(np.abs(r) < 1e-12, n, (g - 1) / np.where(r == 0, 1, r))
        return pv * g + payment * (1 + r * (kind != 0)) * s + fv

    # A rate between -99 % and 1,000 % a period; the search starts on the side where a sign change is.
    near = _root(left, np.full(n.shape, -0.99), np.full(n.shape, 10.0))
    return near


_f("RATE", (lambda n, *_: num(n) <= 0, NUM))(lambda n, payment, pv, fv=0.0, kind=0: vector(_rate, n, payment, pv, fv, kind))

# -- depreciation --------------------------------------------------------------------------------------------------

_f("SLN", (lambda c, s, n: num(n) == 0, DIV0))(lambda c, s, n: (num(c) - num(s)) / num(n))
_f("SYD", (lambda c, s, n, k: (num(k) < 1) | (num(k) > num(n)), NUM))(lambda c, s, n, k: (num(c) - num(s)) * (num(n) - num(k) + 1) * 2 / (num(n) * (num(n) + 1)))


@_f("DB", (lambda c, s, n, k, m=12: (num(k) < 1) | (num(k) > num(n) + 1), NUM))
def db(cost, salvage, life, period, month=12) -> Column:
    """A fixed rate, rounded to three places; the first year counts ``month`` months."""
    c, n, k, m = num(cost), num(life), whole(period), num(month)
    rate = F.round(1 - F.pow(num(salvage) / c, 1 / n), 3)
    first = c * rate * m / 12
    worth = (c - first) * F.pow(1 - rate, k - 2)
    return F.when(k == 1, first).when(k == n + 1, worth * rate * (12 - m) / 12).otherwise(worth * rate)


def _ddb(c, s, n, k, factor):
    rate = np.minimum(factor / n, 1.0)
    worth = lambda t: np.maximum(c * (1 - rate) ** t, s)
    return np.maximum(worth(k - 1) - worth(k), 0.0)


_f("DDB", (lambda c, s, n, k, factor=2.0: (num(k) < 1) | (num(k) > num(n)), NUM))(lambda c, s, n, k, factor=2.0: vector(_ddb, c, s, n, k, factor))


def _vdb(c, s, n, a, b, factor, straight):
    """Declining balance that changes to straight line where that gives more; parts of periods count in proportion."""
    out, left = np.zeros(c.shape), c.copy()
    for t in range(int(np.nanmax(np.ceil(b), initial=0))):
        rest = np.maximum(n - t, 1e-9)
        fall = np.minimum(left * factor / n, np.maximum(left - s, 0))
        line = np.maximum(left - s, 0) / np.maximum(rest, 1.0)
        step = np.where((straight == 0) & (line > fall), line, fall)
        share = np.clip(np.minimum(b, t + 1) - np.maximum(a, t), 0, 1)
        out += step * share
        left = left - step
    return out


_f("VDB", (lambda c, s, n, a, b, *_: (num(a) > num(b)) | (num(b) > num(n)), NUM))(lambda c, s, n, a, b, factor=2.0, no_switch=0: vector(_vdb, c, s, n, a, b, factor, no_switch))


@_f("AMORLINC")
def amorlinc(cost, purchased, first_period, salvage, period, rate, basis: int = 0) -> Column:
    """French linear depreciation: a part of the first year, then equal sums to the salvage value."""
    yearly, k = num(cost) * num(rate), whole(period)
    first = yearly * yearfrac(purchased, first_period, basis)
    room = num(cost) - num(salvage)
    before = F.when(k == 0, 0.0).otherwise(first + yearly * (k - 1))
    return F.greatest(F.lit(0.0), F.least(F.when(k == 0, first).otherwise(yearly), room - before))


def _amordegrc(cost, part, salvage, period, rate):
    life = 1 / rate
    factor = np.where(life <= 2, 1.0, np.where(life <= 4, 1.5, np.where(life <= 6, 2.0, 2.5)))
    fast = rate * factor
    worth = cost - np.floor(cost * fast * part + 0.5)
    out = np.where(period == 0, cost - worth, 0.0)
    total = np.ceil(life)
    for k in range(1, int(np.nanmax(period, initial=0)) + 1):
        step = np.floor(worth * fast + 0.5)
        step = np.where(k == total - 1, np.floor(worth * 0.5 + 0.5), np.where(k >= total, np.maximum(worth - salvage, 0) * 0, step))
        step = np.where(worth - step < salvage, np.maximum(worth - salvage, 0.0) * 0 + np.where(k >= total - 1, np.floor((worth - salvage) * 0.5 + 0.5), np.maximum(worth - salvage, 0.0)), step)
        out = np.where(period == k, step, out)
        worth = worth - step
    return out


_f("AMORDEGRC")(lambda cost, purchased, first_period, salvage, period, rate, basis=0: vector(_amordegrc, cost, yearfrac(purchased, first_period, basis), salvage, whole(period), rate))

# -- discounted and short securities -------------------------------------------------------------------------------

_late = (lambda a, b, *_: date(a) >= date(b), NUM)
_f("DISC", _late)(lambda a, b, price, par, basis=0: (num(par) - num(price)) / num(par) / yearfrac(a, b, basis))
_f("PRICEDISC", _late)(lambda a, b, rate, par, basis=0: num(par) * (1 - num(rate) * yearfrac(a, b, basis)))
_f("YIELDDISC", _late)(lambda a, b, price, par, basis=0: (num(par) / num(price) - 1) / yearfrac(a, b, basis))
_f("INTRATE", _late)(lambda a, b, paid, back, basis=0: (num(back) - num(paid)) / num(paid) / yearfrac(a, b, basis))
_f("RECEIVED", _late)(lambda a, b, paid, rate, basis=0: num(paid) / (1 - num(rate) * yearfrac(a, b, basis)))
_f("ACCRINTM", _late)(lambda a, b, rate, par=1000.0, basis=0: num(par) * num(rate) * yearfrac(a, b, basis))


@_f("PRICEMAT", _late)
def pricemat(settled, matures, issued, rate, yld, basis=0) -> Column:
    life, held, left = yearfrac(issued, matures, basis), yearfrac(issued, settled, basis), yearfrac(settled, matures, basis)
    return (100 + life * num(rate) * 100) / (1 + left * num(yld)) - held * num(rate) * 100


@_f("YIELDMAT", _late)
def yieldmat(settled, matures, issued, rate, price, basis=0) -> Column:
    life, held, left = yearfrac(issued, matures, basis), yearfrac(issued, settled, basis), yearfrac(settled, matures, basis)
    return ((1 + life * num(rate)) / (num(price) / 100 + held * num(rate)) - 1) / left


_days = lambda a, b: F.datediff(date(b), date(a))
_f("TBILLPRICE", _late)(lambda a, b, rate: 100 * (1 - num(rate) * _days(a, b) / 360))
_f("TBILLYIELD", _late)(lambda a, b, price: (100 - num(price)) / num(price) * 360 / _days(a, b))


@_f("TBILLEQ", _late)
def tbilleq(a, b, rate) -> Column:
    """Bond-equivalent yield; beyond half a year a coupon in the middle is reckoned with."""
    n, r = _days(a, b), num(rate)
    short = 365 * r / (360 - r * n)
    price, x = 1 - r * n / 360, n / F.when(n == 366, 366.0).otherwise(365.0)
    long = (-2 * x + 2 * F.sqrt(x * x - (2 * x - 1) * (1 - 1 / price))) / (2 * x - 1)
    return F.when(n <= 182, short).otherwise(long)


# -- coupons and bonds ---------------------------------------------------------------------------------------------


def _step(matures: Column, k: Column, frequency: int) -> Column:
    """The coupon date k periods before maturity; month ends stay month ends."""
    d = F.add_months(matures, -(k * (12 // frequency)).cast("int"))
    return F.when(matures == F.last_day(matures), F.last_day(d)).otherwise(d)


def _coupons(a, b, frequency: int) -> Column:
    """How many coupon dates lie after settlement, up to maturity."""
    a, b, m = date(a), date(b), 12 // frequency
    rough = F.floor(F.months_between(b, a) / m).cast("int")
    out = rough
    for extra in (0, 1):
        out = F.when(_step(b, rough + extra, frequency) > a, rough + extra + 1).otherwise(out)
    return F.when(_step(b, F.greatest(out - 1, F.lit(0)), frequency) <= a, out - 1).otherwise(out)


def _pcd(a, b, frequency: int) -> Column:
    return _step(date(b), _coupons(a, b, frequency), frequency)


def _ncd(a, b, frequency: int) -> Column:
    return _step(date(b), _coupons(a, b, frequency) - 1, frequency)


def _between(a, b, basis: int) -> Column:
    return days360(a, b, basis == 4) if basis in (0, 4) else F.datediff(b, a)


def _period(a, b, frequency: int, basis: int) -> Column:
    if basis == 1:
        return F.datediff(_ncd(a, b, frequency), _pcd(a, b, frequency)).cast("double")
    return F.lit((365.0 if basis == 3 else 360.0) / frequency)


_f("COUPNUM", _late)(lambda a, b, frequency, basis=0: _coupons(a, b, frequency))
_f("COUPPCD", _late)(lambda a, b, frequency, basis=0: _pcd(a, b, frequency))
_f("COUPNCD", _late)(lambda a, b, frequency, basis=0: _ncd(a, b, frequency))
_f("COUPDAYBS", _late)(lambda a, b, frequency, basis=0: _between(_pcd(a, b, frequency), date(a), basis).cast("double"))
_f("COUPDAYS", _late)(lambda a, b, frequency, basis=0: _period(a, b, frequency, basis))


@_f("COUPDAYSNC", _late)
def coupdaysnc(a, b, frequency: int, basis: int = 0) -> Column:
    if basis == 0:
        return _period(a, b, frequency, 0) - _between(_pcd(a, b, frequency), date(a), 0)
    return _between(date(a), _ncd(a, b, frequency), basis).cast("double")


def bond_price(rate, yld, par, frequency, n, before, days):
    """Price per 100 from the coupons left, days of the period gone by and days in it."""
    coupon, left = 100 * rate / frequency, 1 - before / days
    y = yld / frequency
    one = (par + coupon) / (1 + left * y) - coupon * before / days
    g = 1 + y
    with np.errstate(all="ignore"):
        annuity = np.where(np.abs(y) < 1e-12, n, (1 - g**-n) / np.where(y == 0, 1, y) * g)
    many = par * g ** (1 - n - left) + coupon * annuity * g**-left - coupon * before / days
    return np.where(n <= 1, one, many)


def _bond_args(a, b, frequency: int, basis: int) -> tuple[Column, ...]:
    return num(float(frequency)), num(_coupons(a, b, frequency)), num(_between(_pcd(a, b, frequency), date(a), basis)), _period(a, b, frequency, basis)


_f("PRICE", _late)(lambda a, b, rate, yld, par, frequency, basis=0: vector(bond_price, rate, yld, par, *_bond_args(a, b, frequency, basis)))


def _yield(rate, price, par, frequency, n, before, days):
    return _root(lambda y: bond_price(rate, y, par, frequency, n, before, days) - price, np.full(rate.shape, -0.9), np.full(rate.shape, 10.0))


_f("YIELD", _late)(lambda a, b, rate, price, par, frequency, basis=0: vector(_yield, rate, price, par, *_bond_args(a, b, frequency, basis)))


def _duration(rate, yld, frequency, n, before, days):
    """Macaulay duration in years, from sums of the powers of the discount."""
    y, left = yld / frequency, 1 - before / days
    top = bottom = np.zeros(rate.shape)
    for k in range(int(np.nanmax(n, initial=0))):
        pay = np.where(k < n, 100 * rate / frequency, 0.0) + np.where(k == n - 1, 100.0, 0.0)
        worth = pay * (1 + y) ** -(k + left)
        top, bottom = top + worth * (k + left), bottom + worth
    return top / bottom / frequency


_f("DURATION", _late)(lambda a, b, rate, yld, frequency, basis=0: vector(_duration, rate, yld, *_bond_args(a, b, frequency, basis)))
_f("MDURATION", _late)(lambda a, b, rate, yld, frequency, basis=0: vector(_duration, rate, yld, *_bond_args(a, b, frequency, basis)) / (1 + num(yld) / frequency))
_f("ACCRINT")(lambda issued, first, settled, rate, par=1000.0, frequency=1, basis=0: num(par) * num(rate) * yearfrac(issued, settled, basis))


@_f("ODDLPRICE", _late)
def oddlprice(a, b, last, rate, yld, par, frequency: int, basis: int = 0) -> Column:
    """Price with an odd last period, counted in periods of 12 / frequency months from the last coupon."""
    gone, whole_, left = (yearfrac(x, y, basis) * frequency for x, y in ((last, a), (last, b), (a, b)))
    coupon = 100 * num(rate) / frequency
    return (num(par) + whole_ * coupon) / (1 + left * num(yld) / frequency) - gone * coupon


@_f("ODDLYIELD", _late)
def oddlyield(a, b, last, rate, price, par, frequency: int, basis: int = 0) -> Column:
    gone, whole_, left = (yearfrac(x, y, basis) * frequency for x, y in ((last, a), (last, b), (a, b)))
    coupon = 100 * num(rate) / frequency
    return ((num(par) + whole_ * coupon) / (num(price) + gone * coupon) - 1) * frequency / left


def odd_first_price(rate, yld, par, frequency, n, gone, first, to_first):
    """``n`` whole periods after an odd first one; the others are parts of periods: before settlement, all, after it."""
    y, coupon = yld / frequency, 100 * rate / frequency
    out = coupon * first * (1 + y) ** -to_first - coupon * gone
    for k in range(1, int(np.nanmax(n, initial=0)) + 1):
        out = out + np.where(k <= n, coupon * (1 + y) ** -(to_first + k), 0.0)
    return out + par * (1 + y) ** -(to_first + n)


def _odd_first_args(a, b, issued, first, frequency: int, basis: int) -> tuple[Column, ...]:
    part = lambda x, y: yearfrac(x, y, basis) * frequency
    n = F.round(F.months_between(date(b), date(first)) / (12 // frequency))
    return num(float(frequency)), num(n), part(issued, a), part(issued, first), part(a, first)


_f("ODDFPRICE", _late)(lambda a, b, issued, first, rate, yld, par, frequency, basis=0: vector(odd_first_price, rate, yld, par, *_odd_first_args(a, b, issued, first, frequency, basis)))


def _odd_first_yield(rate, price, par, *rest):
    return _root(lambda y: odd_first_price(rate, y, par, *rest) - price, np.full(rate.shape, -0.9), np.full(rate.shape, 10.0))


_f("ODDFYIELD", _late)(lambda a, b, issued, first, rate, price, par, frequency, basis=0: vector(_odd_first_yield, rate, price, par, *_odd_first_args(a, b, issued, first, frequency, basis)))

# -- cash flows in arrays ------------------------------------------------------------------------------------------

_f("NPV")(lambda rate, flows: F.reduce(F.transform(flows, lambda v, i: v / F.pow(1 + num(rate), i + 1)), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0))))
_f("FVSCHEDULE")(lambda principal, rates: F.reduce(rates, num(principal), lambda acc, r: acc * (1 + F.coalesce(r, F.lit(0.0)))))


@_f("XNPV")
def xnpv(rate, flows: Column, dates: Column) -> Column:
    first = F.element_at(dates, 1)
    worth = F.zip_with(flows, dates, lambda v, d: v / F.pow(1 + num(rate), F.datediff(d, first) / 365.0))
    return F.reduce(worth, F.lit(0.0), lambda acc, v: acc + v)


@_f("MIRR")
def mirr(flows: Column, finance, reinvest) -> Column:
    n = F.size(flows)
    gains = F.reduce(F.transform(flows, lambda v, i: F.greatest(v, F.lit(0.0)) * F.pow(1 + num(reinvest), n - 1 - i)), F.lit(0.0), lambda a, v: a + v)
    costs = F.reduce(F.transform(flows, lambda v, i: F.least(v, F.lit(0.0)) / F.pow(1 + num(finance), i)), F.lit(0.0), lambda a, v: a + v)
    return F.pow(F.try_divide(gains, -costs), 1.0 / (n - 1)) - 1


#: The rates between which sign changes are looked for.
_GRID = np.concatenate((np.linspace(-0.99, 1, 400), np.geomspace(1.01, 100, 100)))


def _irr(values: np.ndarray, times: np.ndarray, guess: float) -> np.ndarray:
    """For rows of flows and their times: the root of the present value nearest the guess, among sign changes on the grid.

    Rows of the same times share the powers of the grid. The rates around the guess come first; rows without a sign change
    there go through the whole grid. The roots of all rows are closed in together.
    """
    out, at = np.full(len(values), np.nan), np.full(len(values), -1)
    far = np.abs(_GRID[:-1] - guess)
    first = int(np.argsort(far, kind="stable")[:64].min())
    kinds, kind = (times[:1], np.zeros(len(times), int)) if (times == times[:1]).all() else np.unique(times, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    mixed = (values > 0).any(1) & (values < 0).any(1)
    with np.errstate(all="ignore"):
        for t, rows in zip(kinds, np.split(order, np.cumsum(np.bincount(kind.ravel()))[:-1]), strict=True):
            rows = rows[mixed[rows]]
            for low, high in ((first, first + 65), (0, len(_GRID))):
                rows = rows[at[rows] < 0]
                if not len(rows):
                    break
                powers = (1 + _GRID[low:high]) ** -t[:, None]
                for k in range(0, len(rows), 1000):
                    some = rows[k : k + 1000]
                    sign = np.sign(values[some] @ powers)
                    changes = sign[:, 1:] * sign[:, :-1] <= 0
                    nearest = np.where(changes, far[low : high - 1], np.inf).argmin(1) + low
                    at[some] = np.where(changes.any(1), nearest, -1)
        found = np.flatnonzero(at >= 0)
        for k in range(0, len(found), 1000):
            some = found[k : k + 1000]
            v, t, low = values[some], times[some], at[some]
            out[some] = _root(lambda r, v=v, t=t: (v * (1 + r)[:, None] ** -t).sum(1), _GRID[low], _GRID[low + 1])
    return out


def _irr_of(rows: pd.Series, days: pd.Series | None, guess: float) -> pd.Series:
    """Rows go by their number of flows; none where flows or days are missing or not equally many. Without days, flows are
    a period apart."""
    out = np.full(len(rows), np.nan)
    sizes, others = (np.array([-1 if v is None else len(v) for v in x], int) for x in (rows, rows if days is None else days))
    for n in np.unique(sizes[(sizes > 0) & (sizes == others)]):
        at = np.flatnonzero((sizes == n) & (others == n))
        flows = np.concatenate(rows.iloc[at].tolist()).astype(float).reshape(-1, n)
        times = np.broadcast_to(np.arange(float(n)), flows.shape) if days is None else np.concatenate(days.iloc[at].tolist()).astype(float).reshape(-1, n) / 365
        out[at] = _irr(flows, times, guess)
    return pd.Series(out)


_mixed_signs = (lambda flows, *_: ~(F.exists(flows, lambda v: v > 0) & F.exists(flows, lambda v: v < 0)), NUM)


@_f("IRR", _mixed_signs)
def irr(flows: Column, guess: float = 0.1) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return _irr_of(rows, None, guess)

    return F.pandas_udf(run, "double")(flows.cast("array<double>"))


@_f("XIRR", _mixed_signs)
def xirr(flows: Column, dates: Column, guess: float = 0.1) -> Column:
    def run(rows: pd.Series, days: pd.Series) -> pd.Series:
        return _irr_of(rows, days, guess)

    days = F.transform(dates, lambda d: F.datediff(d, F.element_at(dates, 1)).cast("double"))
    return F.pandas_udf(run, "double")(flows.cast("array<double>"), days)


def present_value(df, rate: float, value: str, order: str, by: list[str]):
    """NPV of rows: one cash flow per row, in the order of a column, for each group."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_k", k).groupBy(*by).agg(F.sum(col(value) / F.pow(F.lit(1 + rate), F.col("_k"))).alias("npv"))
