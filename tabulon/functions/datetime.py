"""Date and time functions over Spark dates and timestamps, and the serial numbers of spreadsheets.

A serial counts days from 1899-12-31 = 0, with a day 60 that never was (1900-02-29); its fraction is the time of day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.registry import NUM, VALUE, col, function, num

FAMILY = "date"
MAX_SERIAL = 2_958_465


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


def date(x) -> Column:
    return col(x).cast("date")


def serial(x) -> Column:
    """Serial number of a date or timestamp."""
    x = col(x).cast("timestamp_ntz")
    days = F.datediff(x.cast("date"), F.lit("1899-12-31").cast("date")).cast("double")
    seconds = F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
    return F.when(days >= 60, days + 1).otherwise(days) + seconds / 86400.0


def from_serial(s) -> Column:
    """Date of a serial number; day 60 reads as 1900-02-28."""
    n = F.floor(num(s)).cast("int")
    return F.date_add(F.lit("1899-12-31").cast("date"), F.when(n >= 60, n - 1).otherwise(n))


_f("YEAR")(lambda d: F.year(date(d)))
_f("MONTH")(lambda d: F.month(date(d)))
_f("DAY")(lambda d: F.day(date(d)))
_f("HOUR")(lambda t: F.hour(col(t)))
_f("MINUTE")(lambda t: F.minute(col(t)))
_f("SECOND")(lambda t: F.second(col(t)))
_f("TODAY")(lambda clock=None: F.current_date() if clock is None else F.lit(clock).cast("date"))
_f("NOW")(lambda clock=None: F.current_timestamp() if clock is None else F.lit(clock).cast("timestamp"))
_f("DAYS")(lambda end, start: F.datediff(date(end), date(start)))
_f("EDATE")(lambda d, n: F.add_months(date(d), num(n).cast("int")))
_f("EOMONTH")(lambda d, n: F.last_day(F.add_months(date(d), num(n).cast("int"))))
_f("ISOWEEKNUM")(lambda d: F.weekofyear(date(d)))
_f("TIME")(lambda h, m, s: F.pmod(num(h) * 3600 + num(m) * 60 + num(s), F.lit(86400.0)) / 86400.0)


@_f("DATE")
def date_(y, m, d) -> Column:
    """Months and days beyond their ranges carry over; years below 1900 count from 1900."""
    y = F.when(num(y) < 1900, num(y) + 1900).otherwise(num(y)).cast("int")
    first = F.make_date(y, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, num(m).cast("int") - 1), num(d).cast("int") - 1)


# The date forms that are understood.
_FORMS = ["yyyy-M-d", "M/d/yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d"]


def _date_value(t: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(form)) for form in _FORMS)).cast("date")


_f("DATEVALUE", (lambda t: _date_value(t).isNull(), VALUE))(lambda t: serial(_date_value(t)))


def _time_value(t: Column) -> Column:
    last = F.upper(F.trim(t))
    h, m, s = (F.regexp_extract(last, r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?\s*(AM|PM)?$", k) for k in (1, 2, 3))
    half = F.regexp_extract(last, r"(AM|PM)$", 1)
    hour = h.try_cast("int")
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    return (hour * 3600 + m.try_cast("int") * 60 + F.coalesce(s.try_cast("int"), F.lit(0))) / 86400.0


_f("TIMEVALUE", (lambda t: _time_value(t).isNull(), VALUE))(_time_value)


@_f("WEEKDAY", (lambda d, kind=1: F.lit(kind not in (1, 2, 3, *range(11, 18))), NUM))
def weekday(d, kind: int = 1) -> Column:
    monday = F.weekday(date(d))  # 0 is Monday
    if kind == 3:
        return monday
    first = {1: 6, 2: 0}.get(kind, kind - 11)  # the day that counts as 1
    return F.pmod(monday - first, F.lit(7)) + 1


@_f("WEEKNUM", (lambda d, kind=1: F.lit(kind not in (1, 2, 21, *range(11, 18))), NUM))
def weeknum(d, kind: int = 1) -> Column:
    if kind == 21:
        return F.weekofyear(date(d))
    first = {1: 6, 2: 0}.get(kind, kind - 11)
    start = F.trunc(date(d), "year")
    return F.floor((F.datediff(date(d), start) + F.pmod(F.weekday(start) - first, F.lit(7))) / 7).cast("int") + 1


@_f("DAYS360")
def days360(start, end, european: bool = False) -> Column:
    a, b = date(start), date(end)
    d1, d2 = F.day(a), F.day(b)
    if european:
        d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        a_last, b_last = a == F.last_day(a), b == F.last_day(b)
        february = a_last & (F.month(a) == 2)
        d2 = F.when(february & b_last & (F.month(b) == 2), 30).otherwise(d2)
        d1 = F.when(february | (d1 == 31), 30).otherwise(d1)
        d2 = F.when((d2 == 31) & (d1 >= 30), 30).otherwise(d2)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1


def whole_months(a: Column, b: Column) -> Column:
    """Complete months from a to b."""
    n = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return n - F.when(F.day(b) < F.day(a), 1).otherwise(0)


@_f("DATEDIF", (lambda a, b, unit: date(a) > date(b), NUM), (lambda a, b, unit: F.lit(unit.upper() not in ("Y", "M", "D", "YM", "YD", "MD")), NUM))
def datedif(a, b, unit: str) -> Column:
    a, b, unit = date(a), date(b), unit.upper()
    months = whole_months(a, b)
    if unit == "Y":
        return F.floor(months / 12).cast("int")
    if unit == "M":
        return months.cast("int")
    if unit == "D":
        return F.datediff(b, a)
    if unit == "YM":
        return (months % 12).cast("int")
    if unit == "YD":
        return F.datediff(b, F.add_months(a, (F.floor(months / 12) * 12).cast("int")))
    borrowed = F.day(F.last_day(F.add_months(b, F.lit(-1))))
    return F.when(F.day(b) >= F.day(a), F.day(b) - F.day(a)).otherwise(F.day(b) - F.day(a) + borrowed)


# -- working days --------------------------------------------------------------------------------------------------


def weekend_mask(weekend: int | str = 1) -> str:
    """Seven marks from Monday; 1 is a day off."""
    if isinstance(weekend, str):
        if len(weekend) != 7 or set(weekend) - set("01") or weekend == "1111111":
            raise ValueError(VALUE)
        return weekend
    if weekend in range(1, 8):
        off = {(weekend + 4) % 7, (weekend + 5) % 7}
    elif weekend in range(11, 18):
        off = {(weekend - 12) % 7}
    else:
        raise ValueError(NUM)
    return "".join("1" if k in off else "0" for k in range(7))


def _off_days(mask: str) -> list[int]:
    return [k for k in range(7) if mask[k] == "1"]


def _ascending_networkdays(a: Column, b: Column, mask: str, holidays: Column | None) -> Column:
    """Days at work from a to b, both counted: whole weeks, and at most six more days."""
    n = F.datediff(b, a) + 1
    open_days = 7 - len(_off_days(mask))
    first = F.weekday(a)
    rest = sum((F.when((F.lit(k) < n % 7) & ~F.pmod(first + k, F.lit(7)).isin(_off_days(mask) or [-1]), 1).otherwise(0) for k in range(6)), F.lit(0))
    out = F.floor(n / 7).cast("int") * open_days + rest
    if holidays is not None:
        taken = F.filter(F.array_distinct(holidays), lambda h: (h >= a) & (h <= b) & ~F.weekday(h).isin(_off_days(mask) or [-1]))
        out = out - F.size(taken)
    return out


@_f("NETWORKDAYS.INTL")
def networkdays_intl(start, end, weekend: int | str = 1, holidays: Column | None = None) -> Column:
    a, b, mask = date(start), date(end), weekend_mask(weekend)
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(a <= b, 1).otherwise(-1) * _ascending_networkdays(low, high, mask, holidays)


_f("NETWORKDAYS")(lambda start, end, holidays=None: networkdays_intl(start, end, 1, holidays))


@_f("WORKDAY.INTL")
def workday_intl(start, days, weekend: int | str = 1, holidays: Column | None = None) -> Column:
    """The day n working days on; the start does not count. Looks through just the span that can hold the answer."""
    a, n, mask = date(start), num(days).cast("int"), weekend_mask(weekend)
    open_days = 7 - len(_off_days(mask))
    extra = F.size(holidays) if holidays is not None else F.lit(0)
    span = (F.ceil((F.abs(n) + extra) / open_days) * 7 + 7).cast("int")
    step = F.when(n >= 0, 1).otherwise(-1)
    candidates = F.transform(F.sequence(F.lit(1), span), lambda k: F.date_add(a, (k * step).cast("int")))
    free = lambda d: F.weekday(d).isin(_off_days(mask) or [-1])
    if holidays is None:
        at_work = F.filter(candidates, lambda d: ~free(d))
    else:
        at_work = F.filter(candidates, lambda d: ~free(d) & ~F.array_contains(holidays, d))
    return F.when(n == 0, a).otherwise(F.get(at_work, F.abs(n) - 1))


_f("WORKDAY")(lambda start, days, holidays=None: workday_intl(start, days, 1, holidays))


@_f("YEARFRAC", (lambda a, b, basis=0: F.lit(basis not in range(5)), NUM))
def yearfrac(start, end, basis: int = 0) -> Column:
    """Part of a year between two dates, by day-count basis 0 to 4."""
    a, b = F.least(date(start), date(end)), F.greatest(date(start), date(end))
    if basis in (0, 4):
        return days360(a, b, basis == 4) / 360.0
    days = F.datediff(b, a)
    if basis == 2:
        return days / 360.0
    if basis == 3:
        return days / 365.0
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    within = F.add_months(a, F.lit(12)) >= b
    has_leap_day = (leap(F.year(a)) & (a <= F.make_date(F.year(a), F.lit(2), F.lit(28)))) | (
        leap(F.year(b)) & (b > F.make_date(F.year(b), F.lit(2), F.lit(28)))
    )
    same_year = F.when(leap(F.year(a)), 366.0).otherwise(365.0)
    short = F.when(F.year(a) == F.year(b), same_year).otherwise(F.when(has_leap_day, 366.0).otherwise(365.0))
    years = F.year(b) - F.year(a) + 1
    average = F.datediff(F.make_date(F.year(b) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(a), F.lit(1), F.lit(1))) / years
    return F.when(days == 0, 0.0).otherwise(days / F.when(within, short).otherwise(average))
