"""Text functions. Positions count from 1; blanks count as empty text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.math import half_away
from tabulon.functions.registry import CATALOGUE, NA, NUM, VALUE, function, num

FAMILY = "text"


def _f(name: str, *guards):
    return function(name, *guards, family=FAMILY)


def txt(x) -> Column:
    """Text of a column (a Python string is a literal here); null is empty."""
    c = x if isinstance(x, Column) else F.lit(x)
    return F.coalesce(c.cast("string"), F.lit(""))


def _int(x) -> Column:
    return num(x).cast("int")


_f("LEN")(lambda t: F.length(txt(t)))
_f("LEFT", (lambda t, n=1: num(n) < 0, NUM))(lambda t, n=1: F.substr(txt(t), F.lit(1), F.greatest(_int(n), F.lit(0))))
_f("RIGHT", (lambda t, n=1: num(n) < 0, NUM))(
    lambda t, n=1: F.when(_int(n) == 0, "").when(_int(n) >= F.length(txt(t)), txt(t)).otherwise(F.substr(txt(t), -_int(n), _int(n)))
)
_f("MID", (lambda t, s, n: (num(s) < 1) | (num(n) < 0), NUM))(lambda t, s, n: F.substr(txt(t), _int(s), F.greatest(_int(n), F.lit(0))))
_f("TRIM")(lambda t: F.regexp_replace(F.trim(txt(t)), " +", " "))
_f("UPPER")(lambda t: F.upper(txt(t)))
_f("LOWER")(lambda t: F.lower(txt(t)))
_f("CONCATENATE")(lambda *ts: F.concat(*map(txt, ts)))
_f("CONCAT")(lambda *ts: F.concat(*map(txt, ts)))
_f("EXACT")(lambda a, b: txt(a) == txt(b))
_f("REPT", (lambda t, n: num(n) < 0, VALUE))(lambda t, n: F.repeat(txt(t), _int(n)))
_f("CLEAN")(lambda t: F.regexp_replace(txt(t), r"[\x00-\x1F]", ""))
_f("UNICODE", (lambda t: F.length(txt(t)) == 0, VALUE))(lambda t: F.ascii(txt(t)))
_f("CODE", (lambda t: F.length(txt(t)) == 0, VALUE))(lambda t: F.ascii(txt(t)))
_f("CHAR", (lambda n: (num(n) < 1) | (num(n) >= 256), VALUE))(lambda n: F.char(_int(n)))


@_f("UNICHAR", (lambda n: (num(n) < 1) | (num(n) > 0x10FFFF), VALUE))
def unichar(n) -> Column:
    """The four UTF-32 bytes of the code point, decoded."""
    return F.decode(F.unhex(F.lpad(F.hex(num(n).cast("bigint")), 8, "0")), "UTF-32")


@_f("PROPER")
def proper(t) -> Column:
    """A letter is large after anything that is no letter."""
    parts = F.regexp_extract_all(txt(t), F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)
    cased = F.transform(parts, lambda p: F.concat(F.upper(F.substr(p, F.lit(1), F.lit(1))), F.lower(F.substr(p, F.lit(2)))))
    return F.array_join(cased, "")


@_f("FIND", (lambda s, t, at=1: (num(at) < 1) | (find(s, t, at) == 0), VALUE))
def find(s, t, at=1) -> Column:
    return F.position(txt(s), txt(t), _int(at))


def wildcard(pattern: str, anchored: bool = True) -> str:
    """The regular expression of a pattern with ``*``, ``?`` and the escape ``~``; case does not count."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            out.append(re.escape(pattern[i + 1]))
            i += 1
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c))
        i += 1
    body = "".join(out)
    return f"(?is)^{body}$" if anchored else f"(?is){body}"


@_f("SEARCH", (lambda s, t, at=1: (num(at) < 1) | (search(s, t, at) == 0), VALUE))
def search(s: str, t, at=1) -> Column:
    """Position of a pattern with wildcards, without regard to case."""
    rest = F.substr(txt(t), _int(at))
    found = F.regexp_instr(rest, F.lit(wildcard(s, anchored=False)))
    return F.when(found == 0, 0).otherwise(found + _int(at) - 1)


@_f("SUBSTITUTE")
def substitute(t, old, new, instance: int | None = None) -> Column:
    t, old, new = txt(t), txt(old), txt(new)
    if instance is None:
        return F.when(F.length(old) == 0, t).otherwise(F.replace(t, old, new))
    parts = F.split(t, F.concat(F.lit(r"\Q"), old, F.lit(r"\E")), -1)
    head = joined_with(F.slice(parts, 1, instance), old)
    tail = joined_with(F.slice(parts, instance + 1, 1_000_000), old)
    return F.when((F.length(old) == 0) | (F.size(parts) <= instance), t).otherwise(F.concat(head, new, tail))


def joined_with(parts: Column, glue: Column) -> Column:
    """array_join with a column as the glue."""
    return F.when(F.size(parts) == 0, "").otherwise(
        F.reduce(F.slice(parts, 2, 1_000_000), F.element_at(parts, 1), lambda acc, p: F.concat(acc, glue, p))
    )


@_f("REPLACE", (lambda t, s, n, new: (num(s) < 1) | (num(n) < 0), VALUE))
def replace(t, s, n, new) -> Column:
    return F.concat(F.substr(txt(t), F.lit(1), _int(s) - 1), txt(new), F.substr(txt(t), _int(s) + _int(n)))


@_f("TEXTJOIN")
def textjoin(delimiter: str, ignore_empty: bool, *ts) -> Column:
    parts = F.array(*map(txt, ts))
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0) if ignore_empty else parts, delimiter)


def _nth(t, delimiter: str, n: int, before: bool) -> Column:
    parts = F.split(txt(t), re.escape(delimiter), -1)
    k = F.lit(n) if n > 0 else F.size(parts) + n
    if before:
        return F.when((k < 1) | (k >= F.size(parts)), F.lit(None)).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(k, F.lit(0))), delimiter))
    rest = F.slice(parts, F.greatest(k, F.lit(0)) + 1, F.size(parts))
    return F.when((k < 1) | (k >= F.size(parts)), F.lit(None)).otherwise(F.array_join(rest, delimiter))


_f("TEXTBEFORE", (lambda t, d, n=1: _nth(t, d, n, True).isNull(), NA))(lambda t, d, n=1: _nth(t, d, n, True))
_f("TEXTAFTER", (lambda t, d, n=1: _nth(t, d, n, False).isNull(), NA))(lambda t, d, n=1: _nth(t, d, n, False))


@_f("TEXTSPLIT")
def textsplit(t, column_delimiter: str, row_delimiter: str | None = None, ignore_empty: bool = False) -> Column:
    """An array of rows, each an array of texts."""
    rows = F.split(txt(t), re.escape(row_delimiter), -1) if row_delimiter else F.array(txt(t))
    out = F.transform(rows, lambda r: F.split(r, re.escape(column_delimiter), -1))
    return F.transform(out, lambda r: F.filter(r, lambda x: F.length(x) > 0)) if ignore_empty else out


_f("T")(lambda t: F.coalesce(t, F.lit("")) if isinstance(t, Column) else F.lit(t if isinstance(t, str) else ""))


def parsed(t) -> Column:
    """Number of a text with optional thousands commas, currency sign and percent; null when it is none."""
    clean = F.regexp_replace(F.trim(txt(t)), r"[$,\s]", "")
    percent = F.length(F.regexp_replace(clean, "[^%]", ""))
    return F.regexp_replace(clean, "%+$", "").try_cast("double") / F.pow(F.lit(100.0), percent)


_f("VALUE", (lambda t: parsed(t).isNull(), VALUE))(parsed)


@_f("NUMBERVALUE", (lambda t, d=".", g=",": _numbervalue(t, d, g).isNull(), VALUE))
def numbervalue(t, d: str = ".", g: str = ",") -> Column:
    return _numbervalue(t, d, g)


def _numbervalue(t, d: str, g: str) -> Column:
    clean = F.replace(F.replace(F.regexp_replace(txt(t), r"\s", ""), F.lit(g), F.lit("")), F.lit(d), F.lit("."))
    percent = F.length(F.regexp_replace(clean, "[^%]", ""))
    body = F.regexp_replace(clean, "%+$", "")
    return F.when(F.length(body) == 0, 0.0).otherwise(body.try_cast("double") / F.pow(F.lit(100.0), percent))


def _scaled(x, d: int) -> Column:
    return half_away(num(x) * 10.0**d) / 10.0**d


@_f("FIXED")
def fixed(x, decimals: int = 2, no_commas: bool = False) -> Column:
    shown = F.format_number(_scaled(x, decimals), max(decimals, 0))
    return F.replace(shown, F.lit(","), F.lit("")) if no_commas else shown


@_f("DOLLAR")
def dollar(x, decimals: int = 2) -> Column:
    shown = F.concat(F.lit("$"), F.format_number(F.abs(_scaled(x, decimals)), max(decimals, 0)))
    return F.when(_scaled(x, decimals) < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def shown_number(x) -> Column:
    """A number as text: whole numbers without a point, others with up to 15 digits."""
    x = num(x)
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(20,0)").cast("string")).otherwise(
        F.regexp_replace(x.cast("string"), r"\.0$", "")
    )


# Parts of spreadsheet date codes and of Spark's.
_DATE_CODES = [("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("mm", "MM"), ("m", "M"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"), ("hh", "HH"), ("h", "H"), ("ss", "ss"), ("s", "s"), ("AM/PM", "a")]


def date_pattern(code: str) -> str:
    """Spark's pattern of a date code; ``m`` after an hour or before seconds is minutes."""
    out, i, after_hour = [], 0, False
    twelve = "AM/PM" in code.upper()
    while i < len(code):
        for part, spark in _DATE_CODES:
            if code[i : i + len(part)].lower() == part.lower():
                rest = code[i + len(part) :].lstrip(":. ").lower()
                if part in ("m", "mm") and (after_hour or rest.startswith("s")):
                    spark = spark.lower()
                elif part[0] == "h" and twelve:
                    spark = spark.lower()
                after_hour = part[0] == "h" or after_hour and part[0] not in "yd"
                out.append(spark)
                i += len(part)
                break
        else:
            out.append(f"'{code[i]}'" if code[i].isalpha() else code[i])
            i += 1
    return "".join(out)


@_f("TEXT")
def text(x: Column, code: str) -> Column:
    """Numbers by codes such as ``0.00``, ``#,##0`` and ``0%``; dates by codes such as ``yyyy-mm-dd``."""
    if re.search(r"[ymdhs]", code, re.IGNORECASE) and not re.search(r"[0#]", code):
        return F.date_format(x, date_pattern(code))
    percent = code.endswith("%")
    body = code.rstrip("%")
    whole_part, _, fraction = body.partition(".")
    shown = F.format_number(_scaled(num(x) * (100 if percent else 1), len(fraction)), len(fraction))
    if "," not in whole_part:
        shown = F.replace(shown, F.lit(","), F.lit(""))
    zeros = whole_part.count("0")
    if zeros > 1:
        sign = F.when(num(x) < 0, "-").otherwise("")
        bare = F.replace(shown, F.lit("-"), F.lit(""))
        width = zeros + (len(fraction) + 1 if fraction else 0)
        shown = F.concat(sign, F.when(F.length(bare) < width, F.lpad(bare, width, "0")).otherwise(bare))
    elif zeros == 0 and not fraction:
        shown = F.when(_scaled(x, 0) == 0, "").otherwise(shown)
    return F.concat(shown, F.lit("%")) if percent else shown


_f("VALUETOTEXT")(lambda x, form=0: txt(x) if form == 0 else F.concat(F.lit('"'), F.replace(txt(x), F.lit('"'), F.lit('""')), F.lit('"')))
_f("ARRAYTOTEXT")(lambda xs, form=0: F.array_join(xs.cast("array<string>"), ", ") if form == 0 else F.concat(F.lit("{"), F.array_join(xs.cast("array<string>"), ","), F.lit("}")))


# -- regular expressions -------------------------------------------------------------------------------------------

MAX_PATTERN = 8192


def safe_pattern(pattern: str) -> str:
    """The pattern, if it cannot run away: no repeated group may itself end in a repetition."""
    if len(pattern) > MAX_PATTERN:
        raise ValueError("pattern too long")
    bare = re.sub(r"\\.|\[[^\]]*\]", "x", pattern)
    if re.search(r"\([^()]*[*+}][^()]*\)\s*(?:[*+]|\{\d+,\}?)", bare):
        raise ValueError("pattern with a repeated group that repeats inside")
    re.compile(pattern)
    return pattern


def _cased(pattern: str, case: int) -> str:
    return ("(?i)" if case else "") + safe_pattern(pattern)


_f("REGEXTEST")(lambda t, p, case=0: txt(t).rlike(_cased(p, case)))


@_f("REGEXEXTRACT", (lambda t, p, mode=0, case=0: ~txt(t).rlike(_cased(p, case)), NA))
def regexextract(t, p: str, mode: int = 0, case: int = 0) -> Column:
    """First match (0), all matches (1) or the groups of the first (2)."""
    pattern = _cased(p, case)
    if mode == 0:
        return F.regexp_extract(txt(t), pattern, 0)
    if mode == 1:
        return F.regexp_extract_all(txt(t), F.lit(pattern), 0)
    return F.array(*(F.regexp_extract(txt(t), pattern, k) for k in range(1, re.compile(p).groups + 1)))


@_f("REGEXREPLACE")
def regexreplace(t, p: str, new: str, instance: int = 0, case: int = 0) -> Column:
    pattern = _cased(p, case)
    if instance == 0:
        return F.regexp_replace(txt(t), pattern, new)
    found = F.regexp_extract_all(txt(t), F.lit(pattern), 0)
    between = F.split(txt(t), pattern, -1)
    k = F.lit(instance) if instance > 0 else F.size(found) + 1 + instance
    swapped = F.transform(found, lambda m, i: F.when(i + 1 == k, F.lit(new)).otherwise(m))
    pieces = F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(swapped, i), F.lit(""))))
    return F.array_join(pieces, "")


# -- widths and byte variants --------------------------------------------------------------------------------------

for _name in ("LEN", "LEFT", "RIGHT", "MID", "FIND", "SEARCH", "REPLACE"):  # one byte a character, as in a Western locale
    _f(_name + "B", *CATALOGUE[_name].guards)(CATALOGUE[_name].build)

_HALF = "".join(map(chr, range(0x21, 0x7F)))
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_f("DBCS")(lambda t: F.translate(txt(t), _HALF + " ", _FULL + "　"))
_f("JIS")(lambda t: F.translate(txt(t), _HALF + " ", _FULL + "　"))
_f("ASC")(lambda t: F.translate(txt(t), _FULL + "　", _HALF + " "))
_f("PHONETIC")(lambda t: F.lit(""))

# Thai number words.
_THAI_DIGITS = "ศูนย์ หนึ่ง สอง สาม สี่ ห้า หก เจ็ด แปด เก้า".split()
_THAI_PLACES = ["", "สิบ", "ร้อย", "พัน", "หมื่น", "แสน"]


def _thai_group(n: Column) -> Column:
    """Words of a number below a million."""
    parts = []
    for place in range(5, -1, -1):
        digit = (F.floor(n / 10**place) % 10).cast("int")
        words = F.element_at(F.array(*map(F.lit, _THAI_DIGITS)), digit + 1)
        word = F.concat(words, F.lit(_THAI_PLACES[place]))
        if place == 1:
            word = F.when(digit == 1, _THAI_PLACES[1]).when(digit == 2, "ยี่" + _THAI_PLACES[1]).otherwise(word)
        if place == 0:
            word = F.when((digit == 1) & (n > 10), "เอ็ด").otherwise(word)
        parts.append(F.when(digit == 0, "").otherwise(word))
    return F.concat(*parts)


@_f("BAHTTEXT")
def bahttext(x) -> Column:
    """A sum of money below 10**12 in Thai words."""
    satang = half_away(F.abs(num(x)) * 100)
    baht, rest = F.floor(satang / 100), satang % 100
    high = F.floor(baht / 1_000_000)
    spelled = F.concat(F.when(high > 0, F.concat(_thai_group(high), F.lit("ล้าน"))).otherwise(""), _thai_group(baht % 1_000_000))
    whole = F.when((baht == 0) & (rest > 0), "").when(baht == 0, "ศูนย์บาท").otherwise(F.concat(spelled, F.lit("บาท")))
    tail = F.when(rest == 0, "ถ้วน").otherwise(F.concat(_thai_group(rest), F.lit("สตางค์")))
    return F.concat(F.when(num(x) < 0, "ลบ").otherwise(""), whole, tail)
