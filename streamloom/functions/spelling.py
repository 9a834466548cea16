"""Parsing of settings as columns; what can't be parsed is null."""

from __future__ import annotations

from pyspark.sql import functions as F


_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def quantity(s):
    """96k, 2M, -1.5G, 1e3: a decimal with a metric suffix (k or K, M, G) whose product is whole and has 64 bits."""
    pattern = rf"^({_DECIMAL})([kKMG]?)$"
    unit = F.regexp_extract(s, pattern, 2)
    factor = F.when(F.lower(unit) == "k", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    value = F.regexp_extract(s, pattern, 1).try_cast("double") * factor
    return F.when((value == F.rint(value)) & (F.abs(value) <= 9.2e18), value.cast("long"))


def setting(s, kind: str, low: float, high: float, choices: list[str]):
    """A setting's value in canonical form, null where its type or its bounds (both 0: none) refuse it."""
    inside = lambda v: F.lit(low == 0 and high == 0) | v.between(low, high)
    if kind == "bool":
        return boolean(s).cast("string")
    if kind == "int":
        number = quantity(s)
        return F.when(inside(number), number.cast("string"))
    if kind == "float":
        number = F.when(F.regexp_like(s, F.lit(f"^{_DECIMAL}$")), s.try_cast("double"))
        return F.when(inside(number), F.regexp_replace(number.cast("string"), r"\.0$", ""))
    if kind == "enum":
        out = F.lit(None).cast("string")
        for c in choices:
            out = F.when(F.lower(s) == c.lower(), c).otherwise(out)
        return out
    return s


def boolean(s):
    low = F.lower(s)
    return F.when(low.isin("true", "yes", "1", "on"), True).when(low.isin("false", "no", "0", "off"), False)


def size(s):
    """(width, height) of WxH with positive numbers."""
    w, h = (F.regexp_extract(F.lower(s), r"^([0-9]{1,6})x([0-9]{1,6})$", i).try_cast("int") for i in (1, 2))
    ok = (w > 0) & (h > 0)
    return F.when(ok, w), F.when(ok, h)


def rate(s):
    """(num, den) of n, n/d or a decimal to the thousandth, reduced."""
    num = F.regexp_extract(s, r"^([0-9]{1,9})/([0-9]{1,9})$", 1).try_cast("long")
    den = F.regexp_extract(s, r"^([0-9]{1,9})/([0-9]{1,9})$", 2).try_cast("long")
    dec = F.when(F.regexp_extract(s, r"^([0-9]{1,9}(?:\.[0-9]+)?)$", 1) != "", F.round(s.try_cast("decimal(20,9)") * 1000).cast("long"))
    n, d = F.coalesce(num, dec), F.when(num.isNotNull(), den).when(dec.isNotNull(), 1000)
    return F.when((n > 0) & (d > 0), n), F.when((n > 0) & (d > 0), d)
