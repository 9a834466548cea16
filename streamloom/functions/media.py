"""Formulas of media as columns: geometry, variable-length integers, relative names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

#: Bytes that a variable-length integer may have here: with eight, a value leaves 64 signed bits when it is marked.
WIDEST = 7


def columns_of(sql: str) -> list[str]:
    """The expressions of a select list: its parts at commas outside of parentheses and quotes."""
    parts, depth, quoted, start = [], 0, False, 0
    for m in re.finditer(r"[(),']", sql):
        c = m[0]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(sql[start : m.start()])
                start = m.end()
    return [p.strip() for p in [*parts, sql[start:]]]


def whole(a, b):
    """Integer quotient of columns that aren't negative, null where b is 0."""
    return F.when(b != 0, (a - a % b) / b).cast("long")


def even(v):
    """The even number at or below v, 0 below 2."""
    return F.when(v < 2, 0).otherwise(v - v % 2)


def divisor(a, b):
    """The greatest common divisor of two columns of non-negative integers below 2**40."""
    step = lambda s, _: F.when(s.b > 0, F.struct(s.b.alias("a"), (s.a % F.when(s.b > 0, s.b)).alias("b"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(a.alias("a"), b.alias("b")), step)["a"]


def _positive(*columns):
    ok = F.lit(True)
    for c in columns:
        ok = ok & (c > 0)
    return ok


def fit(w: str, h: str, tw: str, th: str):
    """(width, height) of a picture inside a box with its aspect kept, the other side rounded to the nearest; 0 for none."""
    w, h, tw, th = map(F.col, (w, h, tw, th))
    ok, wide = _positive(w, h, tw, th), tw * h <= th * w
    fw = F.when(wide, tw).otherwise(whole(w * th + whole(h, F.lit(2)), h))
    fh = F.when(wide, whole(h * tw + whole(w, F.lit(2)), w)).otherwise(th)
    return F.when(ok, even(fw)).otherwise(0), F.when(ok, even(fh)).otherwise(0)


def fill(w: str, h: str, tw: str, th: str):
    """(width, height, x, y) of the middle part of a picture that has the box's aspect."""
    w, h, tw, th = map(F.col, (w, h, tw, th))
    ok, cut = _positive(w, h, tw, th), w * th > h * tw
    cw, ch = F.when(cut, even(whole(h * tw, th))).otherwise(w), F.when(cut, h).otherwise(even(whole(w * th, tw)))
    x, y = F.when(cut, even(whole(w - cw, F.lit(2)))).otherwise(0), F.when(cut, 0).otherwise(even(whole(h - ch, F.lit(2))))
    return tuple(F.when(ok, c) for c in (cw, ch, x, y))


def vint_width(v):
    """Fewest bytes for a size: all ones of a width mean an unknown size, so they are no value. Null beyond WIDEST."""
    width = F.lit(None).cast("int")
    for k in range(WIDEST, 0, -1):
        width = F.when((v >= 0) & (v <= (1 << 7 * k) - 2), k).otherwise(width)
    return width


def _hex(v, width):
    return F.lower(F.lpad(F.hex(v), 2 * width, "0"))


def vint(v, width):
    """A size in so many bytes, as hex: a one behind width - 1 zeros, then the value."""
    return _hex(v + F.pow(F.lit(2.0), 7 * width).cast("long"), width)


def vint_unknown(width):
    return _hex(F.pow(F.lit(2.0), 7 * width + 1).cast("long") - 1, width)


def vint_value(text):
    """(value, width, unknown) of a size in hex, null where its bytes aren't all there."""
    first = F.conv(F.substring(text, 1, 2), 16, 10).cast("int")
    width = F.when(first > 0, 9 - F.length(F.bin(first))).cast("int")
    mark = F.pow(F.lit(2.0), 7 * width).cast("long")
    value = F.conv(F.substring(text, F.lit(1), 2 * width), 16, 10).cast("long") - mark
    there = (width <= WIDEST) & (F.length(text) >= 2 * width)
    return F.when(there, F.struct(value.alias("value"), width.alias("width"), (value == mark - 1).alias("unknown")))


def relative(directory: str, target: str):
    """The target as a file in the directory names it: up to what both begin with, then down."""
    d = F.regexp_replace(directory, "/$", "")
    a = F.when(F.col(directory) == "", F.array().cast("array<string>")).otherwise(F.split(d, "/"))
    b = F.split(target, "/")
    most = F.least(F.size(a), F.size(b) - 1)
    equal = F.zip_with(F.slice(a, 1, most), F.slice(b, 1, most), lambda x, y: x == y)
    off = F.array_position(equal, False)
    same = F.when(off > 0, off - 1).otherwise(most).cast("int")
    return F.concat(F.repeat(F.lit("../"), F.size(a) - same), F.array_join(F.slice(b, same + 1, F.size(b)), "/"))
