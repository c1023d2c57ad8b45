"""Expression helpers: what Spark's own operators do differently from the typed SQLite dialect."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REAL = r"^[\x20\t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_INT = r"^[\x20\t\n\x0B\f\r]*([+-]?[0-9]+)"
INT_MAX, INT_MIN = 2**63 - 1, -(2**63)


def lower(x: Column) -> Column:
    """ASCII letters only."""
    return F.translate(x, _UP, _LOW)


def upper(x: Column) -> Column:
    return F.translate(x, _LOW, _UP)


def nocase(x: Column) -> Column:
    """Fold key of the NOCASE collation: compare, group and order by it."""
    return lower(x)


def like(x: Column, pattern: str | Column) -> Column:
    """``LIKE`` without escape character, blind to ASCII case, for ``%`` and ``_``."""
    if isinstance(pattern, str):
        escape = next(c for c in "\x01\x02\x03~" if c not in pattern)
        return F.like(lower(x), F.lit(pattern.translate(str.maketrans(_UP, _LOW))), F.lit(escape))
    return F.like(lower(x), lower(pattern), F.lit("\x01"))


def _checked(exact: Column, real: Column, overflow: str, *operands: Column) -> Column:
    """The exact result where there is one; beyond 64 bits an error, a REAL column, a VARIANT that holds either, or the REAL cast back to INTEGER."""
    if overflow == "raise":
        given = reduce(lambda x, y: x & y, [o.isNotNull() for o in operands])
        return F.when(given, F.coalesce(exact, F.raise_error(F.lit("integer overflow")).cast("bigint")))
    exact = F.when(F.abs(real) < 9.3e18, exact)  # what is surely beyond 64 bits isn't tried: each try that fails makes an exception
    if overflow == "real":
        return F.coalesce(exact.cast("double"), real)
    if overflow == "variant":
        return F.coalesce(exact.cast("variant"), real.cast("variant"))
    if overflow == "integer":
        return F.coalesce(exact, real_to_integer(real))
    raise ValueError(overflow)


def add(a: Column, b: Column, overflow: str = "raise") -> Column:
    """``+``: INTEGER stays INTEGER and exact.

    The dialect turns a sum beyond 64 bits into REAL row by row. A column has one
    type, so the caller declares the need: ``raise``, ``real`` (all rows), ``variant``,
    which holds an exact INTEGER or a REAL in each row, or ``integer``, which is
    ``CAST(a + b AS INTEGER)``: exact, and saturated where the dialect went over to REAL.
    """
    return _checked(F.try_add(a, b), a.cast("double") + b.cast("double"), overflow, a, b)


def subtract(a: Column, b: Column, overflow: str = "raise") -> Column:
    return _checked(F.try_subtract(a, b), a.cast("double") - b.cast("double"), overflow, a, b)


def multiply(a: Column, b: Column, overflow: str = "raise") -> Column:
    return _checked(F.try_multiply(a, b), a.cast("double") * b.cast("double"), overflow, a, b)


def negate(a: Column, overflow: str = "raise") -> Column:
    return _checked(F.try_subtract(F.lit(0).cast("bigint"), a), -a.cast("double"), overflow, a)


def no_nan(x: Column) -> Column:
    """A REAL result: NaN is NULL."""
    return F.when(~F.isnan(x), x)


def int_divide(a: Column, b: Column) -> Column:
    """Truncating division; NULL by zero."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def divide(a: Column, b: Column) -> Column:
    """Real division; NULL by zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder of truncated operands with the sign of the first; NULL by zero."""
    return a.cast("bigint") % F.nullif(b.cast("bigint"), F.lit(0).cast("bigint"))


def real_mod(a: Column, b: Column) -> Column:
    """``%`` with a REAL operand: the remainder of the truncated operands, as REAL."""
    return int_mod(real_to_integer(a.cast("double")), real_to_integer(b.cast("double"))).cast("double")


def substr(x: Column, start: int | Column, length: int | Column | None = None) -> Column:
    """1-based; a negative start counts from the end, start 0 uses up one of the length, a negative length takes what precedes."""
    n = F.char_length(x)
    start = F.lit(start) if isinstance(start, int) else start
    first = F.when(start < 0, n + start).when(start > 0, start - 1).otherwise(F.lit(-1))
    if length is None:
        begin, end = F.greatest(first, F.lit(0)), n
    else:
        length = F.lit(length) if isinstance(length, int) else length
        begin = F.greatest(F.lit(0), F.when(length < 0, first + length).otherwise(first))
        end = F.least(n, F.when(length < 0, first).otherwise(first + length))
    return F.when(x.isNotNull() & start.isNotNull(), F.substring(x, (begin + 1).cast("int"), F.greatest(F.lit(0), end - begin).cast("int")))


def instr(x: Column, needle: str | Column) -> Column:
    """1-based position, 0 if absent, and 0 for an empty needle."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.when(needle == "", F.when(x.isNotNull(), F.lit(0))).otherwise(F.call_function("instr", x, needle)).cast("bigint")


def numeric_prefix(x: Column) -> Column:
    """The number that a text starts with, as a double; 0 without one."""
    return F.when(x.isNotNull(), F.coalesce(_number(x), F.lit(0.0)))


def _number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, _REAL, 1), F.lit("")).try_cast("double")


def is_numeric(x: Column) -> Column:
    """Whether a text as a whole is a well-formed number: then a numeric side of a comparison converts it."""
    return F.trim(x).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def cast_integer(x: Column) -> Column:
    """``CAST(text AS INTEGER)``: prefix, truncated, saturating."""
    digits = F.nullif(F.regexp_extract(x, _INT, 1), F.lit(""))
    end = F.when(digits.startswith("-"), F.lit(INT_MIN)).otherwise(F.lit(INT_MAX))
    return F.when(x.isNotNull(), F.when(digits.isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(digits.try_cast("bigint"), end)))


def real_to_integer(x: Column) -> Column:
    """``CAST(real AS INTEGER)``: truncated, saturating."""
    return F.when(x >= 2.0**63, F.lit(INT_MAX)).when(x < -(2.0**63), F.lit(INT_MIN)).otherwise(x.try_cast("bigint"))


def cast_real(x: Column) -> Column:
    """``CAST(text AS REAL)``."""
    return numeric_prefix(x)


def truth(x: Column, kind: str) -> Column:
    """Truth of a value by its declared kind: numbers other than 0, text by its numeric prefix, blobs never."""
    if kind == "text":
        return cast_real(x) != 0
    if kind == "blob":
        return F.when(x.isNotNull(), F.lit(False))
    return x != 0


def as_integer(condition: Column) -> Column:
    """A condition as 1, 0 or NULL, as it shows in a projection."""
    return condition.cast("int").cast("bigint")


def int_real_equal(i: Column, r: Column) -> Column:
    """Exact, also beyond 2**53."""
    return (i.cast("double") == r) & (i == real_to_integer(r))


def int_real_less(i: Column, r: Column) -> Column:
    d = i.cast("double")
    return (d < r) | ((d == r) & (i.cast("decimal(38,0)") < r.try_cast("decimal(38,0)")))


def _sign(less: Column, equal: Column) -> Column:
    return F.when(equal, 0).when(less, -1).when(~less, 1)


RANK = {"integer": 1, "real": 1, "text": 2, "blob": 3}


@dataclass(frozen=True)
class Typed:
    """A value with its storage class (integer, real, text or blob), whether it is a column, whose declared type converts the other side, and its collation: a column's own, or by an explicit COLLATE."""

    value: Column
    kind: str
    column: bool = False
    nocase: bool = False
    collate: str | None = None


def collation(a: Typed, b: Typed) -> str:
    """An explicit COLLATE, the left one first; else the left column's, else the right column's, else BINARY."""
    own = lambda t: ("nocase" if t.nocase else "binary") if t.column else None
    return a.collate or b.collate or own(a) or own(b) or "binary"


def _class_order(a: Typed, b: Typed) -> Column:
    """-1, 0, 1 or NULL in the dialect's order: numbers, then texts, then blobs; integers and reals exactly."""
    x, y = a.value, b.value
    if RANK[a.kind] != RANK[b.kind]:
        return F.when(x.isNotNull() & y.isNotNull(), F.lit(-1 if RANK[a.kind] < RANK[b.kind] else 1))
    if (a.kind, b.kind) == ("integer", "real"):
        return _sign(int_real_less(x, y), int_real_equal(x, y))
    if (a.kind, b.kind) == ("real", "integer"):
        return -_class_order(b, a)
    if a.kind == "text" and collation(a, b) == "nocase":
        x, y = nocase(x), nocase(y)
    return _sign(x < y, x == y)


def order(a: Typed, b: Typed) -> Column:
    """How ``a`` compares to ``b``, after comparison affinity by their declared types.

    A numeric column converts a text on the other side that is a whole number as written;
    other texts stay texts and are larger than numbers. A text column turns a bare
    number into text. Collation: that of the left column, else of the right one.
    """
    numbers = ("integer", "real")
    if a.kind in numbers and a.column and b.kind == "text":
        whole = F.trim(b.value).rlike(r"^[+-]?[0-9]+$") & F.trim(b.value).try_cast("bigint").isNotNull()
        as_int, as_real = replace(b, value=F.trim(b.value).try_cast("bigint"), kind="integer"), replace(b, value=F.trim(b.value).try_cast("double"), kind="real")
        return F.when(whole, _class_order(a, as_int)).when(is_numeric(b.value), _class_order(a, as_real)).otherwise(_class_order(a, b))
    if b.kind in numbers and b.column and a.kind == "text":
        return -order(b, a)
    if a.kind == "text" and a.column and b.kind in numbers and not b.column:
        return _class_order(a, replace(b, value=cast_text(b.value, b.kind), kind="text"))
    if b.kind == "text" and b.column and a.kind in numbers and not a.column:
        return -order(b, a)
    return _class_order(a, b)


def compare(a: Typed, op: str, b: Typed) -> Column:
    """``a op b`` for ``= <> < <= > >=``; NULL if either is."""
    o = order(a, b)
    return {"=": o == 0, "<>": o != 0, "<": o < 0, "<=": o <= 0, ">": o > 0, ">=": o >= 0}[op]


def is_in(x: Column, values: list) -> Column:
    """``IN`` of a list; an empty one is false even for NULL."""
    return x.isin(values) if values else F.lit(False)


@F.pandas_udf(StringType())
def real_to_text(x: pd.Series) -> pd.Series:
    """REAL as text: 15 significant digits, always with a point or exponent."""

    def show(v):
        if v is None or v != v:
            return None
        if v in (float("inf"), float("-inf")):
            return "Inf" if v > 0 else "-Inf"
        s = f"{v:.15g}"
        if "e" in s:
            head, tail = s.split("e")
            return f"{head if '.' in head else head + '.0'}e{tail}"
        return s if "." in s else s + ".0"

    return x.map(show)


def cast_text(x: Column, kind: str) -> Column:
    """``CAST(x AS TEXT)``: a REAL with 15 significant digits, a blob read as UTF-8."""
    return real_to_text(x.cast("double")) if kind == "real" else x.cast("string")


def cast_blob(x: Column, kind: str) -> Column:
    """``CAST(x AS BLOB)``: the bytes of the text of a number."""
    return x if kind == "blob" else cast_text(x, kind).cast("binary")


def datetime_now(clock: datetime | Column | None = None) -> Column:
    """``datetime('now')``: UTC as ``YYYY-MM-DD HH:MM:SS``; ``clock`` is an injected time, else the query's own."""
    if isinstance(clock, datetime):
        utc = clock.astimezone(timezone.utc) if clock.tzinfo else clock
        return F.lit(utc.strftime("%Y-%m-%d %H:%M:%S"))
    now = F.current_timestamp() if clock is None else clock
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), now.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def concat(*parts: Column) -> Column:
    """``||`` of texts and integers; NULL if any is. Show reals by ``real_to_text`` first."""
    return F.concat(*[p.cast("string") for p in parts])
