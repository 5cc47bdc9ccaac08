"""Formatting and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_micros(us: Column) -> Column:
    """``H hours, M minutes, S.SS seconds``; hours and minutes of zero are left out."""
    h = F.floor(us / 3_600_000_000).cast("long")
    m = F.floor((us % 3_600_000_000) / 60_000_000).cast("long")
    s = (us % 60_000_000) / 1e6
    return F.concat_ws(", ", F.when(h > 0, F.concat(h.cast("string"), F.lit(" hours"))), F.when(m > 0, F.concat(m.cast("string"), F.lit(" minutes"))), F.concat(F.format_string("%.2f", s), F.lit(" seconds")))


def add_commas(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def strip_quotes(s: Column) -> Column:
    return F.regexp_replace(s, '^"(.*)"$', "$1")


def number(s: Column) -> Column:
    """A number with thousands separators."""
    return F.regexp_replace(s, ",", "").cast("long")


def percent(s: Column) -> Column:
    return F.regexp_replace(s, "%", "").cast("double") / 100


def scaled(x: Column, by: float) -> Column:
    """Whole multiples of ``by``."""
    return F.floor(x / by).cast("int")


def share(x: Column) -> Column:
    """A share as a percentage of two places."""
    return F.format_string("%.2f%%", x * 100)


def millions(x: Column) -> Column:
    return F.concat(F.format_number(F.round(x / 1e6), 0), F.lit("M"))


def in_angles(line: Column) -> Column:
    """What stands from the first ``<`` to the last ``>``; null without both."""
    return F.when(line.rlike("<.*>"), F.regexp_extract(line, "<(.*)>", 1))


# Fixed value: the wording of the logs that are read.
_LOG_LINE = r"(\d+) microseconds.*?(\d+) I/O operations"


def micros_and_io(line: Column) -> tuple[Column, Column]:
    got = lambda i: F.nullif(F.regexp_extract(line, _LOG_LINE, i), F.lit("")).cast("long")
    return got(1), got(2)


def command(line: Column) -> Column:
    """``struct<op, a, b, path>`` of one command line; ``op`` null where it has no such
    form or a number does not fit."""
    p = F.split(F.trim(line), r"\s+")
    op, n = p[0], F.size(p)
    num = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    path = strip_quotes(F.trim(F.regexp_replace(F.trim(line), r"^\S", "")))
    a, b = num(2), num(3)
    fine = (
        (op == "p") & (n == 3) & a.isNotNull() & b.isNotNull() & (b != -2147483648)
        | (op == "r") & (n == 3) & a.isNotNull() & b.isNotNull()
        | op.isin("g", "d") & (n == 2) & a.isNotNull()
        | op.isin("l", "b") & (n >= 2)
        | (op == "s") & ((n == 1) | (n == 2) & (F.coalesce(a, F.lit(0)) > 0))
        | op.isin("i", "q") & (n == 1)
    )
    ok = F.coalesce(fine, F.lit(False))
    return F.struct(F.when(ok, op).alias("op"), F.when(ok & ~op.isin("l", "b"), a).alias("a"), F.when(ok & op.isin("p", "r"), b).alias("b"), F.when(ok & op.isin("l", "b"), path).alias("path"))
