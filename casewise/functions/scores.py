"""Scalar helpers: priorities, confidences in integer thousandths, reasoning, formats.

Confidences are carried as integer thousandths ("milli") and rounded half-up
on the exact rational value.  That keeps every engine (Spark, DuckDB) on the
same bits; the float formulas they stand for are written next to each one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import (DEPARTMENTS, NO_ENTITIES_TEXT, PRIORITIES, PRIORITY_RANK)
from .text import py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def priority_rank(col) -> Column:
    """Low..Critical -> 1..4, anything else -> 0."""
    c = _c(col)
    out = F.lit(0)
    for name, rank in PRIORITY_RANK.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def rank_priority(rank) -> Column:
    r = _c(rank)
    out = F.lit(None).cast("string")
    for name, value in PRIORITY_RANK.items():
        out = F.when(r == value, F.lit(name)).otherwise(out)
    return out


def normalize_priority(col, fallback: str | None = "Medium") -> Column:
    """strip + title-case, fallback when not one of the four priorities."""
    low = F.lower(py_strip(F.coalesce(_c(col), F.lit(""))))
    out = F.lit(fallback) if fallback is not None else F.lit(None).cast("string")
    for p in PRIORITIES:
        out = F.when(low == p.lower(), F.lit(p)).otherwise(out)
    return out


def normalize_department(col, fallback: str = "Customer Service") -> Column:
    """Department enum with default (strip, exact case)."""
    s = py_strip(F.coalesce(_c(col), F.lit("")))
    return F.when(s.isin(DEPARTMENTS), s).otherwise(F.lit(fallback))


def highest_priority(*cols) -> Column:
    """the most urgent of the given (valid) priorities."""
    return rank_priority(F.greatest(*[priority_rank(c) for c in cols]))


def milli_to_double(milli) -> Column:
    return _c(milli).cast("double") / F.lit(1000.0)


def half_up_div(num, den) -> Column:
    """floor(num/den + 1/2) for non-negative integers num, positive den."""
    return F.floor((_c(num) * 2 + _c(den)) / (_c(den) * 2)).cast("long")


def clamp_milli(col, lo: int = 0, hi: int = 1000) -> Column:
    return F.least(F.greatest(_c(col), F.lit(lo)), F.lit(hi))


def fmt_fixed(value_units, decimals: int) -> Column:
    """Format an integer count of 10^-decimals units as 'd.ddd'."""
    v = _c(value_units).cast("long")
    scale = 10 ** decimals
    return F.concat(F.floor(v / scale).cast("long").cast("string"), F.lit("."),
                    F.lpad(F.pmod(v, F.lit(scale)).cast("string"), decimals, "0"))


def milli_fmt2(milli) -> Column:
    """'%.2f' of a thousandths value, half-up."""
    return fmt_fixed(F.floor((_c(milli) + 5) / 10), 2)


def milli_fmt3(milli) -> Column:
    return fmt_fixed(milli, 3)


def reasoning(issue, department, priority, entities, source: str) -> Column:
    """the explanation sentence."""
    ent = F.when(F.size(_c(entities)) > 0, F.array_join(_c(entities), ", ")).otherwise(F.lit(NO_ENTITIES_TEXT))
    return F.concat(F.lit("The complaint signals '"), _c(issue), F.lit("' through entities such as "), ent,
                    F.lit(". This maps to the "), _c(department),
                    F.lit(" department. Priority is "), _c(priority),
                    F.lit(" based on the severity and urgency cues identified by the " + source + " analysis stage."))


def clip_similarity(col) -> Column:
    """clamp to [0, 1] then round to 3 places (NaN -> 0)."""
    x = F.nanvl(_c(col), F.lit(0.0))
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 3)


def clamp_confidence(col) -> Column:
    """F10 / schema clamp: round 3, clamp to [0, 1]; null or NaN -> 0."""
    x = F.coalesce(F.nanvl(_c(col).cast("double"), F.lit(-1.0)), F.lit(-1.0))
    return F.when(x < 0, F.lit(0.0)).otherwise(F.least(F.round(x, 3), F.lit(1.0)))
