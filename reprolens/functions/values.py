"""Column functions over reported values: numbers in text, tolerance comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ABSOLUTE, RELATIVE, TINY = 0.01, 0.05, 1e-9


def number(x: Column) -> Column:
    """A number with thousands separators or a percent sign (a hundredth); null for anything else."""
    bare = F.regexp_replace(F.trim(x), ",", "")
    percent = bare.endswith("%")
    digits = F.trim(F.when(percent, F.regexp_replace(bare, "%+$", "")).otherwise(bare))
    value = F.when(digits.rlike(NUMBER), F.try_cast(digits, "double") if hasattr(F, "try_cast") else digits.try_cast("double"))
    return F.when(percent, value / 100).otherwise(value)


def canonical(x: Column) -> Column:
    """One form for equal values: numbers to six significant digits, else trimmed lower case."""
    n = number(x)
    scale = F.pow(F.lit(10.0), F.lit(5) - F.floor(F.log10(F.abs(n))))
    six = F.when(n == 0, F.lit(0.0)).otherwise(F.round(n * scale) / scale)
    return F.when(n.isNotNull(), six.cast("string")).otherwise(F.lower(F.trim(x)))


def classify_pair(claimed: Column, obtained: Column) -> Column:
    """reproduced if within 0.01, or within 5 % of the claim; texts must be equal."""
    c, o = number(claimed), number(obtained)
    gap = F.abs(c - o)
    base = F.when(F.abs(c) <= TINY, F.lit(1.0)).otherwise(F.abs(c))
    close = F.when(c.isNotNull() & o.isNotNull(), (gap <= ABSOLUTE) | (gap / base <= RELATIVE)).otherwise(F.lower(F.trim(claimed)) == F.lower(F.trim(obtained)))
    return F.when(F.coalesce(close, F.lit(False)), "reproduced").otherwise("mismatch")
