"""Convolution kernels by name or as a list of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.constants import KERNELS, MAX_KERNEL


def kernel(spec: str | list[float]) -> list[float] | None:
    """A named kernel or a square odd list of at most 25 numbers; anything else is ignored (None)."""
    if isinstance(spec, str):
        return [float(v) for v in KERNELS[spec.lower()]] if spec.lower() in KERNELS else None
    side = math.isqrt(len(spec))
    if len(spec) > MAX_KERNEL or side * side != len(spec) or side % 2 == 0:
        return None
    return [float(v) for v in spec]


def kernel_column(spec: Column) -> Column:
    """The same rule on a text column: kernel name or comma separated numbers, brackets allowed."""
    text = F.lower(F.regexp_extract(spec, r"^\[?([^\]]*)", 1))
    named = F.create_map(*[F.lit(x) for k, v in KERNELS.items() for x in (k, ",".join(str(n) for n in v))])
    parts = F.filter(F.split(F.coalesce(F.try_element_at(named, text), text), ","), lambda t: t != "")
    numbers = F.transform(parts, leading_number)
    side = F.floor(F.sqrt(F.size(numbers))).cast("int")
    good = (F.size(numbers) <= MAX_KERNEL) & (side * side == F.size(numbers)) & (side % 2 == 1)
    return F.when(good, numbers)


def leading_number(text: Column) -> Column:
    """The numeric prefix of a text as DOUBLE, or 0."""
    return F.coalesce(matched_number(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"), F.lit(0.0))


def matched_number(text: Column, pattern: str) -> Column:
    """The first group of an anchored pattern as DOUBLE; null, not the slow failed cast of an empty text, without a match."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(0)).try_cast("double")


def leading_integer(text: Column) -> Column:
    """The integer prefix of a text as INT, or 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
