"""Scalar helpers: dates, names, rounding, reproducible draws, running ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"


def parse_date(text: Column) -> Column:
    """Strict ``yyyy-MM-dd``; anything else is NULL."""
    return F.when(text.rlike(DATE_PATTERN), F.try_to_date(text, "yyyy-MM-dd"))


def day_number(date: Column) -> Column:
    return F.unix_date(date)


def day_difference(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def pad3(value: Column) -> Column:
    """Three digits at least; longer ids are kept whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0"))


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def clamp(value: Column, lo, hi) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.least(F.greatest(value, lo), hi)


def round_half_even(value: Column) -> Column:
    return F.rint(value)


def softmax(logits: Sequence[Column]) -> list[Column]:
    """Shifted by the maximum so that large logits do not overflow."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    exps = [F.exp(v - top) for v in logits]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


def min_max_scale(value: Column, lo, hi) -> Column:
    """To [-1, 1]; a list of one value maps to 0."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return (F.coalesce(F.try_divide(value - lo, hi - lo), F.lit(0.5)) - 0.5) * 2.0


def denormalise(value: Column, lo, hi) -> Column:
    """Back from [-1, 1]."""
    return ((value / 2.0) + 0.5) * (hi - lo) + lo


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def uniform(seed, name: str, *ids: Column) -> Column:
    """Reproducible draw in [0, 1): depends on the ids only, never on partitions."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    parts = [seed.cast("string"), F.lit(name)] + [i.cast("string") for i in ids]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digest, 16, 10).cast("long").cast("double") / float(1 << 52)


def draw_index(seed, name: str, size, *ids: Column) -> Column:
    """Reproducible integer in [0, size)."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.floor(uniform(seed, name, *ids) * size).cast("long")
