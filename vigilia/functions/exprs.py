"""Column expressions shared by the operators; none of them leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilia.functions import fixed


def settled(x: Column, places: int = 4) -> Column:
    """Rounded, after the last digits which depend on the order of a sum are gone."""
    return F.round(F.round(x, 10), places)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(mapping: dict[str, str], key: Column, default: str | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def action_category(name: Column | str) -> Column:
    return lookup(fixed.category_map(), col(name), fixed.OTHER_CATEGORY)


def is_sensitive(name: Column | str) -> Column:
    return F.coalesce(col(name).isin(fixed.SENSITIVE_ACTIONS), F.lit(False))


def crud_class(name: Column | str) -> Column:
    """0 for no name, 1 create, 2 read, 3 update, 4 delete, 99 other; by verb prefix, whatever the case."""
    lower = F.lower(col(name))
    out = F.when(col(name).isNull() | (col(name) == ""), fixed.CRUD_UNKNOWN)
    for number, prefixes in fixed.CRUD_PREFIXES.items():
        out = out.when(lower.rlike("^(" + "|".join(prefixes) + ")"), number)
    return out.otherwise(fixed.CRUD_OTHER)


def is_ip(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(fixed.IP_PATTERN), F.lit(False))


def is_instance_id(value: Column | str) -> Column:
    return F.coalesce(col(value).rlike(fixed.INSTANCE_ID_PATTERN), F.lit(False))


def is_meaningful(value: Column | str) -> Column:
    text = F.lower(F.trim(col(value).cast("string")))
    return F.coalesce((text != "") & ~text.isin(fixed.PLACEHOLDERS), F.lit(False))


def empty_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def tail(value: Column | str, separator: str = "/") -> Column:
    return F.substring_index(col(value), separator, -1)


def deviation(x: Column, mean: Column, std: Column) -> Column:
    """How far x lies from the mean, 0 to 1. Two-sided at three standard deviations; without spread only what exceeds the mean counts."""
    spread = F.least(F.abs(x - mean) / std / 3, F.lit(1.0))
    above = F.least((x - mean) / F.greatest(mean, F.lit(1.0)), F.lit(1.0))
    return F.when(std > 0, spread).when(x > mean, above).otherwise(F.lit(0.0))


def bytes_score(b: Column) -> Column:
    full = math.log10(fixed.BYTES_CEILING + 1)
    return F.when(b.isNull() | (b == 0), F.lit(0.0)).otherwise(F.least(F.log10(b + F.lit(1.0)) / full, F.lit(1.0)))


def normalize_score(raw: Column, most: float) -> Column:
    """0 to 100 with two decimals; what lies outside 0 to `most` is clamped."""
    return F.round(F.least(F.greatest(raw, F.lit(0)), F.lit(most)) / most * 100, 2)


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is null, zero or negative."""
    return F.when(b > 0, a / b)


def points(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0)
    for condition, value in rules:
        out = out + F.when(condition, F.lit(value)).otherwise(F.lit(0))
    return out


def reasons(*rules: tuple[Column, Column | str], separator: str = "; ") -> Column:
    """The texts of the rules that hold, in order."""
    return F.concat_ws(separator, *(F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in rules))


def histogram(value: Column | str, count: Column | str) -> Column:
    """An aggregate: (value, count) entries as a map; for groups already counted per value."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(col(value), col(count)))))


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def epoch_us(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, weight in weights.items():
        out = out + F.col(name) * weight
    return out


def mean_of(names: Sequence[str]) -> Column:
    out = F.lit(0.0)
    for name in names:
        out = out + F.col(name)
    return out / len(names)
