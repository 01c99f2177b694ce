"""Column functions: probabilities, rounding, paths, JSON and text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once (a lambda variable)."""
    return F.transform(F.array(value), f)[0]


def softmax(values: Column) -> Column:
    """Over an array column, shifted by its maximum."""
    shifted = lambda top: F.transform(values, lambda x: F.exp(x.cast("double") - top.cast("double")))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return bound(F.array_max(values), lambda top: bound(shifted(top), lambda e: bound(total(e), lambda s: F.transform(e, lambda x: x / s))))


def rounded(values: Column, digits: int = 2) -> Column:
    return F.transform(values, lambda x: F.round(x, digits))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def json_safe(text: Column) -> Column:
    """A number where the text is one, else the text, as text."""
    number = text.try_cast("double")
    return F.coalesce(number.cast("string"), text)


def minutes_seconds(seconds: Column) -> Column:
    """m:ss of rounded seconds."""
    return F.format_string("%d:%02d", F.rint(F.floor(seconds / 60)).cast("bigint"), F.rint(seconds % 60).cast("bigint"))


def duration_text(seconds: Column) -> Column:
    return F.when(seconds.isNotNull(), F.format_string("%.3fs", seconds)).otherwise("na")


def geometric(low: float, high: float, n: int) -> Column:
    """n values from low to high in equal ratios."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: low * F.pow(F.lit(high / low), k / (n - 1)))


def text_colour(red: Column, green: Column, blue: Column) -> Column:
    return F.when(0.299 * red + 0.587 * green + 0.114 * blue > 0.5, "black").otherwise("white")


def map_get(entries: Column, key: Column | str, default: Column) -> Column:
    """The map's value of a key, a default where it has none (also where the map is null)."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.when(F.coalesce(F.map_contains_key(entries, key), F.lit(False)), entries[key]).otherwise(default)


def map_merge(entries: Column, more: Column) -> Column:
    """Both maps' entries; where both have a key, that of the second. Null maps have none."""
    old = F.map_filter(entries, lambda k, _: ~F.coalesce(F.map_contains_key(more, k), F.lit(False)))
    return F.coalesce(F.map_concat(old, more), entries, more)


NUMBERS = re.compile(r"\[\s*\d+(?:\.\d+)?(?:\s*,\s*\d+(?:\.\d+)?)+\s*\]")


def compact_arrays(text: str) -> str:
    """Arrays of two or more plain non-negative numbers in pretty JSON, each on one line without spaces."""
    return NUMBERS.sub(lambda m: re.sub(r"\s+", "", m[0]), text)
