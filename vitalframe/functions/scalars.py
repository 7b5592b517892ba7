"""Scalar and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalframe.functions.nulls import clean_num, col_of


def twos_complement(x, bits: int) -> Column:
    """A non-negative code of `bits` bits as a signed number; raises outside its range."""
    c = col_of(x)
    inside = (c >= 0) & (c < (1 << bits))
    return F.when(inside & (c < (1 << (bits - 1))), c).when(inside, c - (1 << bits)).otherwise(F.raise_error(F.lit(f"a code outside {bits} bits")).cast("long"))


def participant_name(x) -> Column:
    """#7 and #007 become hu_07; other ids stay."""
    c = col_of(x)
    number = F.regexp_replace(c, "^#0*", "")
    return F.when(c.startswith("#"), F.concat(F.lit("hu_"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))).otherwise(c)


def numeric_id(x) -> Column:
    return F.ltrim(F.regexp_replace(col_of(x), "^#", "")).try_cast("long")


def is_plain_filename(x) -> Column:
    return ~F.contains(F.regexp_replace(F.regexp_replace(col_of(x), r"\\", "/"), r"^(\./)+", ""), F.lit("/"))


def truthy(x) -> Column:
    return F.lower(F.trim(col_of(x))).isin("1", "true", "t", "yes", "y", "on")


def normalised_name(x) -> Column:
    return F.lower(F.translate(col_of(x), " -", "__"))


def padded_number(x, prefix: str, width: int = 3) -> Column:
    return F.lpad(F.substring(col_of(x), len(prefix) + 1, 18), width, "0")


def feature_name(modality: str, group: str, name: str) -> str:
    """modality_group_name, without repeating a modality that the name already has."""
    return f"{modality}_{group}_{name.removeprefix(modality + '_')}"


def number_ranges(text: str) -> list[int]:
    """'6,7-10' as the numbers it names, ascending."""
    found: set[int] = set()
    for part in text.replace(" ", "").split(","):
        low, _, high = part.partition("-")
        if not low.isdigit() or _ and not high.isdigit() or _ and int(high) < int(low):
            raise ValueError(f"no range: {part}")
        found |= set(range(int(low), int(high or low) + 1))
    return sorted(found)


def bound(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def array_stats(x) -> list[Column]:
    """Mean, population deviation, least and largest of an array's finite members."""
    v = F.filter(F.transform(col_of(x), lambda e: clean_num(e)), lambda e: e.isNotNull())
    n = F.size(v).cast("double")
    mean = F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, e: s + e), n)
    square = bound(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda s, e: s + (e - m) * (e - m)))
    return [mean.alias("mean"), F.sqrt(F.try_divide(square, n)).alias("std"), F.array_min(v).alias("min"), F.array_max(v).alias("max")]


def inverted(x) -> Column:
    return F.transform(col_of(x), lambda e: -e)


def scaled_between(x, low: float = 0.1, high: float = 0.9) -> Column:
    """An array scaled to [low, high]; a flat one becomes low."""
    return F.transform(scaled_array(x), lambda e: F.coalesce(e * (high - low) + low, F.lit(float(low))))


def scaled_array(x) -> Column:
    """An array scaled to [0, 1]; a flat one has no scale and becomes NULLs."""
    c = col_of(x)
    return bound(F.struct(F.array_min(c).alias("low"), F.array_max(c).alias("high")), lambda b: F.transform(c, lambda e: F.try_divide(e - b["low"], b["high"] - b["low"])))


def fitted_length(x, n: int) -> Column:
    """Cropped to n members, or continued with the last one."""
    c = col_of(x)
    return F.when(F.size(c) >= n, F.slice(c, 1, n)).otherwise(F.concat(c, F.array_repeat(F.element_at(c, -1), F.lit(n) - F.size(c))))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, e: s + e)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity_quality(c) -> Column:
    """exp(8 * 50 (c + 1) / 99) / exp(8): the quality of a pulse from its cosine with the next."""
    return F.exp(8.0 * 50.0 * (col_of(c) + 1.0) / 99.0) / F.exp(F.lit(8.0))


def stratum(x, low: float = 101.42, high: float = 157.88) -> Column:
    """low, normal or high by two thresholds."""
    c = col_of(x)
    return F.when(c < low, "low").when(c <= high, "normal").when(c.isNotNull(), "high")


def short_number(x) -> Column:
    c = col_of(x)
    return F.when((c == 0) | (F.abs(c) >= 0.01), F.format_string("%.2f", c)).otherwise(F.format_string("%.2e", c))
