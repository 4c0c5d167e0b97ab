"""Ways to combine a field over the calls of a segment.

Each takes an array with one value per call, in row order, nulls where a call has none, and gives one value. More
can be registered by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _valid(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def _total(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda s, v: s + v.cast(kind))


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f uses it: functions on arrays aren't seen as common parts."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def combine_sum(values: Column, kind: str = "double") -> Column:
    """Sum; null if no call has a value."""
    add = lambda s, v: F.when(v.isNull(), s).otherwise(F.coalesce(s, F.lit(0).cast(kind)) + v.cast(kind))
    return F.aggregate(values, F.lit(None).cast(kind), add)


def combine_mean(values: Column, kind: str = "double") -> Column:
    """Mean in the field's type: whole numbers divide without remainder (of sums that aren't negative)."""
    mean = lambda v: _total(v, kind) / F.size(v)
    whole = (lambda v: F.floor(mean(v)).cast(kind)) if kind in ("int", "long") else mean
    return with_value(_valid(values), lambda v: F.when(F.size(v) > 0, whole(v)))


def combine_median(values: Column, kind: str = "double") -> Column:
    """The upper median: of n sorted values that at n div 2, counted from 0."""
    return with_value(F.sort_array(_valid(values)), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")).cast(kind))


def combine_element_wise_sum(values: Column, kind: str = "double") -> Column:
    """Sums by place over arrays; null where no array has a value; as long as the last place that has one."""
    both = lambda s, v: F.when(v.isNull(), s).when(s.isNull(), v.cast(kind)).otherwise(s + v.cast(kind))
    add = lambda sums, a: F.when(a.isNull(), sums).otherwise(F.zip_with(sums, a, both))
    last = lambda sums: F.coalesce(F.array_max(F.transform(sums, lambda s, i: F.when(s.isNotNull(), i + 1))), F.lit(0))
    cut = lambda sums: F.when(F.get(sums, F.size(sums) - 1).isNotNull(), sums).when(last(sums) > 0, F.slice(sums, F.lit(1), last(sums)))
    return F.aggregate(values, F.array().cast(f"array<{kind}>"), add, cut)


def combine_element_wise_sum_2d(values: Column, kind: str = "double") -> Column:
    """The same over arrays of arrays, row by row."""
    longest = lambda v: F.array_max(F.transform(v, lambda a: F.size(a)))
    rows = lambda v: F.transform(F.sequence(F.lit(0), longest(v) - 1), lambda i: combine_element_wise_sum(F.transform(v, lambda a: F.get(a, i)), kind))
    return with_value(_valid(values), lambda v: F.when(longest(v) > 0, rows(v)))


def combine_concatenate(values: Column, kind: str = "double") -> Column:
    """All arrays one after the other, missing elements kept."""
    return with_value(_valid(values), lambda v: F.when(F.size(v) > 0, F.flatten(v)))


def combine_histogram_sum(values: Column, kind: str = "long") -> Column:
    """values: arrays (one per allele) of arrays of struct(bin, n). Per allele the sum of n by bin, bins ascending."""
    longest = lambda v: F.array_max(F.transform(v, lambda a: F.size(a)))

    def summed(pairs: Column) -> Column:
        bins = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["bin"])))
        of = lambda b: F.aggregate(pairs, F.lit(0).cast(kind), lambda s, p: F.when(p["bin"] == b, s + p["n"].cast(kind)).otherwise(s))
        return F.transform(bins, lambda b: F.struct(b.alias("bin"), of(b).alias("n")))

    one = lambda v, i: with_value(F.flatten(_valid(F.transform(v, lambda a: F.get(a, i)))), summed)
    return with_value(_valid(values), lambda v: F.when(longest(v) > 0, F.transform(F.sequence(F.lit(0), longest(v) - 1), lambda i: one(v, i))))


def combine_union(values: Column, kind: str = "string") -> Column:
    """Distinct elements of all arrays, sorted."""
    return with_value(_valid(values), lambda v: F.when(F.size(v) > 0, F.array_sort(F.array_distinct(F.flatten(v)))))


def merge_ids(values: Column, kind: str = "string") -> Column:
    """Distinct `;`-separated ids, sorted and joined again."""
    return with_value(_valid(values), lambda v: F.when(F.size(v) > 0, F.array_join(F.sort_array(F.array_distinct(F.flatten(F.transform(v, lambda x: F.split(x, ";"))))), ";")))


COMBINE: dict[str, Callable[..., Column]] = {
    "sum": combine_sum, "mean": combine_mean, "median": combine_median, "element_wise_sum": combine_element_wise_sum,
    "element_wise_sum_2d": combine_element_wise_sum_2d, "concatenate": combine_concatenate, "histogram_sum": combine_histogram_sum, "union": combine_union, "ids": merge_ids,
}


def register_combine_op(name: str, fn: Callable[..., Column]) -> None:
    """Make a combine operation available by name: fn(values, kind) -> Column."""
    COMBINE[name] = fn


def histogram_text(histogram: Column) -> Column:
    """`bin,n,bin,n` per allele, joined by `|`; bins with three significant decimals at most."""
    one = lambda h: F.array_join(F.transform(h, lambda p: F.concat_ws(",", F.regexp_replace(F.format_string("%.3f", p["bin"].cast("double")), r"\.?0+$", ""), p["n"].cast("string"))), ",")
    return F.array_join(F.transform(histogram, one), "|")
