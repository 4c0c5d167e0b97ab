"""Column functions on alleles, genotypes and the arrays that follow them.

A call's alleles are its REF and ALT; arrays of length A, R or G hold a value per ALT, per allele, or per genotype (in
VCF order). Missing values are nulls. Merged alleles are what a segment's calls have together.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from locusweave.functions.combine import with_value
from locusweave.session import worker_path

NON_REF = "<NON_REF>"
SPANNING = "*"


def is_symbolic(allele: Column) -> Column:
    """NON_REF, `*`, anything in angle brackets, or a breakend."""
    return (allele == SPANNING) | allele.startswith("<") | allele.contains("[") | allele.contains("]")


def contains_deletion(ref: Column, alt: Column) -> Column:
    """Whether some plain ALT is shorter than a REF of several bases."""
    return (F.length(ref) > 1) & F.exists(alt, lambda a: ~is_symbolic(a) & (F.length(a) < F.length(ref)))


def is_deletion(ref: Column, allele: Column) -> Column:
    """A single allele: shorter than REF, or `*`, where REF has several bases."""
    return (F.length(ref) > 1) & ((allele == SPANNING) | (~is_symbolic(allele) & (F.length(allele) < F.length(ref))))


def is_reference_block(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (alt == F.array(F.lit(NON_REF)))


def normalise(ref: Column, alt: Column) -> tuple[Column, Column]:
    """REF and one ALT without the suffix they share; a symbolic ALT keeps REF's first base."""
    m, n = F.length(ref), F.length(alt)
    cut = F.when(n >= m, m - 1).otherwise(F.when(n > 1, n - 1).otherwise(0))
    keep = lambda x, k: F.substring(x, F.lit(1), F.length(x) - k)
    symbolic = is_symbolic(alt)
    return F.when(symbolic, F.substring(ref, 1, 1)).otherwise(keep(ref, cut)), F.when(symbolic, alt).otherwise(keep(alt, cut))


def genotype_count(alleles: int, ploidy: int) -> int:
    """Genotypes of so many alleles (REF included)."""
    return comb(alleles + ploidy - 1, ploidy)


def diploid_index(j: Column, k: Column) -> Column:
    """Place of genotype j/k among the diploid genotypes."""
    low, high = F.least(j, k), F.greatest(j, k)
    return F.shiftright(high * (high + 1), 1).cast("int") + low


def genotype_index(gt: Column) -> Column:
    """Place of a genotype of any ploidy: over its alleles in ascending order, the sum of C(i + a, i + 1), i from 0."""
    ordered = F.array_sort(gt)

    def choose(i: Column, a: Column) -> Column:
        steps = F.sequence(F.lit(0), i)  # C(a + i, i + 1) as a product of i + 1 exact quotients
        return F.when(a == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(1).cast("long"), lambda p, s: (p * (a + s) / (s + 1)).cast("long")))

    return F.aggregate(F.transform(ordered, lambda a, i: choose(i, a)), F.lit(0).cast("long"), lambda s, x: s + x)


def genotypes(alleles: int, ploidy: int) -> list[tuple[int, ...]]:
    """All genotypes in VCF order, each in ascending order of alleles."""
    if ploidy == 0:
        return [()]
    return [(*rest, a) for a in range(alleles) for rest in genotypes(a + 1, ploidy - 1)]


# ------------------------------------------------------------------ merged alleles


def merged_alt(mine: Column) -> Column:
    """ALT alleles of all calls (mine: their ALT in terms of the merged REF), first seen first; NON_REF comes last if any
    call has it."""
    plain = lambda v: F.array_remove(v, NON_REF)
    last = lambda v: F.when(F.array_contains(v, NON_REF), F.concat(plain(v), F.array(F.lit(NON_REF)))).otherwise(plain(v))
    return with_value(F.array_distinct(F.flatten(mine)), last)


def in_terms_of(merged_ref: Column, ref: Column, alt: Column) -> Column:
    """A call's ALT alleles written against the merged REF: each lengthened by the rest of it unless symbolic."""
    tail = F.substring(merged_ref, F.length(ref) + 1, F.length(merged_ref))
    as_is = (alt == F.array(F.lit(NON_REF))) | (F.length(ref) == F.length(merged_ref))
    return F.when(as_is, alt).otherwise(F.transform(alt, lambda a: F.when(is_symbolic(a), a).otherwise(F.concat(a, tail))))


def sources(merged: Column, mine: Column) -> Column:
    """For each merged allele (REF first) the place of it in a call's alleles; NON_REF's place where it isn't there, and
    null if that isn't either. mine: the call's ALT in terms of the merged REF."""
    non_ref = F.nullif(F.array_position(mine, F.lit(NON_REF)), F.lit(0).cast("long"))
    place = lambda a: F.coalesce(F.nullif(F.array_position(mine, a), F.lit(0).cast("long")), non_ref).cast("int")
    searched = F.concat(F.array(F.lit(0)), F.transform(merged, place))
    # most calls have all merged alleles or, as reference blocks, NON_REF alone
    return F.when(mine == merged, F.sequence(F.lit(0), F.size(merged))).when(mine == F.array(F.lit(NON_REF)), _block_source(F.size(merged))).otherwise(searched)


def _block_source(n: Column) -> Column:
    return F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), n))


def remap_alleles(values: Column, source: Column, alt_only: bool = False) -> Column:
    """Array of length R (or A) re-indexed to the merged alleles; null where there is no value."""
    if alt_only:
        return F.when(values.isNotNull(), F.transform(F.slice(source, 2, F.size(source)), lambda s: F.get(values, s - 1)))
    return F.when(values.isNotNull(), F.transform(source, lambda s: F.get(values, s)))


def remap_2d(values: Column, source: Column, alt_only: bool = False) -> Column:
    """Array of arrays re-indexed on its outer side; missing ones are empty."""
    return F.transform(remap_alleles(values, source, alt_only), lambda v: F.coalesce(v, F.slice(F.element_at(values, 1), 1, 0)))


def remap_diploid(values: Column, source: Column) -> Column:
    """Array over diploid genotypes re-indexed to the merged alleles."""
    pairs = F.flatten(F.transform(source, lambda high, k: F.transform(F.slice(source, F.lit(1), k + 1), lambda low: F.get(values, diploid_index(low, high)))))
    last = F.size(source) - 1
    same = (source == F.sequence(F.lit(0), last)) & (F.size(values) == F.shiftright((last + 1) * (last + 2), 1))
    block = F.flatten(F.transform(source, lambda _, k: F.when(k == 0, F.array(F.get(values, F.lit(0)))).otherwise(F.concat(F.array(F.get(values, F.lit(1))), F.array_repeat(F.get(values, F.lit(2)), k)))))
    return F.when(values.isNotNull(), F.when(same, values).when(source == _block_source(last), block).otherwise(pairs))


def remap_diploid_short(values: Column, source: Column) -> Column:
    """remap_diploid() for a source of two or three alleles, as spanning deletions have: place by place, without a lambda, and
    each written once, as a generated method of over 8,000 bytes is never compiled."""
    at = lambda j, k: F.get(values, diploid_index(F.get(source, F.lit(j)), F.get(source, F.lit(k))))
    places = F.array(at(0, 0), at(0, 1), at(1, 1), at(0, 2), at(1, 2), at(2, 2))
    return F.when(values.isNotNull(), F.slice(places, F.lit(1), F.when(F.size(source) > 2, 6).otherwise(3)))


def remap_haploid(values: Column, source: Column) -> Column:
    return remap_alleles(values, source)


@lru_cache(maxsize=4096)
def _places(source: tuple, ploidy: int) -> list[int]:
    """For every genotype of the merged alleles its place among a call's own, -1 where it has none."""
    place = lambda g: sum(comb(i + a, i + 1) for i, a in enumerate(sorted(g)))
    old = ([source[a] for a in g] for g in genotypes(len(source), ploidy))
    return [-1 if None in o else place(o) for o in old]


def _remap_general(values: pd.Series, source: pd.Series, ploidy: pd.Series) -> pd.Series:
    known = lambda x: x is not None and x == x

    def one(v, s, p):
        if v is None or not known(p) or p < 1:
            return None
        have = [int(x) if known(x) else None for x in v]
        return [have[at] if 0 <= at < len(have) else None for at in _places(tuple(int(x) if known(x) else None for x in s), int(p))]

    return pd.Series([one(*x) for x in zip(values, source, ploidy, strict=True)])


def remap_genotypes(values: Column, source: Column, ploidy: Column) -> Column:
    """Array of length G re-indexed for any ploidy: native for one and two, an Arrow function beyond; null without ploidy."""
    worker_path(SparkSession.getActiveSession())
    general = F.pandas_udf(_remap_general, "array<int>")
    return (
        F.when(ploidy == 2, remap_diploid(values, source))
        .when(ploidy == 1, remap_haploid(values, source))
        .otherwise(general(F.when(ploidy > 2, values), source, ploidy))
    )


def remap_gt(gt: Column, merged: Column, mine: Column) -> Column:
    """Genotype alleles as merged alleles; what has no place becomes NON_REF's, or -1 without it. Missing stays (-1)."""
    non_ref = F.coalesce(F.nullif(F.array_position(merged, F.lit(NON_REF)), F.lit(0).cast("long")), F.lit(-1).cast("long"))

    def place(a: Column) -> Column:
        found = F.nullif(F.array_position(merged, F.get(mine, a - 1)), F.lit(0).cast("long"))
        return F.when(a <= 0, a.cast("long")).otherwise(F.coalesce(found, non_ref)).cast("int")

    same = F.forall(gt, lambda a: a <= 0) | ((mine == merged) & F.forall(gt, lambda a: a <= F.size(merged)))
    return F.when(same, gt.cast("array<int>")).otherwise(F.transform(gt, place))


def least_genotype(pl: Column, alleles: Column) -> Column:
    """The diploid genotype of the least PL; among equals the one with the smaller first, then second allele."""
    def few(n: int) -> Column:  # the genotypes of so few alleles, written out
        pairs = [(j, k) for j in range(n) for k in range(j, n)]
        return with_value(
            F.array(*[F.get(pl, F.lit(k * (k + 1) // 2 + j)) for j, k in pairs]),
            lambda v: F.get(F.array(*[F.array(F.lit(j), F.lit(k)) for j, k in pairs]), (F.nullif(F.array_position(v, F.array_min(v)), F.lit(0).cast("long")) - 1).cast("int")),
        )

    pairs = F.flatten(F.transform(F.sequence(F.lit(0), alleles - 1), lambda j: F.transform(F.sequence(j, alleles - 1), lambda k: F.struct(F.get(pl, diploid_index(j, k)).alias("pl"), j.alias("j"), k.alias("k")))))
    best = F.array_min(F.filter(pairs, lambda p: p["pl"].isNotNull()))
    return F.when(alleles == 3, few(3)).when(alleles == 2, few(2)).when(best.isNotNull(), F.array(best["j"], best["k"]))
