"""Combined records: the calls of every segment merged into one record.

Spanning deletions are rewritten call by call. Then a segment's calls are gathered into one array, sorted by row_idx, and
everything after that is column functions on it: REF and ALT merged, allele- and genotype-shaped fields re-indexed, fields
combined. The gathered array grows with the number of samples only.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusweave.functions import alleles as A
from locusweave.functions.combine import COMBINE, with_value
from locusweave.operators.intervals import gathered, truncate


MOVED = "move_to_FORMAT"


@dataclass(frozen=True)
class Spec:
    """What to merge: fields by their shape, and how INFO fields are combined."""

    #: Per-allele (R), per-ALT (A) and per-genotype (G) fields of calls, and two-dimensional per-allele ones.
    per_allele: tuple[str, ...] = ("ad",)
    per_alt: tuple[str, ...] = ()
    per_genotype: tuple[str, ...] = ("pl",)
    per_allele_2d: tuple[str, ...] = ()
    #: INFO field -> (operation, type). What has the operation MOVED is not combined: every call keeps its own value, as a
    #: FORMAT field.
    info: dict[str, tuple[str, str]] = field(default_factory=lambda: {"rank_sum": ("median", "double")})
    #: FORMAT fields that are passed on as they are.
    format: tuple[str, ...] = ("gq", "sb")
    #: Whether spanning deletions get the genotype of least PL.
    min_pl_genotype: bool = False
    sites_only: bool = False
    #: Whether calls may have a ploidy above two; their genotype fields then pass through an Arrow function.
    general_ploidy: bool = False
    max_alt: int = 50


def merged_ref(s: Column, calls: Column) -> Column:
    """The longest REF of the calls that begin at s; `N` if none does."""
    here = F.filter(calls, lambda c: c["col_begin"] == s)
    longer = lambda r, c: F.when(F.length(c["ref"]) > F.length(r), c["ref"]).otherwise(r)
    return F.aggregate(here, F.lit(""), longer, lambda r: F.when(r == "", F.lit("N")).otherwise(r))


def spanning_source(ref: Column, alt: Column, pl: Column | None, ploidy: Column | None = None) -> Column:
    """Places of the alleles that a deletion keeps at later positions: REF, the deletion with the least homozygous PL
    (the first, without PL), and NON_REF where the call has it."""
    places = F.sequence(F.lit(1), F.size(alt))
    dels = F.filter(places, lambda i: A.is_deletion(ref, F.element_at(alt, i)))
    if pl is not None:
        homozygous = (lambda i: A.diploid_index(i, i)) if ploidy is None else (lambda i: A.genotype_index(F.array_repeat(i, ploidy)).cast("int"))
        score = F.array_min(F.transform(dels, lambda i: F.struct(F.coalesce(F.get(pl, homozygous(i)), F.lit(2**31 - 1)).alias("pl"), i.alias("i"))))["i"]
    else:
        score = F.element_at(dels, 1)
    non_ref = F.array_position(alt, F.lit(A.NON_REF)).cast("int")
    return F.when(non_ref > 0, F.array(F.lit(0), score, non_ref)).otherwise(F.array(F.lit(0), score))


def pieces(calls: DataFrame, spec: Spec) -> DataFrame:
    """Calls and, by _b and _e, where they are active as they are: a deletion is itself at its first position (_span false)
    and a call of its own at later ones (_span true). That one has REF `N`, ALT `*` (and NON_REF), fields and GT re-indexed
    to that, and no INFO fields other than dp. So a call is rewritten once, not at every position."""
    first, last = F.col("col_begin"), F.col("eff_end")
    part = lambda b, e, on: F.struct(b.alias("_b"), e.alias("_e"), F.lit(on).alias("_span"))
    parts = F.when(F.col("_dense") & (last > first), F.array(part(first, first, False), part(first + 1, last, True))).otherwise(F.array(part(first, last, False)))
    each = truncate(calls).withColumn("_dense", A.contains_deletion(F.col("ref"), F.col("alt"))).select("*", F.inline(parts))
    pl = F.col("pl") if "pl" in each.columns else None
    ploidy = F.size("gt") if spec.general_ploidy else None
    source = spanning_source(F.col("ref"), F.col("alt"), pl, ploidy)
    out = each.withColumn("_source", F.when(F.col("_span"), source))
    src, on = F.col("_source"), F.col("_span")
    new = {"ref": F.when(on, F.lit("N")).otherwise(F.col("ref"))}
    short = F.when(F.array_contains("alt", A.NON_REF), F.array(F.lit(A.SPANNING), F.lit(A.NON_REF))).otherwise(F.array(F.lit(A.SPANNING)))
    new["alt"] = F.when(on, short).otherwise(F.col("alt"))
    for n in spec.per_allele:
        new[n] = F.when(on, A.remap_alleles(F.col(n), src)).otherwise(F.col(n))
    for n in spec.per_alt:
        new[n] = F.when(on, A.remap_alleles(F.col(n), src, True)).otherwise(F.col(n))
    for n in spec.per_allele_2d:
        new[n] = F.when(on, A.remap_2d(F.col(n), src)).otherwise(F.col(n))
    for n in spec.per_genotype:
        again = A.remap_genotypes(F.when(on, F.col(n)), src, ploidy) if spec.general_ploidy else A.remap_diploid_short(F.col(n), src)
        new[n] = F.when(on, again).otherwise(F.col(n))
    for n, (op, _) in spec.info.items():
        if n != "dp" and op != MOVED:
            new[n] = F.when(~on, F.col(n))
    gt = F.transform("gt", lambda a: F.when(a <= 0, a).otherwise(F.coalesce(F.nullif(F.array_position(src, a), F.lit(0).cast("long")) - 1, F.size(src).cast("long") - 1)).cast("int"))
    gt = F.when(on, gt).otherwise(F.col("gt"))
    new["gt"] = gt
    out = out.withColumns(new)
    if spec.min_pl_genotype:  # of the PL just reduced
        out = out.withColumn("gt", F.when(on, F.coalesce(A.least_genotype(F.col("pl"), F.size("alt") + 1), F.col("gt"))).otherwise(F.col("gt")))
    return out.drop("_source")


def segment_calls(calls: DataFrame, spec: Spec, fields: Iterable[str] | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """contig, s, t, calls: every segment and its calls as they are there, but for REF (ref_at); of their fields these and
    what merging takes (all of them without)."""
    if fields is not None:
        fields = ["col_begin", "ref", "alt", *fields]
    return gathered(pieces(calls, spec), fields, begin, end)


def ref_at(s: Column, call: Column) -> Column:
    """A call's REF at s: `N` if it begins before."""
    return F.when(call["col_begin"] < s, F.lit("N")).otherwise(call["ref"])


def merge_alleles(gathered: DataFrame) -> DataFrame:
    """With ref and alt (merged) and, in the order of calls, `mine` (a call's ALT in terms of the merged REF) and `source`
    (the place of every merged allele among its own). Calls stay as they are: to rebuild them costs more than all this."""
    out = gathered.withColumn("ref", merged_ref(F.col("s"), F.col("calls")))
    out = out.withColumn("mine", F.transform("calls", lambda c: A.in_terms_of(F.col("ref"), ref_at(F.col("s"), c), c["alt"])))
    out = out.withColumn("alt", A.merged_alt(F.col("mine")))
    # bound, as a column that only a lambda uses would be worked out again for every call
    return out.withColumn("source", with_value(F.col("alt"), lambda alt: F.transform("mine", lambda m: A.sources(alt, m))))


def merged_alleles(calls: DataFrame, spec: Spec, begin: int | None = None, end: int | None = None) -> DataFrame:
    """contig, s, t, ref, alt: the merged alleles of every segment, without its calls."""

    def both(s: Column, calls: Column) -> Column:
        mine = lambda ref: F.transform(calls, lambda c: A.in_terms_of(ref, ref_at(s, c), c["alt"]))
        return with_value(merged_ref(s, calls), lambda ref: F.struct(ref.alias("ref"), A.merged_alt(mine(ref)).alias("alt")))

    found = gathered(pieces(calls, spec), ["col_begin", "ref", "alt"], begin, end, of=lambda s, calls: {"_alleles": both(s, calls)})
    return found.select("contig", "s", "t", "_alleles.ref", "_alleles.alt")


def merged_refs(calls: DataFrame, spec: Spec, begin: int | None = None, end: int | None = None) -> DataFrame:
    """contig, s, t, ref: the same without ALT, for which no ALT is shuffled."""
    return gathered(pieces(calls, spec), ["col_begin", "ref"], begin, end, of=lambda s, calls: {"ref": merged_ref(s, calls)})


#: Fields of gathered calls that are of no use beyond merging.
INNER = ("_b", "_e", "_dense", "_span", "mine", "source")


def remapped(merged: DataFrame, spec: Spec, kept: Iterable[str] | None = None) -> Column:
    """Every call's arrays and GT in terms of the merged alleles; genotype-shaped fields are dropped where there are more
    than spec.max_alt ALT alleles. Calls have row_idx and these fields (all without)."""
    names = merged.schema["calls"].dataType.elementType.fieldNames()
    names = [n for n in names if n not in INNER and (kept is None or n == "row_idx" or n in set(kept))]

    def one(c: Column, alt: Column, mine: Column, source: Column) -> Column:
        few, ploidy = F.size(alt) <= spec.max_alt, F.size(c["gt"])
        new = {"gt": A.remap_gt(c["gt"], alt, mine)}
        if "s" in merged.columns:
            new["ref"] = ref_at(F.col("s"), c)
        for n in spec.per_allele:
            new[n] = A.remap_alleles(c[n], source)
        for n in spec.per_alt:
            new[n] = A.remap_alleles(c[n], source, True)
        for n in spec.per_allele_2d:
            new[n] = A.remap_2d(c[n], source)
        for n in spec.per_genotype if not spec.general_ploidy else ():
            new[n] = F.when(few & (ploidy == 2), A.remap_diploid(c[n], source)).when(few & (ploidy == 1), A.remap_haploid(c[n], source))
        return F.struct(*[new.get(n, c[n]).alias(n) for n in names])

    alleles = F.struct("alt", "mine", "source")  # bound as above
    return with_value(alleles, lambda a: F.transform("calls", lambda c, i: one(c, a["alt"], F.get(a["mine"], i), F.get(a["source"], i))))


def remap_calls(merged: DataFrame, spec: Spec, kept: Iterable[str] | None = None) -> DataFrame:
    return merged.withColumn("calls", remapped(merged, spec, kept)).drop("mine", "source")


def remap_any_ploidy(merged: DataFrame, spec: Spec) -> DataFrame:
    """Genotype fields of calls of any ploidy in terms of the merged alleles: call by call, then gathered again."""
    key = ["contig", "s", "t", "ref", "alt"]
    whole = F.transform("calls", lambda c, i: c.withField("mine", F.get("mine", i)).withField("source", F.get("source", i)))
    each = merged.select(*key, F.explode(whole).alias("c"))
    few = F.size("alt") <= spec.max_alt
    for n in spec.per_genotype:
        again = A.remap_genotypes(F.when(few, F.col(f"c.{n}")), F.col("c.source"), F.size("c.gt"))
        each = each.withColumn("_v", again).withColumn("c", F.col("c").withField(n, F.col("_v"))).drop("_v")
    again = each.groupBy(*key).agg(F.array_sort(F.collect_list("c")).alias("calls"))
    return again.withColumns({n: _values(n) for n in ("mine", "source")})


def info_dp(calls: Column) -> Column:
    """Sum over calls of INFO dp, else min_dp, else dp_format; null unless positive."""
    total = F.aggregate(calls, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(c["dp"], c["min_dp"], c["dp_format"], F.lit(0)).cast("long"))
    return with_value(total, lambda n: F.when(n > 0, n))


def combine_gvcf(calls: DataFrame, spec: Spec | None = None, begin: int | None = None, end: int | None = None, reference: DataFrame | None = None, fields: Iterable[str] | None = None) -> DataFrame:
    """Combined records: contig, s, t, ref, alt, info fields, dp, ids, filters, and calls (merged; none if sites only), which
    have these fields of the calls' (all without), and gt.

    reference: contig, pos (on the calls' axis) and base, by which a lone `N` is filled."""
    spec = spec or Spec()
    kept = None
    if fields is not None:
        kept = ["col_begin", "ref", "alt", *fields, "gt", *(n for n, (op, _) in spec.info.items() if op == MOVED)]
        fields = [n for n in dict.fromkeys([*fields, "gt", *spec.info, "dp", "min_dp", "dp_format", "id", "filter"]) if n in calls.columns]
    out = merge_alleles(segment_calls(calls, spec, fields, begin, end))
    if spec.general_ploidy:
        out = remap_any_ploidy(out, spec)
    columns = set(calls.columns)
    blocks = F.forall("calls", lambda c: c["alt"] == F.array(F.lit(A.NON_REF)))
    info = {n: COMBINE[op](_values(n), kind).alias(n) for n, (op, kind) in spec.info.items() if op != MOVED}
    dp = F.when(~blocks, info_dp(F.col("calls"))) if {"dp", "min_dp", "dp_format"} <= columns else F.lit(None).cast("long")
    ids = COMBINE["ids"](_values("id")) if "id" in columns else F.lit(None).cast("string")
    filters = COMBINE["union"](_values("filter")) if "filter" in columns else F.lit(None).cast("array<string>")
    merged = [remapped(out, spec, kept).alias("calls")] if not spec.sites_only else []
    out = out.select("contig", "s", "t", "ref", "alt", *info.values(), dp.alias("dp"), ids.alias("ids"), filters.alias("filters"), *merged)
    return fill_reference(out, reference) if reference is not None else out


def _values(name: str) -> Column:
    return F.transform("calls", lambda c: c[name])


def fill_reference(records: DataFrame, reference: DataFrame) -> DataFrame:
    """A REF of `N` becomes the genome's base (anything but ACGT stays `N`): an equi-join on (contig, position)."""
    base = reference.select("contig", F.col("pos").alias("s"), F.upper("base").alias("_base"))
    out = records.join(base, ["contig", "s"], "left")
    known = F.col("_base").isin("A", "C", "G", "T")
    return out.withColumn("ref", F.when((F.col("ref") == "N") & known, F.col("_base")).otherwise(F.col("ref"))).drop("_base")


def format_matrix(records: DataFrame, callsets: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """contig, s, row_idx, sample and the fields of every sample at every record, null where a sample has no call; arrays
    are padded with nulls to the longest at the record. callsets: row_idx, name."""
    samples = callsets.agg(F.array_sort(F.collect_list(F.struct("row_idx", F.col("name").alias("sample")))).alias("_all"))
    wide = records.crossJoin(F.broadcast(samples))  # one row: the sample dimension
    longest = {n: F.array_max(_sizes(n)) for n in fields if _is_array(records, n)}
    places = F.transform("calls", lambda c: c["row_idx"])
    wide = wide.withColumns({f"_n_{n}": x for n, x in longest.items()} | {"_rows": places})

    def value(n: str, c: Column) -> Column:
        if n not in longest:
            return c[n]
        kind = records.schema["calls"].dataType.elementType[n].dataType.simpleString()
        have = F.coalesce(c[n], F.array().cast(kind))
        nothing = F.get(F.array().cast(kind), F.lit(0))
        return F.when(F.col(f"_n_{n}") > 0, F.concat(have, F.array_repeat(nothing, F.col(f"_n_{n}") - F.size(have))))

    def one(s: Column) -> Column:
        c = F.get("calls", F.array_position("_rows", s["row_idx"]).cast("int") - 1)
        return F.struct(s["row_idx"].alias("row_idx"), s["sample"].alias("sample"), *[value(n, c).alias(n) for n in fields])

    return wide.select("contig", "s", F.inline(F.transform("_all", one)))


def _sizes(name: str) -> Column:
    return F.transform("calls", lambda c: F.size(c[name]))


def _is_array(records: DataFrame, name: str) -> bool:
    call = records.schema["calls"].dataType.elementType
    return call[name].dataType.typeName() == "array"


def encode_gt(gt: Column, phased: Column | None = None, produce: bool = True) -> Column:
    """GT as text: alleles joined by `/` or, where phased, `|`; missing alleles are `.`; without `produce` all are."""
    allele = lambda a: F.when(F.lit(produce) & (a >= 0), a.cast("string")).otherwise(F.lit("."))
    if phased is None:
        return F.array_join(F.transform(gt, allele), "/")
    parts = F.transform(gt, lambda a, i: F.concat(F.when(i == 0, F.lit("")).when(F.get(phased, i - 1), F.lit("|")).otherwise(F.lit("/")), allele(a)))
    return F.array_join(parts, "")
