"""Grouped variants, paging, dummy genotyping and top sites."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusweave.functions import alleles as A
from locusweave.functions.combine import with_value
from locusweave.operators.genotyping import medians
from locusweave.operators.merge import Spec, merge_alleles, pieces, remap_calls, segment_calls
from locusweave.operators.intervals import BIN, SWEEP_BIN, next_begins, overlap, tiles
from locusweave.session import worker_path


def variants(calls: DataFrame, intervals: DataFrame, spec: Spec | None = None) -> DataFrame:
    """Per query interval, calls with the same begin, end, REF and set of ALT are one variant, in terms of the ALT order of
    its first row; numbered by (begin, first row). interval_id, col_begin, eff_end, ref, alt, calls, number."""
    spec = spec or Spec()
    found = overlap(calls, intervals).withColumn("_set", F.array_sort("alt"))
    rest = [c for c in found.columns if c not in ("interval_id", "qb", "qe", "eff_end", "_set", "contig")]
    grouped = found.groupBy("interval_id", "contig", F.col("col_begin").alias("b"), F.col("eff_end").alias("e"), F.col("ref").alias("r"), "_set").agg(F.array_sort(F.collect_list(F.struct("row_idx", *[c for c in rest if c != "row_idx"]))).alias("calls"))
    named = grouped.withColumn("ref", F.col("r")).withColumn("alt", F.get("calls", F.lit(0))["alt"])
    named = named.withColumns({"mine": F.transform("calls", lambda c: c["alt"]), "source": with_value(F.col("alt"), lambda alt: F.transform("calls", lambda c: A.sources(alt, c["alt"])))})
    out = remap_calls(named, spec)
    out = out.withColumns({"_first": F.get("calls", F.lit(0))["row_idx"], "_part": F.expr(f"b div {BIN}")})
    # numbers count on from bin to bin: no task holds a whole interval
    per = found.select("interval_id", "contig", F.col("col_begin").alias("b"), "eff_end", "ref", "_set").distinct().groupBy("interval_id", F.expr(f"b div {BIN}").alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("interval_id").orderBy("_part")) - F.col("_n")
    out = out.join(per.select("interval_id", "_part", before.alias("_before")), ["interval_id", "_part"])
    number = F.col("_before") + F.row_number().over(Window.partitionBy("interval_id", "_part").orderBy("b", "_first", "e")) - 1
    return out.withColumn("number", number).select("interval_id", "contig", F.col("b").alias("col_begin"), F.col("e").alias("eff_end"), "ref", "alt", "calls", "number")


def page(rows: DataFrame, size: int, token: str | None = None) -> tuple[DataFrame, str | None]:
    """The next page of variants by (col_begin, row_idx), and the token after it. A page always completes its last column.
    Keyset paging: a filter and a limit, never a count of what was skipped."""
    after = rows if token is None else rows.where(F.col("col_begin") > int(token))
    last = after.orderBy("col_begin").select("col_begin").limit(size).agg(F.max("col_begin")).first()[0]
    if last is None:
        return after.limit(0), None
    return after.where(F.col("col_begin") <= last), str(last)


def dummy_genotyping(calls: DataFrame) -> DataFrame:
    """contig, s, t, genotype, median_pl: per segment and merged genotype the middle PL, counted from the largest."""
    spec = Spec(per_allele=(), info={})
    each = pieces(calls.withColumn("_ploidy", F.coalesce(F.size("gt"), F.lit(0))), spec)
    found = tiles(each, ["col_begin", "ref", "alt", "pl", "_ploidy"], nexts=next_begins(calls)).select("contig", "_tile", "_next", "_calls")
    worker_path(SparkSession.getActiveSession())
    return found.mapInArrow(partial(medians, width=SWEEP_BIN, max_alt=spec.max_alt), "contig string, s long, t long, genotype int, median_pl int")


def top_allele_sites(calls: DataFrame, k: int = 25) -> DataFrame:
    """The k segments with most merged ALT alleles; among equals the lowest positions."""
    merged = merge_alleles(segment_calls(calls, Spec(per_allele=(), per_genotype=(), info={}), []))
    return merged.select("contig", "s", "t", "ref", F.array_join("alt", "|").alias("alts"), F.size("alt").alias("n_alt")).orderBy(F.desc("n_alt"), "s").limit(k)
