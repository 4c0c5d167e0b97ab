"""Allele counts and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.functions.alleles import normalise
from locusweave.operators.intervals import overlap


def allele_counts(calls: DataFrame, intervals: DataFrame) -> DataFrame:
    """interval_id, col_begin, ref, alt, n: how many genotype alleles each non-reference allele has, normalised."""
    hits = overlap(calls, intervals).select("interval_id", "col_begin", "ref", "alt", F.explode("gt").alias("a")).where("a > 0")
    ref, alt = normalise(F.col("ref"), F.get("alt", F.col("a") - 1))
    return hits.select("interval_id", "col_begin", ref.alias("ref"), alt.alias("alt")).groupBy("interval_id", "col_begin", "ref", "alt").agg(F.count("*").alias("n"))


def column_histogram(calls: DataFrame, begin: int = 0, end: int = 4_000_000_000, width: int = 100) -> DataFrame:
    """bin, n: calls by their begin; what lies outside goes to the first or last bin."""
    last = (end - begin) // width
    return calls.select(F.least(F.greatest(F.expr(f"(col_begin - {begin}) div {width}"), F.lit(0)), F.lit(last)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def equi_load_bins(histogram: DataFrame, k: int) -> DataFrame:
    """first, last, n: bins in a row until each run holds at least total / k. Every run starts from where the one before
    overshot, so it's a fold over the bins: k steps, each a lookup in the running sum, never the bins themselves."""
    from pyspark.sql import Window

    spark = histogram.sparkSession
    total, n_bins = histogram.agg(F.sum("n"), F.count("*")).first()
    if not total or k >= n_bins:
        raise ValueError("the number of runs must be smaller than the number of bins")
    block = 4096  # running sums by blocks of bins, so that no window holds all of them
    h = histogram.withColumn("_block", F.expr(f"bin div {block}"))
    ahead = h.groupBy("_block").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    running = h.join(ahead.select("_block", "_before"), "_block").withColumn("upto", F.col("_before") + F.sum("n").over(Window.partitionBy("_block").orderBy("bin"))).select("bin", "n", "upto").cache()
    out, done, first = [], 0, running.agg(F.min("bin")).first()[0]
    while done < total:
        row = running.where(F.col("upto") >= done + total / k).orderBy("bin").select("bin", "upto").first()
        if row is None:
            last = running.agg(F.max("bin")).first()[0]
            out.append((first, last, total - done))
            break
        out.append((first, row.bin, row.upto - done))
        done = row.upto
        following = running.where(F.col("bin") > row.bin).orderBy("bin").select("bin").first()
        if following is None:
            break
        first = following.bin
    return spark.createDataFrame(out, "first long, last long, n long")


def interval_histogram(calls: DataFrame, hi: int, n_bins: int) -> DataFrame:
    """bin, lo, hi, n: intervals that touch each of n_bins even bins over [0, hi]; an interval counts in every one."""
    width = -(-(hi + 1) // n_bins)
    at = lambda c: F.least(F.expr(f"{c} div {width}"), F.lit(n_bins - 1))
    touched = calls.select(F.explode(F.sequence(at("col_begin"), at("col_end"))).alias("bin"))
    return touched.groupBy("bin").agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width - 1).alias("hi"), "n")


def merge_histograms(*histograms: DataFrame) -> DataFrame:
    """Histograms over the same bins, added up."""
    out = histograms[0]
    for h in histograms[1:]:
        out = out.unionByName(h)
    return out.groupBy("bin", "lo", "hi").agg(F.sum("n").alias("n"))


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """counter, n, total, total_squares, mean, deviation: of counters."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).cast("double").alias("x")) for c in columns))).alias("p")).select("p.*")
    return long.groupBy("counter").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("total_squares"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
