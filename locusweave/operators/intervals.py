"""Interval queries and the segment sweep.

`calls` have row_idx, contig, col_begin, col_end (inclusive), ref, alt and fields. All joins on overlap are equi-joins
on (contig, bin) with the exact condition on top, so they shuffle by key and never compare everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusweave.functions.alleles import contains_deletion, is_reference_block

BIN = 10_000
#: Tiles of the sweep: not much wider than calls are long, so that a call meets few segments it has nothing to do with.
SWEEP_BIN = 64


def truncate(calls: DataFrame) -> DataFrame:
    """With eff_end: a sample's call ends at the latest before its next call begins (per contig)."""
    following = F.lead("col_begin").over(Window.partitionBy("contig", "row_idx").orderBy("col_begin"))  # contigs tell more apart than rows: a cheaper sort
    return calls.withColumn("eff_end", F.least("col_end", F.coalesce(following - 1, F.col("col_end"))))


def illegal_overlaps(calls: DataFrame) -> DataFrame:
    """Calls that a later one of the same sample cuts though they are neither deletion nor reference block."""
    cut = truncate(calls).where("eff_end < col_end")
    return cut.where(~contains_deletion(F.col("ref"), F.col("alt")) & ~is_reference_block(F.col("ref"), F.col("alt")))


def duplicates(calls: DataFrame) -> DataFrame:
    """(row_idx, col_begin) that occur more than once."""
    return calls.groupBy("row_idx", "col_begin").agg(F.count("*").alias("n")).where("n > 1")


#: Bins of an interval from which it is cut to where calls are.
WIDE = 1 << 16


def bins(begin: str, end: str, width: int = BIN):
    return F.explode(F.sequence(F.expr(f"{begin} div {width}"), F.expr(f"{end} div {width}")))


def overlap(calls: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """calls x intervals (interval_id, qb, qe over the same axis): one row per call and interval that it reaches into by
    its effective end, with interval_id. A pair that shares several bins meets in the first of them only."""
    c = truncate(calls).withColumn("_bin", bins("col_begin", "eff_end", width))
    q = intervals.withColumns({"_qb": F.col("qb"), "_qe": F.col("qe")})
    if not intervals.where(F.col("qe") > F.col("qb") + WIDE * width).isEmpty():  # open ends: no bins where no calls are
        ends = calls.agg(F.min("col_begin").alias("lo"), F.max("col_end").alias("hi")).first()
        if ends.lo is not None:
            q = q.withColumns({"_qb": F.greatest("qb", F.lit(ends.lo)), "_qe": F.least("qe", F.lit(ends.hi))}).where("_qb <= _qe")
        else:
            q = q.where("false")
    met = c.join(q.withColumn("_bin", bins("_qb", "_qe", width)), "_bin").where("col_begin <= qe and eff_end >= qb")
    return met.where(F.col("_bin") == F.greatest(F.expr(f"col_begin div {width}"), F.expr(f"_qb div {width}"))).drop("_bin", "_qb", "_qe")


def at_interval(calls: DataFrame, begin: int, end: int) -> DataFrame:
    """The same for one interval. The filter on col_begin reaches the scan; of what lies beyond, only each sample's next
    begin is needed, a minimum over two columns."""
    beyond = calls.where(F.col("col_begin") > end).groupBy("row_idx", "contig").agg(F.min("col_begin").alias("_beyond"))
    cut = truncate(calls.where(F.col("col_begin") <= end)).join(beyond, ["row_idx", "contig"], "left")
    last = F.lead("col_begin").over(Window.partitionBy("row_idx", "contig").orderBy("col_begin")).isNull()
    cut = cut.withColumn("eff_end", F.when(last, F.least("eff_end", F.coalesce(F.col("_beyond") - 1, F.col("eff_end")))).otherwise(F.col("eff_end")))
    return cut.where(F.col("eff_end") >= begin).drop("_beyond")


def _clip(column: str, bound: int | None, by):
    return F.col(column) if bound is None else by(F.col(column), F.lit(bound).cast("long"))


def next_begins(calls: DataFrame, width: int = SWEEP_BIN) -> DataFrame:
    """contig, _tile, _next: for every tile that calls may reach into, where the first call of a later one begins (null after
    the last). Calls need not be truncated for it."""
    firsts = calls.groupBy("contig", F.expr(f"col_begin div {width}").alias("_from")).agg(F.min("col_begin").alias("_first"), F.max("col_end").alias("_last"))
    ordered = Window.partitionBy("contig").orderBy("_from")
    reach = F.expr(f"(_reach + 1) div {width}")  # of all calls so far, so tiles without a begin get their row as well, and one only
    found = firsts.select("contig", "_from", F.lead("_first").over(ordered).alias("_next"), F.lead("_from").over(ordered).alias("_to"), F.max("_last").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_reach"))
    return found.select("contig", F.explode(F.sequence("_from", F.least(F.col("_to") - 1, F.greatest("_from", reach)))).alias("_tile"), "_next")


def tiles(calls: DataFrame, fields: Iterable[str] | None, begin: int | None = None, end: int | None = None, width: int = SWEEP_BIN, nexts: DataFrame | None = None) -> DataFrame:
    """contig, _tile (position div width), _calls (structs of row_idx, `fields`, _b, _e and _dense, in that order) and _next, the
    first edge of the contig's next tile, or what `nexts` (next_begins()) has.

    Each call is dealt once to the tiles that it and the place after it touch; a tile's edges, and what is active between
    them, come from its own calls, so nothing but calls is shuffled, and not once per segment. Only the edge after a tile's
    last one lies elsewhere: the first edges of tiles come from places alone."""
    if "eff_end" not in calls.columns:
        calls = truncate(calls)
    if "_b" not in calls.columns:
        calls = calls.withColumns({"_b": F.col("col_begin"), "_e": F.col("eff_end")})
    if "_dense" not in calls.columns:
        calls = calls.withColumn("_dense", contains_deletion(F.col("ref"), F.col("alt")))
    c = calls.withColumns({"_b": _clip("_b", begin, F.greatest), "_e": _clip("_e", end, F.least)}).where("_b <= _e")
    tile = lambda x: F.expr(f"{x} div {width}")
    if nexts is None:
        first = F.when(F.col("_dense"), F.transform(F.sequence(tile("_b"), tile("(_e + 1)")), lambda k: F.greatest(F.col("_b"), k * width))).otherwise(F.array(F.col("_b"), F.col("_e") + 1))
        firsts = c.select("contig", F.explode(first).alias("_f")).groupBy("contig", tile("_f").alias("_tile")).agg(F.min("_f").alias("_first"))
        nexts = firsts.select("contig", "_tile", F.lead("_first").over(Window.partitionBy("contig").orderBy("_tile")).alias("_next"))
    names = [n for n in (fields if fields is not None else calls.columns) if n not in ("contig", "row_idx", "_b", "_e", "_dense")]
    dealt = c.select("contig", F.struct("row_idx", *names, "_b", "_e", "_dense").alias("_c"), bins("_b", "(_e + 1)", width).alias("_tile"))
    # sorted once here, not at every edge
    return dealt.repartition("contig", "_tile").groupBy("contig", "_tile").agg(F.sort_array(F.collect_list("_c")).alias("_calls")).join(nexts.hint("shuffle_hash"), ["contig", "_tile"])


def _tiled(calls: DataFrame, fields: Iterable[str] | None, begin: int | None, end: int | None, width: int) -> tuple[DataFrame, Column]:
    """Tiles, and in terms of their columns the pieces of each: an array of structs of s, t and calls; see gathered(). What is made of
    the array belongs into the generator that makes rows of it, so that calls are not written out once per piece."""
    low = F.col("_tile") * width
    edge = lambda c: F.when(c["_dense"], F.sequence(F.greatest(c["_b"], low), F.least(c["_e"] + 1, low + (width - 1)))).otherwise(F.array(c["_b"], c["_e"] + 1))
    # sort_array: array_sort compares by an interpreted function
    edges = F.sort_array(F.array_distinct(F.filter(F.flatten(F.transform("_calls", edge)), lambda s: (s >= low) & (s < low + width))))
    active = lambda s: F.filter("_calls", lambda c: (c["_b"] <= s) & (c["_e"] >= s))
    pieces = F.transform("_edges", lambda s, i: F.struct(s.alias("s"), (F.coalesce(F.get("_edges", i + 1), F.col("_next")) - 1).alias("t"), active(s).alias("calls")))
    return tiles(calls, fields, begin, end, width).withColumn("_edges", edges), F.filter(pieces, lambda p: F.size(p["calls"]) > 0)


def gathered(calls: DataFrame, fields: Iterable[str] | None = None, begin: int | None = None, end: int | None = None, width: int = SWEEP_BIN, of: Callable[[Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """contig, s, t, calls: the aligned pieces between places where the set of active calls changes, and every single
    position while a deletion is active, with the calls that are active there: structs of row_idx and `fields` (all
    columns without), sorted by row_idx. calls may say by _b and _e where they are active, and by _dense whether they are
    deletions. With `of`, a function of s and calls, what it names instead of calls, which then never become rows."""
    found, pieces = _tiled(calls, fields, begin, end, width)
    if of is not None:
        pieces = F.transform(pieces, lambda p: F.struct(p["s"].alias("s"), p["t"].alias("t"), *[x.alias(n) for n, x in of(p["s"], p["calls"]).items()]))
    return found.select("contig", F.inline(pieces))


def sweep(calls: DataFrame, begin: int | None = None, end: int | None = None, fields: Iterable[str] | None = None, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Segments with their active calls (one row each; only those for which `keep` holds, all of them without), over all
    of the axis or one interval of it."""
    calls = calls if "eff_end" in calls.columns else truncate(calls)
    fields = [n for n in (fields if fields is not None else calls.columns) if n not in ("contig", "row_idx", "_b", "_e", "_dense")]
    found, pieces = _tiled(calls, fields, begin, end, SWEEP_BIN)
    one = lambda p, c: F.struct(p["s"].alias("s"), p["t"].alias("t"), c["row_idx"].alias("row_idx"), *[c[n].alias(n) for n in fields])
    kept = lambda p: F.filter(p["calls"], keep) if keep is not None else p["calls"]
    return found.select("contig", F.inline(F.flatten(F.transform(pieces, lambda p: F.transform(kept(p), lambda c: one(p, c))))))


def interesting_positions(calls: DataFrame) -> DataFrame:
    """contig, s, t, n_calls, n_ref_blocks, n_begins: per segment."""
    marked = calls.withColumn("_block", is_reference_block(F.col("ref"), F.col("alt")))
    count = lambda calls, f: F.size(F.filter(calls, f)).cast("long")
    return gathered(marked, ["col_begin", "_block"], of=lambda s, calls: {"n_calls": F.size(calls).cast("long"), "n_ref_blocks": count(calls, lambda c: c["_block"]), "n_begins": count(calls, lambda c: c["col_begin"] == s)})


def partition_cells(calls: DataFrame, partitions: DataFrame) -> DataFrame:
    """calls with the partition (pid) they belong to: where they begin, or, for those that reach over a partition's
    begin, there too (partitions: pid, p_begin, p_end)."""
    return overlap(calls, partitions.select(F.col("pid").alias("interval_id"), F.col("p_begin").alias("qb"), F.col("p_end").alias("qe"))).withColumnRenamed("interval_id", "pid").drop("qb", "qe")


def neighbours_overlap(ranges: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """Ranges that begin before the greatest end so far (per key); by a small dimension table's window."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("before", before).where(F.col(begin) <= F.col("before"))


def load_partition(calls: DataFrame, begin: int, end: int, ignore_outside: bool = False, first_row: int = 0, last_row: int | None = None) -> DataFrame:
    """Calls that belong to a column partition and a range of rows (bounds swapped if reversed). Calls that end before
    the partition or begin after it are an error, unless they are to be ignored; those that reach over its begin stay."""
    if last_row is not None:
        first_row, last_row = min(first_row, last_row), max(first_row, last_row)
        calls = calls.where(F.col("row_idx") <= last_row)
    calls = calls.where(F.col("row_idx") >= first_row)
    inside = (F.col("col_end") >= begin) & (F.col("col_begin") <= end)
    if ignore_outside:
        return calls.where(inside)
    checked = F.when(inside, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("call outside the partition: row "), F.col("row_idx").cast("string"), F.lit(", column "), F.col("col_begin").cast("string"))).cast("boolean"))
    return calls.where(checked)
