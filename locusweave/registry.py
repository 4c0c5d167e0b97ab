"""All queries over the driver's tables, with their SQL. Calls come from sources.adapter; arrays are returned as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.functions import alleles as A
from locusweave.functions.combine import COMBINE
from locusweave.operators import analytics, diff, intervals, merge, variants
from locusweave.plans.projection import plan_columns
from locusweave.sources import adapter, csv_cells, metadata, sinks
from locusweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Query intervals over the adapter's axis. Fixed values.
INTERVALS = [(0, 1000, 1400), (1, 1300, 1300), (2, 5000, 9000), (3, 20_000, 26_000), (4, 39_990, 40_010)]
PARTITIONS = [(0, 0, 9_999), (1, 10_000, 24_999), (2, 25_000, 10_000_000)]
SPEC = merge.Spec(format=())


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def text(c: Column | str) -> Column:
    return F.array_join((F.col(c) if isinstance(c, str) else c).cast("array<string>"), ",", ".")


def sql_text(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda z: coalesce(CAST(z AS VARCHAR), '.')), ',')"


def values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(map(str, rows))}) AS v({names})"


CALLS = f"WITH {adapter.SQL}"
SWEEP = CALLS + adapter.SEGMENTS_SQL
Q = values(INTERVALS, "interval_id, qb, qe")
#: Active calls after the rewrite of spanning deletions; the merged alleles of every segment; calls in their terms.
MERGED = SWEEP + """,
act AS (SELECT *, col_begin < s AND has_del AS span, CASE WHEN col_begin < s THEN 'N' ELSE ref END AS r2,
    CASE WHEN col_begin < s AND has_del THEN ['*', '<NON_REF>'] ELSE alt END AS a2,
    CASE WHEN col_begin < s AND has_del THEN [0, 1, len(alt)] ELSE range(0, len(alt) + 1) END AS keep FROM active),
act2 AS (SELECT * REPLACE (
    list_transform(keep, lambda i: ad[i + 1]) AS ad,
    flatten(list_transform(range(0, len(keep)), lambda k: list_transform(range(0, k + 1), lambda j: pl[keep[k + 1] * (keep[k + 1] + 1) // 2 + keep[j + 1] + 1]))) AS pl,
    CASE WHEN span THEN list_transform(gt, lambda a: CASE WHEN a <= 1 THEN a ELSE len(keep) - 1 END) ELSE gt END AS gt,
    CASE WHEN NOT span THEN rank_sum END AS rank_sum) FROM act),
mref AS (SELECT contig, s, t, coalesce(max(ref) FILTER (col_begin = s AND length(ref) = mx), 'N') AS mref FROM (SELECT *, max(CASE WHEN col_begin = s THEN length(ref) END) OVER (PARTITION BY contig, s) AS mx FROM act2) GROUP BY 1, 2, 3),
mine AS (SELECT a.*, m.mref, list_transform(a2, lambda x: CASE WHEN x = '*' OR starts_with(x, '<') THEN x ELSE x || substr(m.mref, length(r2) + 1) END) AS mine FROM act2 a JOIN mref m USING (contig, s, t)),
alleles AS (SELECT contig, s, t, allele, min(row_idx * 100 + pos) AS ord FROM (SELECT contig, s, t, row_idx, unnest(mine) AS allele, unnest(range(0, len(mine))) AS pos FROM mine) GROUP BY ALL),
malt AS (SELECT contig, s, t, list(allele ORDER BY allele = '<NON_REF>', ord) AS malt FROM alleles GROUP BY ALL),
merged AS MATERIALIZED (SELECT *, list_concat([0], list_transform(malt, lambda a: coalesce(nullif(list_position(mine, a), 0), list_position(mine, '<NON_REF>')))) AS src FROM mine JOIN malt USING (contig, s, t))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.calls(spark, sf_dir)


def query_intervals(spark: SparkSession) -> DataFrame:
    return metadata.intervals(spark, INTERVALS)


# ------------------------------------------------------------------ scans and interval queries


@query(CALLS + f"SELECT row_idx, contig, col_begin, col_end, ref, {sql_text('alt')} AS alts, {sql_text('pl')} AS pls, {sql_text('ad')} AS ads, {sql_text('gt')} AS gts, rank_sum, CAST(dp AS BIGINT) AS dp FROM calls")
def calls_all(spark, sf):
    return calls(spark, sf).select("row_idx", "contig", "col_begin", "col_end", "ref", text("alt").alias("alts"), text("pl").alias("pls"), text("ad").alias("ads"), text("gt").alias("gts"), "rank_sum", F.col("dp").cast("long").alias("dp"))


@query(CALLS + f"SELECT row_idx, contig, col_begin, col_end, ref, {sql_text('alt')} AS alts, {sql_text('pl')} AS pls, {sql_text('gt')} AS gts FROM calls")
def calls_projected(spark, sf):
    c = calls(spark, sf)
    columns = plan_columns(["pl"], {"pl": {"length": ["G"]}}, c.columns)
    return c.select(columns).select("row_idx", "contig", "col_begin", "col_end", "ref", text("alt").alias("alts"), text("pl").alias("pls"), text("gt").alias("gts"))


@query(CALLS + "SELECT row_idx, col_begin, col_end, ref FROM calls WHERE row_idx IN (1, 4, 6)")
def calls_row_subset(spark, sf):
    rows = spark.createDataFrame([(1,), (4,), (6,), (99,)], "row_idx long")
    return calls(spark, sf).join(F.broadcast(rows), "row_idx", "left_semi").select("row_idx", "col_begin", "col_end", "ref")


@query(CALLS + "SELECT row_idx, col_begin, eff_end, ref FROM trunc WHERE col_begin <= 6000 AND eff_end >= 6000")
def calls_single_position(spark, sf):
    return intervals.at_interval(calls(spark, sf), 6000, 6000).select("row_idx", "col_begin", "eff_end", "ref")


@query(CALLS + "SELECT row_idx, col_begin, eff_end, ref FROM trunc WHERE col_begin <= 9000 AND eff_end >= 5000")
def calls_interval(spark, sf):
    return intervals.at_interval(calls(spark, sf), 5000, 9000).select("row_idx", "col_begin", "eff_end", "ref")


@query(CALLS + f"SELECT interval_id, row_idx, col_begin, eff_end FROM trunc JOIN {Q} ON col_begin <= qe AND eff_end >= qb")
def calls_multi_interval(spark, sf):
    return intervals.overlap(calls(spark, sf), query_intervals(spark)).select("interval_id", "row_idx", "col_begin", "eff_end")


@query(CALLS + f"SELECT pid, row_idx, col_begin, eff_end FROM trunc JOIN {values(PARTITIONS, 'pid, pb, pe')} ON col_begin <= pe AND eff_end >= pb")
def calls_partition_pruned(spark, sf):
    p = spark.createDataFrame(PARTITIONS, "pid int, p_begin long, p_end long")
    return intervals.partition_cells(calls(spark, sf), p).select("pid", "row_idx", "col_begin", "eff_end")


@query(CALLS + "SELECT row_idx, col_begin, col_end, eff_end FROM trunc")
def effective_end(spark, sf):
    return intervals.truncate(calls(spark, sf)).select("row_idx", "col_begin", "col_end", "eff_end")


@query(CALLS + ", longer AS (SELECT row_idx, contig, col_begin, kind, CASE WHEN kind = 1 THEN col_begin + q ELSE col_end END AS e FROM calls) SELECT row_idx, col_begin FROM (SELECT *, lead(col_begin) OVER (PARTITION BY row_idx, contig ORDER BY col_begin) AS n FROM longer) WHERE kind = 1 AND n <= e")
def illegal_overlaps(spark, sf):
    """Substitutions are one position long; here they are made longer, so that others cut them."""
    longer = F.when(F.col("kind") == 1, F.col("col_begin") + F.col("q")).otherwise(F.col("col_end"))
    return intervals.illegal_overlaps(calls(spark, sf).withColumn("col_end", longer)).select("row_idx", "col_begin")


@query("SELECT l_suppkey % 8 AS row_idx, l_orderkey * 8 + l_linenumber AS col_begin, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_cells(spark, sf):
    raw = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_suppkey") % 8).alias("row_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("col_begin"))
    return intervals.duplicates(raw)


@query(SWEEP + " SELECT DISTINCT contig, s, t FROM active")
def segments(spark, sf):
    return intervals.gathered(calls(spark, sf), [], of=lambda s, calls: {})


@query(SWEEP + " SELECT contig, s, t, row_idx, col_begin, eff_end FROM active")
def segment_membership(spark, sf):
    return intervals.sweep(calls(spark, sf), fields=["col_begin", "eff_end"]).select("contig", "s", "t", "row_idx", "col_begin", "eff_end")


@query(CALLS + ", cut AS (SELECT * EXCLUDE (col_begin, eff_end), greatest(col_begin, 5000) AS col_begin, least(eff_end, 9000) AS eff_end FROM trunc WHERE col_begin <= 9000 AND eff_end >= 5000)" + adapter.SEGMENTS_SQL.replace("FROM trunc)", "FROM cut)", 1).replace("FROM trunc)", "FROM cut)") + " SELECT contig, s, t, count(*) AS n_calls FROM active GROUP BY ALL")
def segments_interval(spark, sf):
    return intervals.gathered(calls(spark, sf), [], 5000, 9000, of=lambda s, calls: {"n_calls": F.size(calls).cast("long")})


@query(SWEEP + " SELECT contig, s, t, count(*) AS n_calls, count(*) FILTER (kind = 0) AS n_ref_blocks, count(*) FILTER (col_begin = s) AS n_begins FROM active GROUP BY ALL")
def interesting_positions(spark, sf):
    return intervals.interesting_positions(calls(spark, sf))


# ------------------------------------------------------------------ metadata


CONTIGS = "ctg AS (SELECT contig_id AS idx, 'c' || contig_id AS name, CAST(20000 AS BIGINT) AS length FROM (SELECT DISTINCT contig_id FROM calls))"


def _contigs(c: DataFrame) -> DataFrame:
    """Every 20,000 columns are a contig here."""
    return c.select(F.col("contig_id").alias("idx"), F.col("contig").alias("name"), F.lit(20_000).cast("long").alias("length")).distinct()


@query(CALLS + f", {CONTIGS} SELECT idx, name, length, CAST(sum(length) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS \"offset\" FROM ctg")
def contig_offsets(spark, sf):
    return metadata.contig_offsets(_contigs(calls(spark, sf)))


@query(CALLS + ' SELECT row_idx, col_begin, contig, col_begin - contig_id * 20000 AS contig_pos FROM calls')
def contig_lookup(spark, sf):
    c = calls(spark, sf)
    known = _contigs(c).withColumn("offset", F.col("idx") * 20_000)
    return metadata.with_contig(c.select("row_idx", "col_begin"), "col_begin", known, 100_000)


@query(CALLS + " SELECT row_idx, contig, contig_id * 20000 + col_begin % 20000 AS column FROM calls".replace("column", '"column"'))
def column_lookup(spark, sf):
    c = calls(spark, sf)
    known = _contigs(c).withColumn("offset", F.col("idx") * 20_000)
    return metadata.to_column(c.select("row_idx", "contig", (F.col("col_begin") % 20_000).alias("pos")), known).select("row_idx", "contig", "column")


@query("SELECT s_name AS name, row_number() OVER (ORDER BY s_name) - 1 AS row_idx FROM (SELECT DISTINCT s_name FROM supplier)")
def callset_row_idx(spark, sf):
    return metadata.assign_rows(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("name"))).select("name", F.col("row_idx").cast("long").alias("row_idx"))


@query(CALLS + " SELECT c.row_idx, c.col_begin, s_name AS sample FROM calls c JOIN (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS row_idx FROM (SELECT DISTINCT s_name FROM supplier)) s ON c.row_idx = s.row_idx")
def sample_lookup(spark, sf):
    names = metadata.assign_rows(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_name").alias("name")))
    return metadata.with_sample(calls(spark, sf).select("row_idx", "col_begin"), names)


@query(CALLS + " SELECT * FROM (SELECT row_idx, col_begin, col_end, max(col_end) OVER (PARTITION BY row_idx ORDER BY col_begin, col_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM calls) WHERE col_begin <= before")
def partition_overlap_check(spark, sf):
    return intervals.neighbours_overlap(calls(spark, sf).select("row_idx", "col_begin", "col_end"), "row_idx", "col_begin", "col_end")


# ------------------------------------------------------------------ alleles and genotypes


def merged_calls(spark, sf, *fields: str) -> DataFrame:
    return merge.merge_alleles(merge.segment_calls(calls(spark, sf), SPEC, fields))


def by_call(merged: DataFrame, **columns) -> DataFrame:
    """A row per call with contig, s, row_idx and these columns of it. The calls are cut down to that before they become
    rows: a field taken from exploded calls would have the optimiser repeat all that the calls are made of for each use."""
    return merged.select("contig", "s", F.inline(F.transform("calls", lambda c: F.struct(c["row_idx"].alias("row_idx"), *(f(c).alias(n) for n, f in columns.items())))))


def remapped(spark, sf, fields: merge.Spec) -> DataFrame:
    arrays = [*fields.per_allele, *fields.per_genotype]
    return merge.remap_calls(merged_calls(spark, sf, "gt", *arrays), fields, arrays or ["gt"])


@query(MERGED + " SELECT DISTINCT contig, s, t, mref AS ref FROM merged")
def merged_ref(spark, sf):
    return merge.merged_refs(calls(spark, sf), SPEC)


@query(MERGED + " SELECT DISTINCT contig, s, t, array_to_string(malt, '|') AS alts FROM merged")
def merged_alt(spark, sf):
    return merge.merged_alleles(calls(spark, sf), SPEC).select("contig", "s", "t", F.array_join("alt", "|").alias("alts"))


@query(MERGED + f" SELECT contig, s, row_idx, {sql_text('src')} AS source FROM merged")
def allele_lookup(spark, sf):
    each = F.zip_with("calls", "source", lambda c, source: F.struct(c["row_idx"].alias("row_idx"), text(source).alias("source")))
    return merged_calls(spark, sf).select("contig", "s", F.inline(each))


@query(MERGED + f" SELECT contig, s, row_idx, {sql_text('list_transform(gt, lambda a: CASE WHEN a = 0 THEN 0 ELSE coalesce(nullif(list_position(malt, mine[a]), 0), list_position(malt, ' + chr(39) + '<NON_REF>' + chr(39) + ')) END)')} AS gts FROM merged")
def gt_remap(spark, sf):
    return by_call(remapped(spark, sf, merge.Spec(per_allele=(), per_genotype=(), format=())), gts=lambda c: text(c["gt"]))


@query(MERGED + f" SELECT contig, s, row_idx, {sql_text('list_transform(src, lambda i: ad[i + 1])')} AS ads FROM merged")
def ad_remap(spark, sf):
    return by_call(remapped(spark, sf, merge.Spec(per_genotype=(), format=())), ads=lambda c: text(c["ad"]))


PL_SQL = "flatten(list_transform(range(0, len(src)), lambda k: list_transform(range(0, k + 1), lambda j: pl[(greatest(src[j + 1], src[k + 1]) * (greatest(src[j + 1], src[k + 1]) + 1)) // 2 + least(src[j + 1], src[k + 1]) + 1])))"


@query(MERGED + f" SELECT contig, s, row_idx, {sql_text(PL_SQL)} AS pls FROM merged")
def pl_remap_diploid(spark, sf):
    return by_call(remapped(spark, sf, SPEC), pls=lambda c: text(c["pl"]))


@query()
def pl_remap_general(spark, sf):
    """Triploid: 20 genotypes of four alleles, REF and first ALT exchanged; held against enumeration in the tests."""
    c = calls(spark, sf).where("kind = 3")
    pl = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((F.col("k") * (i + 3) + F.col("q") * i * i) % 97).cast("int"))
    return c.select("row_idx", "col_begin", text(A.remap_genotypes(pl, F.array(*map(F.lit, (0, 2, 1, 3))), F.lit(3))).alias("pls"))


@query(MERGED + f" SELECT contig, s, row_idx, r2 AS ref, {sql_text('a2')} AS alts, {sql_text('ad')} AS ads, {sql_text('pl')} AS pls, {sql_text('gt')} AS gts FROM act2 WHERE span")
def spanning_deletion(spark, sf):
    fields = ["ref", "alt", "ad", "pl", "gt"]
    c = merge.pieces(calls(spark, sf), SPEC)
    c = c.withColumns({n: F.when(F.col("_span"), F.col(n)) for n in fields})  # the others only cut segments: their fields stay behind
    found = intervals.sweep(c, fields=["_span", *fields], keep=lambda c: c["_span"])
    return found.select("contig", "s", "row_idx", "ref", text("alt").alias("alts"), text("ad").alias("ads"), text("pl").alias("pls"), text("gt").alias("gts"))


@query(MERGED + """, pairs AS (SELECT contig, s, row_idx, pl, unnest([[0, 0], [0, 1], [0, 2], [1, 1], [1, 2], [2, 2]]) AS jk FROM act2 WHERE span),
b AS (SELECT contig, s, row_idx, jk, row_number() OVER (PARTITION BY contig, s, row_idx ORDER BY pl[jk[2] * (jk[2] + 1) // 2 + jk[1] + 1], jk[1], jk[2]) AS r FROM pairs)
SELECT contig, s, row_idx, jk[1] || ',' || jk[2] AS gts FROM b WHERE r = 1""")
def min_pl_gt(spark, sf):
    spec = merge.Spec(format=(), min_pl_genotype=True)
    c = merge.pieces(calls(spark, sf), spec)
    found = intervals.sweep(c.withColumn("gt", F.when(F.col("_span"), F.col("gt"))), fields=["_span", "gt"], keep=lambda c: c["_span"])
    return found.select("contig", "s", "row_idx", text("gt").alias("gts"))


@query(CALLS + f""", f AS (SELECT *, list_sort(alt) AS st FROM trunc JOIN {Q} ON col_begin <= qe AND eff_end >= qb),
n AS (SELECT interval_id, contig, col_begin, eff_end, ref, st, list({{'r': row_idx, 'g': gt, 'p': pl}} ORDER BY row_idx) AS cs, arg_min(alt, row_idx) AS alt, min(row_idx) AS first FROM f GROUP BY interval_id, contig, col_begin, eff_end, ref, st)
SELECT interval_id, col_begin, eff_end, ref, {sql_text('alt')} AS alts, {sql_text("list_transform(cs, lambda c: c.r)")} AS rows, array_to_string(list_transform(cs, lambda c: {sql_text('c.p')}), ';') AS pls,
row_number() OVER (PARTITION BY interval_id ORDER BY col_begin, first, eff_end) - 1 AS number FROM n""")
def variants_ga4gh(spark, sf):
    v = variants.variants(calls(spark, sf), query_intervals(spark), SPEC)
    joined = lambda f: F.array_join(F.transform("calls", f), ";")
    return v.select("interval_id", "col_begin", "eff_end", "ref", text("alt").alias("alts"), text(F.transform("calls", lambda c: c["row_idx"])).alias("rows"), joined(lambda c: text(c["pl"])).alias("pls"), F.col("number").cast("long").alias("number"))


# ------------------------------------------------------------------ combining fields


def combined(spark, sf, op: str, value: Column, kind: str) -> DataFrame:
    """One field of each segment's calls, combined."""
    return intervals.gathered(calls(spark, sf).withColumn("_v", value), ["_v"], of=lambda s, calls: {"v": COMBINE[op](F.transform(calls, lambda c: c["_v"]), kind)})


@query(SWEEP + " SELECT contig, s, t, sum(rank_sum) AS v FROM active GROUP BY ALL")
def info_sum(spark, sf):
    return combined(spark, sf, "sum", F.col("rank_sum"), "double")


@query(SWEEP + " SELECT contig, s, t, CAST(sum(dp) // count(dp) AS BIGINT) AS v FROM active GROUP BY ALL")
def info_mean(spark, sf):
    return combined(spark, sf, "mean", F.col("dp"), "long")


@query(SWEEP + " SELECT contig, s, t, list(rank_sum ORDER BY rank_sum)[count(*) // 2 + 1] AS v FROM active GROUP BY ALL")
def info_median_upper(spark, sf):
    return combined(spark, sf, "median", F.col("rank_sum"), "double")


@query(SWEEP + f", e AS (SELECT contig, s, t, i, sum(ad[i]) AS x FROM (SELECT *, unnest(range(1, len(ad) + 1)) AS i FROM active) GROUP BY ALL) SELECT contig, s, t, {sql_text('list(CAST(x AS BIGINT) ORDER BY i)')} AS v FROM e GROUP BY ALL")
def info_elementwise_sum(spark, sf):
    return combined(spark, sf, "element_wise_sum", F.col("ad"), "long").withColumn("v", text("v"))


@query(SWEEP + f" SELECT contig, s, t, {sql_text('flatten(list(ad ORDER BY row_idx))')} AS v FROM active GROUP BY ALL")
def info_concat(spark, sf):
    return combined(spark, sf, "concatenate", F.col("ad"), "long").withColumn("v", text("v"))


@query(SWEEP + """, e AS (SELECT contig, s, t, a, bin, sum(n) AS n FROM (SELECT contig, s, t, unnest([0, 0, 1]) AS a, unnest([k % 5, k % 3, k % 4]) AS bin, unnest([q, 1, 2]) AS n FROM active) GROUP BY ALL),
per_allele AS (SELECT contig, s, t, a, string_agg(bin || ',' || CAST(n AS BIGINT), ',' ORDER BY bin) AS x FROM e GROUP BY ALL) SELECT contig, s, t, string_agg(x, '|' ORDER BY a) AS v FROM per_allele GROUP BY ALL""")
def info_histogram_sum(spark, sf):
    pair = lambda b, n: F.struct(b.alias("bin"), n.cast("long").alias("n"))
    value = F.array(F.array(pair(F.col("k") % 5, F.col("q")), pair(F.col("k") % 3, F.lit(1))), F.array(pair(F.col("k") % 4, F.lit(2))))
    h = combined(spark, sf, "histogram_sum", value, "long")
    one = lambda a: F.array_join(F.transform(a, lambda p: F.concat_ws(",", p["bin"].cast("string"), p["n"].cast("string"))), ",")
    return h.withColumn("v", F.array_join(F.transform("v", one), "|"))


@query(SWEEP + " SELECT contig, s, t, CAST(nullif(sum(coalesce(dp, min_dp, dp_format, 0)), 0) AS BIGINT) AS v FROM active GROUP BY ALL")
def info_dp(spark, sf):
    return intervals.gathered(calls(spark, sf), ["dp", "min_dp", "dp_format"], of=lambda s, calls: {"v": merge.info_dp(calls)})


@query(SWEEP + " SELECT contig, s, t, array_to_string(list_sort(list_distinct(flatten(list(filter)))), ',') AS v FROM active GROUP BY ALL")
def filter_union(spark, sf):
    return combined(spark, sf, "union", F.col("filter"), "string").withColumn("v", F.array_join("v", ","))


@query(SWEEP + " SELECT contig, s, t, nullif(array_to_string(list_sort(list_distinct(flatten(list(string_split(id, ';')) FILTER (id IS NOT NULL)))), ';'), '') AS v FROM active GROUP BY ALL")
def id_union(spark, sf):
    return combined(spark, sf, "ids", F.col("id"), "string")


COMBINED = MERGED + f""" SELECT contig, s, t, any_value(mref) AS ref, {sql_text('any_value(malt)')} AS alts, (list(rank_sum ORDER BY rank_sum) FILTER (rank_sum IS NOT NULL))[count(rank_sum) // 2 + 1] AS rank_sum,
CASE WHEN bool_or(a2 <> ['<NON_REF>']) THEN CAST(nullif(sum(coalesce(dp, min_dp, dp_format, 0)), 0) AS BIGINT) END AS dp,
nullif(array_to_string(list_sort(list_distinct(flatten(list(string_split(id, ';')) FILTER (id IS NOT NULL)))), ';'), '') AS ids, count(*) AS n_calls,
array_to_string(list(row_idx || ':' || {sql_text(PL_SQL)} ORDER BY row_idx), ';') AS pls FROM merged GROUP BY contig, s, t"""


@query(COMBINED)
def combined_gvcf(spark, sf):
    r = merge.combine_gvcf(calls(spark, sf).drop("filter"), merge.Spec(per_allele=(), format=()), fields=["pl"])
    pls = F.array_join(F.transform("calls", lambda c: F.concat(c["row_idx"].cast("string"), F.lit(":"), text(c["pl"]))), ";")
    return r.select("contig", "s", "t", "ref", text("alt").alias("alts"), "rank_sum", "dp", "ids", F.size("calls").cast("long").alias("n_calls"), pls.alias("pls"))


@query(MERGED + " SELECT contig, s, row_idx, rank_sum FROM (SELECT m.contig, m.s, m.row_idx, a.rank_sum FROM merged m JOIN act a ON a.contig = m.contig AND a.s = m.s AND a.row_idx = m.row_idx)")
def move_to_format(spark, sf):
    """An INFO field as a FORMAT field: every call of a record has its own value."""
    c = calls(spark, sf).drop("dp", "min_dp", "dp_format", "id", "filter")  # what records combine besides, and isn't asked for
    r = merge.combine_gvcf(c, merge.Spec(per_allele=(), per_genotype=(), format=(), info={"rank_sum": (merge.MOVED, "double")}), fields=[])
    return by_call(r, rank_sum=lambda c: c["rank_sum"])


@query(SWEEP + """, rows AS (SELECT DISTINCT row_idx FROM calls), sg AS (SELECT DISTINCT contig, s FROM active), m AS (SELECT contig, s, max(len(ad)) AS n FROM active GROUP BY ALL)
SELECT sg.contig, sg.s, r.row_idx, 'sample' || r.row_idx AS sample, a.dp_format, array_to_string(list_transform(range(1, m.n + 1), lambda i: coalesce(CAST(a.ad[i] AS VARCHAR), '.')), ',') AS ads
FROM sg CROSS JOIN rows r JOIN m ON m.contig = sg.contig AND m.s = sg.s LEFT JOIN active a ON a.contig = sg.contig AND a.s = sg.s AND a.row_idx = r.row_idx""")
def format_matrix(spark, sf):
    c = calls(spark, sf)
    g = intervals.gathered(c.withColumn("dp_format", F.col("dp_format").cast("long")), ["ad", "dp_format"])
    samples = c.select("row_idx").distinct().withColumn("name", F.concat(F.lit("sample"), F.col("row_idx")))
    return merge.format_matrix(g, samples, ("dp_format", "ad")).withColumnRenamed("ad", "ads").withColumn("ads", text("ads"))


# ------------------------------------------------------------------ analytics


NORMAL_REF = "CASE WHEN starts_with(a, '<') OR a = '*' THEN substr(ref, 1, 1) WHEN length(a) >= length(ref) THEN substr(ref, 1, 1) WHEN length(a) > 1 THEN substr(ref, 1, length(ref) - length(a) + 1) ELSE ref END"
NORMAL_ALT = "CASE WHEN starts_with(a, '<') OR a = '*' THEN a WHEN length(a) >= length(ref) THEN substr(a, 1, length(a) - length(ref) + 1) WHEN length(a) > 1 THEN substr(a, 1, 1) ELSE a END"


@query(CALLS + f", x AS (SELECT interval_id, col_begin, ref, alt[g] AS a FROM (SELECT *, unnest(gt) AS g FROM trunc JOIN {Q} ON col_begin <= qe AND eff_end >= qb) WHERE g > 0) SELECT interval_id, col_begin, {NORMAL_REF} AS ref, {NORMAL_ALT} AS alt, count(*) AS n FROM x GROUP BY ALL")
def allele_count(spark, sf):
    return analytics.allele_counts(calls(spark, sf), query_intervals(spark))


@query(CALLS + f", x AS (SELECT row_idx, col_begin, ref, unnest(alt) AS a FROM calls) SELECT row_idx, col_begin, {NORMAL_REF} AS nref, {NORMAL_ALT} AS nalt FROM x")
def ref_alt_normalised(spark, sf):
    x = calls(spark, sf).select("row_idx", "col_begin", "ref", F.explode("alt").alias("a"))
    ref, alt = A.normalise(F.col("ref"), F.col("a"))
    return x.select("row_idx", "col_begin", ref.alias("nref"), alt.alias("nalt"))


@query(CALLS + " SELECT least(greatest((col_begin - 1000) // 500, 0), 58) AS bin, count(*) AS n FROM calls GROUP BY 1")
def column_histogram(spark, sf):
    return analytics.column_histogram(calls(spark, sf), 1000, 30_000, 500).select(F.col("bin").cast("long").alias("bin"), "n")


@query(CALLS + " SELECT bin, bin * 5001 AS lo, (bin + 1) * 5001 - 1 AS hi, count(*) AS n FROM (SELECT unnest(range(least(col_begin // 5001, 19), least(col_end // 5001, 19) + 1)) AS bin FROM calls) GROUP BY bin")
def interval_histogram(spark, sf):
    return analytics.interval_histogram(calls(spark, sf), 100_001, 20)


@query()
def equi_load_bins(spark, sf):
    return analytics.equi_load_bins(analytics.column_histogram(calls(spark, sf), 0, 1_000_000, 200), 7)


@query(MERGED + " SELECT contig, s, t, any_value(mref) AS ref, array_to_string(any_value(malt), '|') AS alts, CAST(len(any_value(malt)) AS BIGINT) AS n_alt FROM merged GROUP BY contig, s, t ORDER BY n_alt DESC, s LIMIT 25")
def topk_allele_sites(spark, sf):
    return variants.top_allele_sites(calls(spark, sf), 25).withColumn("n_alt", F.col("n_alt").cast("long"))


@query(CALLS + " SELECT row_idx, col_begin, ref FROM calls WHERE col_begin > 2000 AND col_begin <= (SELECT max(col_begin) FROM (SELECT col_begin FROM calls WHERE col_begin > 2000 ORDER BY col_begin LIMIT 50))")
def page_keyset(spark, sf):
    return variants.page(calls(spark, sf).select("row_idx", "col_begin", "ref"), 50, "2000")[0]


@query(MERGED + f", p AS (SELECT contig, s, t, {PL_SQL} AS pls FROM merged), u AS (SELECT contig, s, t, unnest(range(0, len(pls))) AS genotype, unnest(pls) AS x FROM p) SELECT contig, s, t, genotype, list(x ORDER BY x DESC)[count(*) // 2 + 1] AS median_pl FROM u WHERE x IS NOT NULL GROUP BY ALL")
def dummy_genotyping_median(spark, sf):
    return variants.dummy_genotyping(calls(spark, sf)).select("contig", "s", "t", F.col("genotype").cast("long").alias("genotype"), F.col("median_pl").cast("long").alias("median_pl"))


@query(CALLS + " SELECT row_idx, col_begin, idx, q // 3 + CASE WHEN idx < q % 3 THEN 1 ELSE 0 END AS part FROM (SELECT *, unnest([0, 1, 2]) AS idx FROM calls)")
def multi_sample_divide(spark, sf):
    from locusweave.sources.vcf import divide

    c = calls(spark, sf).withColumn("idx", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    return c.select("row_idx", "col_begin", "idx", divide(F.col("q"), F.col("idx"), 3).cast("long").alias("part"))


@query(CALLS + " SELECT row_idx, col_begin, col_end FROM calls WHERE row_idx BETWEEN 2 AND 5 AND col_end >= 5000 AND col_begin <= 24999")
def load_partition(spark, sf):
    return intervals.load_partition(calls(spark, sf), 5000, 24_999, True, 5, 2).select("row_idx", "col_begin", "col_end")


@query(SWEEP + " SELECT contig, s, row_idx, CASE WHEN col_begin < s THEN 'N' ELSE ref END AS ref FROM active")
def reference_in_the_middle(spark, sf):
    found = intervals.sweep(calls(spark, sf), fields=["col_begin", "ref"])
    return found.select("contig", "s", "row_idx", F.when(F.col("col_begin") < F.col("s"), F.lit("N")).otherwise(F.col("ref")).alias("ref"))


@query(MERGED + ", f AS (SELECT DISTINCT contig, s, t, mref FROM merged) SELECT contig, s, CASE WHEN mref = 'N' THEN substr('ACGT', CAST((s * 7) % 4 + 1 AS INT), 1) ELSE mref END AS ref FROM f")
def reference_fill(spark, sf):
    merged = merge.merged_refs(calls(spark, sf), SPEC)
    bases = merged.select("contig", F.col("s").alias("pos"), F.expr("lower(substr('ACGT', cast((s * 7) % 4 + 1 as int), 1))").alias("base"))
    return merge.fill_reference(merged, bases).select("contig", "s", "ref")


@query(CALLS + f" SELECT row_idx, col_begin, {sql_text('list_transform([0, 2, 1], lambda i: ad[i + 1])')} AS v FROM calls")
def pl_remap_haploid(spark, sf):
    return calls(spark, sf).select("row_idx", "col_begin", text(A.remap_haploid(F.col("ad"), F.array(*map(F.lit, (0, 2, 1))))).alias("v"))


@query(CALLS + " SELECT row_idx, col_begin, CASE WHEN gt[1] > gt[2] THEN gt[1] * (gt[1] + 1) // 2 + gt[2] ELSE gt[2] * (gt[2] + 1) // 2 + gt[1] END AS i FROM calls")
def genotype_index(spark, sf):
    return calls(spark, sf).select("row_idx", "col_begin", A.genotype_index(F.col("gt")).alias("i"))


@query(SWEEP + ", e AS (SELECT contig, s, t, i, j, sum(x) AS x FROM (SELECT contig, s, t, unnest([0, 0, 1]) AS i, unnest([0, 1, 0]) AS j, unnest([k % 7, q, k % 5]) AS x FROM active) GROUP BY ALL), r AS (SELECT contig, s, t, i, string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS y FROM e GROUP BY ALL) SELECT contig, s, t, string_agg(y, '|' ORDER BY i) AS v FROM r GROUP BY ALL")
def info_elementwise_sum_2d(spark, sf):
    value = F.array(F.array(F.col("k") % 7, F.col("q")), F.array(F.col("k") % 5))
    out = combined(spark, sf, "element_wise_sum_2d", value, "long")
    return out.withColumn("v", F.array_join(F.transform("v", lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")), "|"))


@query(CALLS + " SELECT 'q' AS counter, count(q) AS n, CAST(sum(q) AS DOUBLE) AS total, CAST(sum(q * q) AS DOUBLE) AS total_squares, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS deviation FROM calls UNION ALL SELECT 'dp', count(dp), CAST(sum(dp) AS DOUBLE), CAST(sum(dp * dp) AS DOUBLE), round(avg(dp), 6), round(stddev_pop(dp), 6) FROM calls")
def profile_counters(spark, sf):
    p = analytics.profile(calls(spark, sf), "q", "dp")
    return p.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query(CALLS + " SELECT bin, bin * 5001 AS lo, (bin + 1) * 5001 - 1 AS hi, count(*) AS n FROM (SELECT unnest(range(least(col_begin // 5001, 19), least(col_end // 5001, 19) + 1)) AS bin FROM calls) GROUP BY bin")
def merged_histograms(spark, sf):
    c = calls(spark, sf)
    return analytics.merge_histograms(*(analytics.interval_histogram(c.where(f"row_idx % 2 = {i}"), 100_001, 20) for i in (0, 1)))


@query(CALLS + " SELECT DISTINCT contig || '.' || row_idx AS contig, col_begin AS pos, col_end FROM calls WHERE (contig = 'c0' AND row_idx = 1 AND col_begin <= 9000 AND col_end >= 4000) OR (contig = 'c0' AND row_idx = 3 AND col_begin <= 500 AND col_end >= 0)")
def region_restriction(spark, sf):
    regions = spark.createDataFrame([("c0.1", 4000, 9000), ("c0.1", 8000, 8500), ("c0.3", 0, 500)], "contig string, r_begin long, r_end long")
    return diff.in_regions(_record(calls(spark, sf)).select("contig", "pos", "col_end"), regions)


@query(CALLS + " SELECT value, 'only in test' AS kind FROM (SELECT DISTINCT contig AS value FROM calls) WHERE value <> 'c0' UNION ALL SELECT 'cx', 'only in gold'")
def contig_set_differences(spark, sf):
    c = calls(spark, sf).select("contig").distinct()
    gold = c.where("contig = 'c0'").unionByName(spark.createDataFrame([("cx",)], "contig string"))
    return diff.set_differences(gold, c, "contig")


@query(CALLS + " SELECT row_idx, col_begin, CASE WHEN row_idx = 1 THEN 'gold1' ELSE 'sample' || row_idx END AS sample FROM calls")
def sample_rename(spark, sf):
    names = spark.createDataFrame([("sample1", "gold1")], "test_name string, gold_name string")
    c = calls(spark, sf).select("row_idx", "col_begin", F.concat(F.lit("sample"), F.col("row_idx")).alias("sample"))
    return diff.rename_samples(c, names)


@query(CALLS + " SELECT row_idx, col_begin, array_to_string(list_transform(gt, lambda a: CAST(a AS VARCHAR)), '/') AS plain, CAST(gt[1] AS VARCHAR) || '|' || CAST(gt[2] AS VARCHAR) AS phased, './.' AS missing FROM calls")
def gt_encoding(spark, sf):
    gt = F.col("gt")
    return calls(spark, sf).select("row_idx", "col_begin", merge.encode_gt(gt).alias("plain"), merge.encode_gt(gt, F.array(F.lit(True))).alias("phased"), merge.encode_gt(gt, produce=False).alias("missing"))


@query(CALLS + f""", f AS (SELECT interval_id, row_idx, col_begin, col_end FROM trunc JOIN {Q} ON col_begin <= qe AND eff_end >= qb)
SELECT interval_id, string_agg(row_idx, ',' ORDER BY col_begin, row_idx) AS indices, string_agg(col_begin + 1, ',' ORDER BY col_begin, row_idx) AS positions, string_agg(col_end + 1, ',' ORDER BY col_begin, row_idx) AS ends FROM f GROUP BY interval_id""")
def column_vectors(spark, sf):
    found = intervals.overlap(calls(spark, sf), query_intervals(spark)).withColumn("offset", F.lit(0).cast("long"))
    v = sinks.column_vectors(found, ["ref"])
    return v.select("interval_id", text("indices").alias("indices"), text("POSITION").alias("positions"), text("END").alias("ends"))


# ------------------------------------------------------------------ files, differences, streams


CSV_SQL = "row_idx || ',' || col_begin || ',' || col_end || ',' || ref || ',' || array_to_string(list_transform(alt, lambda a: CASE WHEN a = '<NON_REF>' THEN '&' ELSE a END), '|') || ',' || coalesce(CAST(dp AS VARCHAR), '') || ',' || len(pl) || ',' || array_to_string(pl, ',') || ',' || len(gt) || ',' || array_to_string(gt, ',')"
CSV_FIELDS = [("dp", "int", "1"), ("pl", "int", "G"), ("gt", "int", "P")]


@query(CALLS + f" SELECT {CSV_SQL} AS line FROM calls")
def csv_export(spark, sf):
    return csv_cells.to_lines(calls(spark, sf), CSV_FIELDS, standard=False)


@query(CALLS + f" SELECT row_idx, col_begin, col_end, ref, {sql_text('alt')} AS alts, CAST(dp AS BIGINT) AS dp, {sql_text('pl')} AS pls, {sql_text('gt')} AS gts FROM calls")
def csv_roundtrip(spark, sf):
    back = csv_cells.parse(csv_cells.to_lines(calls(spark, sf), CSV_FIELDS, standard=False), CSV_FIELDS, standard=False)
    return back.select("row_idx", "col_begin", "col_end", "ref", text("alt").alias("alts"), F.col("dp").cast("long").alias("dp"), text("pl").alias("pls"), text("gt").alias("gts"))


def _record(c: DataFrame) -> DataFrame:
    return c.select(F.concat("contig", F.lit("."), F.col("row_idx").cast("string")).alias("contig"), F.col("col_begin").alias("pos"), "col_end", "ref", "alt", F.col("rank_sum").alias("qual"), "ad", "pl")


@query(CALLS + " SELECT contig, col_begin AS pos, ref AS kind, ref AS field FROM calls WHERE false")
def vcf_diff_self(spark, sf):
    r = _record(calls(spark, sf))
    return diff.diff(r, r)


@query(CALLS + """ SELECT contig || '.' || row_idx AS contig, col_begin AS pos, 'only in gold' AS kind, '' AS field FROM calls WHERE k % 50 = 3
UNION ALL SELECT contig || '.' || row_idx, col_begin, 'differs', 'qual' FROM calls WHERE k % 50 = 7""")
def vcf_diff_perturbed(spark, sf):
    c = calls(spark, sf)
    test = c.where("k % 50 <> 3").withColumn("rank_sum", F.when(F.col("k") % 50 == 7, F.col("rank_sum") + 100).otherwise(F.col("rank_sum")))
    swap = (F.col("kind") == 3) & (F.col("k") % 50 == 11)  # alleles in another order are no difference
    src = F.array(*map(F.lit, (0, 2, 1, 3)))
    test = test.withColumns({"alt": F.when(swap, F.array(F.get("alt", F.lit(1)), F.get("alt", F.lit(0)), F.get("alt", F.lit(2)))).otherwise(F.col("alt")), "ad": F.when(swap, A.remap_alleles(F.col("ad"), src)).otherwise(F.col("ad")), "pl": F.when(swap, A.remap_diploid(F.col("pl"), src)).otherwise(F.col("pl"))})
    return diff.diff(_record(c), _record(test))


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_append_equals_batch(spark, sf):
    return ingest.append_all(spark, f"{sf}/events.parquet").select("event_id", "user_id", "event_type", "value")
