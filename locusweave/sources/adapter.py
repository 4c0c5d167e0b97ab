"""A call set derived from the driver's lineitem table, for queries that need one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIG = 20_000


def _base(i: str) -> str:
    return f"substr('ACGT', cast(((col_begin + {i}) * 7) % 4 + 1 as int), 1)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique by (row_idx, col_begin); kinds 0 to 3 are reference blocks, SNVs, deletions, deletions with insertions."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cells = lines.select((F.col("l_suppkey") % 8).alias("row_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("col_begin"), F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("q"))
    # dealt once, as what follows needs them: a sample's calls of a contig together
    dealt = cells.withColumn("contig", F.expr(f"concat('c', col_begin div {CONTIG})")).repartition("row_idx", "contig")
    g = dealt.groupBy("row_idx", "contig", "col_begin").agg(F.min("k").alias("k"), F.min("q").alias("q"))
    h = g.selectExpr("*", "k % 4 as kind", f"col_begin div {CONTIG} as contig_id")
    b0, b1, b2 = (_base(str(i)) for i in range(3))
    shaped = h.selectExpr(
        "row_idx", "col_begin", "k", "q", "kind", "contig_id", "contig",
        f"case kind when 2 then concat({b0}, {b1}, {b2}) when 3 then concat({b0}, {b1}) else {b0} end as ref",
        f"case kind when 0 then array('<NON_REF>') when 1 then array({b1}, '<NON_REF>') when 2 then array({b0}, '<NON_REF>') else array({b0}, concat({b0}, {b1}, {b2}), '<NON_REF>') end as alt",
        f"least(col_begin + case kind when 0 then q when 1 then 0 when 2 then 2 else 1 end, (contig_id + 1) * {CONTIG} - 1) as col_end",
    )
    return shaped.selectExpr(
        "*", "transform(sequence(0L, case kind when 0 then 2L when 3 then 9L else 5L end), i -> cast((k * (i + 3) + q * i * i) % 97 as int)) as pl",
        "transform(sequence(0L, case kind when 0 then 1L when 3 then 3L else 2L end), i -> cast((k + 7 * i) % 50 as int)) as ad",
        "case kind when 0 then array(0, 0) when 3 then array(1, 2) else array(cast(k % 2 as int), 1) end as gt",
        "cast((k % 41 - 20) / 8.0 as double) as rank_sum", "case when k % 3 > 0 then cast(q as int) end as dp", "cast(k % 60 as int) as dp_format", "case when kind = 0 then cast(q % 7 as int) end as min_dp",
        "case when k % 3 > 0 then concat('rs', k % 5, ';rs', q % 4) end as id", "array(concat('f', k % 3)) as filter",
    )


#: The same in DuckDB's SQL: common table expressions that queries put in front.
SQL = f"""
g AS (SELECT l_suppkey % 8 AS row_idx, l_orderkey * 8 + l_linenumber AS col_begin, min(l_partkey) AS k, min(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
h AS (SELECT *, k % 4 AS kind, col_begin // {CONTIG} AS contig_id FROM g),
calls AS (SELECT row_idx, col_begin, k, q, kind, contig_id, 'c' || contig_id AS contig,
    CASE kind WHEN 2 THEN {_base('0')} || {_base('1')} || {_base('2')} WHEN 3 THEN {_base('0')} || {_base('1')} ELSE {_base('0')} END AS ref,
    CASE kind WHEN 0 THEN ['<NON_REF>'] WHEN 1 THEN [{_base('1')}, '<NON_REF>'] WHEN 2 THEN [{_base('0')}, '<NON_REF>'] ELSE [{_base('0')}, {_base('0')} || {_base('1')} || {_base('2')}, '<NON_REF>'] END AS alt,
    least(col_begin + CASE kind WHEN 0 THEN q WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END, (contig_id + 1) * {CONTIG} - 1) AS col_end,
    list_transform(range(0, CASE kind WHEN 0 THEN 3 WHEN 3 THEN 10 ELSE 6 END), lambda i: (k * (i + 3) + q * i * i) % 97) AS pl,
    list_transform(range(0, CASE kind WHEN 0 THEN 2 WHEN 3 THEN 4 ELSE 3 END), lambda i: (k + 7 * i) % 50) AS ad,
    CASE kind WHEN 0 THEN [0, 0] WHEN 3 THEN [1, 2] ELSE [k % 2, 1] END AS gt,
    CAST((k % 41 - 20) / 8.0 AS DOUBLE) AS rank_sum, CASE WHEN k % 3 > 0 THEN q END AS dp, k % 60 AS dp_format, CASE WHEN kind = 0 THEN q % 7 END AS min_dp,
    CASE WHEN k % 3 > 0 THEN 'rs' || (k % 5) || ';rs' || (q % 4) END AS id, ['f' || (k % 3)] AS filter FROM h),
trunc AS (SELECT *, least(col_end, coalesce(lead(col_begin) OVER (PARTITION BY row_idx, contig ORDER BY col_begin) - 1, col_end)) AS eff_end, kind >= 2 AS has_del FROM calls)"""
SEGMENTS_SQL = """,
edges AS (SELECT DISTINCT contig, unnest(CASE WHEN has_del THEN range(col_begin, eff_end + 2) ELSE [col_begin, eff_end + 1] END) AS s FROM trunc),
segs AS (SELECT * FROM (SELECT contig, s, lead(s) OVER (PARTITION BY contig ORDER BY s) - 1 AS t FROM edges) WHERE t IS NOT NULL),
bsegs AS (SELECT *, s // 64 AS bin FROM segs),
bcalls AS (SELECT *, unnest(range(col_begin // 64, eff_end // 64 + 1)) AS bin FROM trunc),
active AS MATERIALIZED (SELECT c.* EXCLUDE (bin), s.s, s.t FROM bsegs s JOIN bcalls c ON s.contig = c.contig AND s.bin = c.bin AND c.col_begin <= s.s AND c.eff_end >= s.s)"""
