"""Where calls and variants go: Parquet tables, JSON and CSV text, partitions, and the upkeep of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.operators.intervals import BIN


def write_calls(calls: DataFrame, path: str, mode: str = "append", width: int = 100 * BIN) -> None:
    """A table partitioned by contig and position, sorted inside its files: interval queries read few of them. Rows are
    dealt by (contig, bin) first, so that each partition is written by few tasks."""
    binned = calls.withColumn("bin", F.expr(f"col_begin div {width}"))
    binned.repartition("contig", "bin").sortWithinPartitions("contig", "bin", "col_begin", "row_idx").write.mode(mode).partitionBy("contig", "bin").parquet(path)


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, rows: list[int] | None = None, begin: int | None = None, end: int | None = None, longest: int | None = None, width: int = 100 * BIN) -> DataFrame:
    """Calls of a table: column pruning, row filters, and (if the longest interval is known) partition pruning by bin."""
    df = spark.read.parquet(path)
    if begin is not None:
        df = df.where((F.col("col_begin") <= end) & (F.col("col_end") >= begin) & (F.col("bin") <= end // width))
        if longest is not None:
            df = df.where(F.col("bin") >= max(0, begin - longest) // width)
    if rows is not None:
        df = df.where(F.col("row_idx").isin(rows))
    return df.select(columns) if columns else df.drop("bin")


def features(spark: SparkSession, path: str, contigs: DataFrame, contig: str | None = None, start: int = 1, end: int | None = None, longest: int | None = None) -> DataFrame:
    """Calls of a table by contig (in the contigs' order), then start: all of them, or those that overlap start to end
    (from 1, inclusive) of one contig, with `start` and `end` on their contig. contigs: name, offset, length."""
    place = contigs.select(F.col("name").alias("contig"), "offset", "length")
    if contig is None:
        calls = scan(spark, path)
    else:
        at = place.where(F.col("contig") == contig).first()
        if at is None:
            return scan(spark, path).where("false").join(F.broadcast(place.drop("length")), "contig").withColumns({"start": F.lit(0).cast("long"), "end": F.lit(0).cast("long")}).drop("offset")
        calls = scan(spark, path, None, None, at.offset + start - 1, at.offset + (end or at.length) - 1, longest).where(F.col("contig") == contig)
    found = calls.join(F.broadcast(place.drop("length")), "contig").withColumns({"start": F.col("col_begin") - F.col("offset") + 1, "end": F.col("col_end") - F.col("offset") + 1})
    return found.orderBy("offset", "col_begin", "row_idx").drop("offset")


def compact(spark: SparkSession, path: str, to: str, width: int = 100 * BIN) -> None:
    """Rewrite a table that grew by many small appends."""
    write_calls(spark.read.parquet(path).drop("bin"), to, "overwrite", width)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_workspace(spark: SparkSession, path: str) -> bool:
    """Make a folder for tables; False if it is there."""
    fs, p = _path(spark, path)
    return False if fs.exists(p) else bool(fs.mkdirs(p))


def list_tables(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and is_table(spark, s.getPath().toString()))


def is_table(spark: SparkSession, path: str) -> bool:
    fs, _ = _path(spark, path)
    return bool(fs.exists(_path(spark, f"{path}/_SUCCESS")[1]))


def drop_table(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.delete(p, True))


def calls_json(calls: DataFrame, fields: list[str]) -> DataFrame:
    """interval_id, json: per query interval (qb, qe) the list of its calls in column-major order; absent fields are left
    out. calls: intervals.overlap of calls with contig and offset."""
    genomic = F.create_map(F.col("contig"), F.array(F.col("col_begin") - F.col("offset") + 1, F.col("col_end") - F.col("offset") + 1))
    shown = F.struct(*(F.col(c).alias(n) for n, c in _names(fields)))
    one = F.struct(F.col("col_begin").alias("_b"), F.col("row_idx").alias("row"), F.array("col_begin", "col_end").alias("interval"), genomic.alias("genomic_interval"), shown.alias("fields"))
    # maps can't be compared, so the calls are ordered by a sort of their keys
    listed = calls.select("interval_id", "qb", "qe", F.struct("col_begin", "row_idx", F.to_json(one).alias("j")).alias("c")).groupBy("interval_id", "qb", "qe").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    body = F.array_join(F.transform("cs", lambda c: F.regexp_replace(c["j"], r'^\{"_b":\d+,', "{")), ",")
    return listed.select("interval_id", F.concat(F.lit('{"query_interval":['), F.col("qb").cast("string"), F.lit(","), F.col("qe").cast("string"), F.lit('],"variant_calls":['), body, F.lit("]}")).alias("json"))


def _names(fields: list[str]) -> list[tuple[str, str]]:
    return [(f.upper() if f in ("ref", "alt", "gt", "id", "qual", "filter") else f, f) for f in fields]


def _fixed(c: Column, kind) -> Column:
    """Numbers with a fraction get six digits; lists of a single element stay lists."""
    if kind.typeName() == "array":
        return F.transform(c, lambda x: _fixed(x, kind.elementType)) if kind.elementType.typeName() in ("float", "double") else c
    return c.cast("decimal(38, 6)") if kind.typeName() in ("float", "double") else c


def variants_json(variants: DataFrame, contigs: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """interval_id, number, json: one object per variant with its interval, in columns and on its contig (from 1), the
    common fields asked for and its calls; absent fields are left out. contigs: name, offset."""
    v = variants.join(F.broadcast(contigs.select(F.col("name").alias("contig"), "offset")), "contig")
    where = lambda b, e: {"interval": F.array(b, e), "genomic_interval": F.create_map(F.col("contig"), F.array(b - F.col("offset") + 1, e - F.col("offset") + 1))}
    kinds = {f.name: f.dataType for f in variants.schema["calls"].dataType.elementType.fields}
    shown = [(n, c) for n, c in _names([k for k in kinds if k not in ("mine", "source", "row_idx", "col_begin", "col_end")])]

    def call(c: Column) -> Column:
        place = where(c["col_begin"], c["col_end"]) if {"col_begin", "col_end"} <= set(kinds) else where(F.col("col_begin"), F.col("eff_end"))
        fields = F.struct(*(_fixed(c[k], kinds[k]).alias(n) for n, k in shown))
        return F.struct(c["row_idx"].alias("row"), *(x.alias(n) for n, x in place.items()), fields.alias("fields"))

    place = [x.alias(n) for n, x in where(F.col("col_begin"), F.col("eff_end")).items()]
    shared = F.struct(*(F.col(k).alias(n) for n, k in _names(list(common)))) if common else F.create_map().cast("map<string, string>")
    return v.select("interval_id", "number", F.to_json(F.struct(*place, shared.alias("common_fields"), F.transform("calls", call).alias("variant_calls"))).alias("json"))


def column_vectors(calls: DataFrame, fields: list[str], by: str = "interval_id") -> DataFrame:
    """by, indices, POSITION, END and a parallel array per field, positions from 1 within the contig (offset)."""
    rows = F.struct("col_begin", "row_idx", F.col("col_end").alias("_e"), F.col("offset").alias("_o"), *fields)
    g = calls.groupBy(by).agg(F.array_sort(F.collect_list(rows)).alias("cs"))
    pick = lambda f: F.transform("cs", f)
    return g.select(by, pick(lambda c: c["row_idx"]).alias("indices"), pick(lambda c: c["col_begin"] - c["_o"] + 1).alias("POSITION"), pick(lambda c: c["_e"] - c["_o"] + 1).alias("END"), *(pick(_field(n)).alias(n) for n in fields))


def _field(name: str):
    return lambda c: c[name]


def positions_json(calls: DataFrame, fields: list[str]) -> DataFrame:
    """contig, json: a map from "start" or "start_end" to the column vectors of the calls there."""
    start, end = F.col("col_begin") - F.col("offset") + 1, F.col("col_end") - F.col("offset") + 1
    key = F.when(end > start, F.concat_ws("_", start.cast("string"), end.cast("string"))).otherwise(start.cast("string"))
    at = column_vectors(calls.withColumn("_k", F.concat_ws("\t", "contig", key)), fields, "_k")
    split = at.select(F.split("_k", "\t")[0].alias("contig"), F.split("_k", "\t")[1].alias("_p"), F.struct("indices", *fields).alias("v"))
    return split.groupBy("contig").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_p", "v"))))).alias("json"))


def split_by_partition(calls: DataFrame, partitions: DataFrame, path: str) -> None:
    """One folder of calls per column partition (pid, p_begin, p_end); those that reach into several are in each."""
    from locusweave.operators.intervals import partition_cells

    partition_cells(calls, partitions).repartition("pid").write.mode("overwrite").partitionBy("pid").parquet(path)


def offsets(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    """With each call's contig offset."""
    return calls.join(F.broadcast(contigs.select(F.col("name").alias("contig"), "offset")), "contig")


def text_of(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
