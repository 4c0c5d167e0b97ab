"""Cells as CSV lines: row, begin, end, REF, ALT (`|`-joined, NON_REF as `&`), and, in the standard layout, QUAL and the
number of filters with the filters; then the attributes in order. Arrays are preceded by their number of elements, text
is bare, nothing is null (and an empty array `0`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.functions.alleles import NON_REF

#: (name, type, length) with length 1, a number, or A, R, G, P, VAR.
Field = tuple[str, str, str]


def to_lines(calls: DataFrame, fields: list[Field], standard: bool = True) -> DataFrame:
    """One column, line."""
    alt = F.array_join(F.transform("alt", lambda a: F.when(a == NON_REF, "&").otherwise(a)), "|")
    out = [F.col(c).cast("string") for c in ("row_idx", "col_begin", "col_end", "ref")] + [alt]
    if standard:
        filters = F.coalesce(F.col("filter"), F.array().cast("array<string>"))
        out += [F.col("qual").cast("string"), F.when(F.size(filters) > 0, F.concat(F.size(filters).cast("string"), F.lit(","), F.array_join(filters, ","))).otherwise(F.lit("0"))]
    for name, kind, length in fields:
        if length == "1" or kind == "string":
            out.append(F.col(name).cast("string"))
        elif length.isdigit():
            n = int(length)
            out.append(F.array_join(_fixed(name, n), ","))
        else:
            listed = F.array_join(F.transform(name, lambda x: F.coalesce(x.cast("string"), F.lit(""))), ",")
            out.append(F.when(F.size(name) > 0, F.concat(F.size(name).cast("string"), F.lit(","), listed)).otherwise(F.lit("0")))
    return calls.select(F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in out)).alias("line"))


def _fixed(name: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(F.col(name), i).cast("string"), F.lit("")))


def parse(lines: DataFrame, fields: list[Field], standard: bool = True) -> DataFrame:
    """Cells of lines (column line). The place of each field depends on the counts before it, so every field's start is a
    column computed from the one before."""
    out = lines.withColumn("_t", F.split("line", ",", -1))
    token = lambda at: F.get("_t", at)
    out = out.withColumns({"row_idx": token(F.lit(0)).cast("long"), "col_begin": token(F.lit(1)).cast("long"), "col_end": token(F.lit(2)).cast("long"), "ref": token(F.lit(3)), "alt": F.transform(F.split(token(F.lit(4)), "\\|"), lambda a: F.when(a == "&", NON_REF).otherwise(a))})
    kept, at = ["row_idx", "col_begin", "col_end", "ref", "alt"], F.lit(5)
    if standard:
        n = F.expr("try_cast(get(_t, 6) as int)")
        out = out.withColumns({"qual": F.expr("try_cast(get(_t, 5) as float)"), "filter": F.when(n > 0, F.slice("_t", F.lit(8), n)), "_at": F.lit(7) + F.coalesce(n, F.lit(0))})
        kept, at = [*kept, "qual", "filter"], F.col("_at")
    for name, kind, length in fields:
        out = out.withColumn("_here", at)
        one = F.nullif(token(F.col("_here")), F.lit(""))
        if length == "1" or kind == "string":
            out = out.withColumn(name, one.try_cast(kind)).withColumn("_at", F.col("_here") + 1)
        else:
            n = F.lit(int(length)) if length.isdigit() else F.coalesce(one.try_cast("int"), F.lit(0))
            start = F.col("_here") + (1 if length.isdigit() else 2)
            got = _typed(F.slice("_t", start, n), kind)
            present = (n > 0) & F.exists(got, lambda x: x.isNotNull())
            out = out.withColumn(name, F.when(present, got)).withColumn("_at", start - 1 + n)
        kept.append(name)
        at = F.col("_at")
    return out.select(kept)


def _typed(tokens: Column, kind: str) -> Column:
    return F.transform(tokens, lambda x: F.nullif(x, F.lit("")).try_cast(kind))


def read(spark: SparkSession, path: str, fields: list[Field], standard: bool = True) -> DataFrame:
    """Cells of CSV files; unsorted files are sorted by partition as a load needs it."""
    lines = spark.read.text(path).where("value <> ''").withColumnRenamed("value", "line")
    return parse(lines, fields, standard)
