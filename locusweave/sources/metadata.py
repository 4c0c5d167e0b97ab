"""Contigs, call sets, fields and query intervals: small dimension tables and the configurations they come from."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAST = 2**63 - 2

#: Length descriptors of known fields where a configuration names none. Fixed values.
KNOWN_LENGTHS = {"AF": "A", "AC": "A", "AD": "R", "PL": "G", "GT": "PP", "SB": "4", "PGT": "VAR", "PID": "VAR", "REF": "VAR", "ALT": "VAR", "FILTER": "VAR"}
#: Combine operations of known fields. Fixed values.
KNOWN_COMBINE = {"BaseQRankSum": "median", "ClippingRankSum": "median", "MQRankSum": "median", "ReadPosRankSum": "median", "MQ": "median", "MQ0": "median", "ExcessHet": "median", "RAW_MQ": "sum", "DP": "DP"}
TYPES = {"int": "int", "integer": "int", "float": "float", "bool": "boolean", "boolean": "boolean", "flag": "boolean", "string": "string", "char": "string"}


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text())


def contigs(spark: SparkSession, config: dict) -> DataFrame:
    """name, length, offset."""
    found = config["contigs"]
    rows = [(n, int(c["length"]), int(c["tiledb_column_offset"])) for n, c in (found.items() if isinstance(found, dict) else ((c["name"], c) for c in found))]
    return spark.createDataFrame(rows, "name string, length long, offset long")


def contig_offsets(lengths: DataFrame) -> DataFrame:
    """idx, name, length -> with offset: the lengths before it, summed. A dimension table's window."""
    return lengths.withColumn("offset", F.sum("length").over(Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def callsets(spark: SparkSession, config: dict) -> DataFrame:
    """name, row_idx, idx_in_file, filename."""
    found = config["callsets"]
    rows = [(n, int(c["row_idx"]), int(c.get("idx_in_file", 0)), c.get("filename")) for n, c in (found.items() if isinstance(found, dict) else ((c["sample_name"], c) for c in found))]
    return spark.createDataFrame(rows, "name string, row_idx long, idx_in_file long, filename string")


def assign_rows(names: DataFrame, first: int = 0) -> DataFrame:
    """name -> with row_idx: consecutive in the order of names, from `first`."""
    return names.select("name").distinct().withColumn("row_idx", F.row_number().over(Window.orderBy("name")) - 1 + first)


def fields(config: dict) -> dict[str, dict]:
    """Field name -> vcf_name, classes, types, length, delimiters, combine."""
    out = {}
    found = config["fields"]
    for name, f in found.items() if isinstance(found, dict) else ((f["name"], f) for f in found):
        kinds = f.get("type", "int")
        kinds = [kinds] if isinstance(kinds, str) else list(kinds)
        length = f.get("length", KNOWN_LENGTHS.get(name, "1"))
        length = [str(x).upper() if not isinstance(x, dict) else str(x.get("variable_length_descriptor", x.get("fixed_length"))).upper() for x in (length if isinstance(length, list) else [length])]
        out[name] = {
            "vcf_name": f.get("vcf_name", name), "classes": [c.upper() for c in f.get("vcf_field_class", ["INFO"])], "types": [TYPES.get(str(k).lower(), "string") for k in kinds],
            "length": length, "delimiters": f.get("vcf_delimiter", ["|", ","]), "combine": f.get("VCF_field_combine_operation", KNOWN_COMBINE.get(name)),
        }
    return out


def to_column(df: DataFrame, contigs_: DataFrame, contig: str = "contig", pos: str = "pos") -> DataFrame:
    """With column: contig offset plus a position from 0; rows past their contig's end, or of no contig, are dropped."""
    c = F.broadcast(contigs_.select(F.col("name").alias("_name"), "length", "offset"))
    return df.join(c, F.col(contig) == F.col("_name")).where(F.col(pos) < F.col("length")).withColumn("column", F.col("offset") + F.col(pos)).drop("_name", "length", "offset")


def with_contig(df: DataFrame, column: str, contigs_: DataFrame, width: int | None = None) -> DataFrame:
    """With contig and contig_pos (from 0): the contig that a position lies in. The contigs are a dimension table of a
    few thousand rows; a binned equi-join keeps it from being compared row by row."""
    width = width or 10_000_000
    bins = contigs_.select("name", "length", "offset", F.explode(F.sequence(F.expr(f"offset div {width}"), F.expr(f"(offset + length - 1) div {width}"))).alias("_bin"))
    met = df.withColumn("_bin", F.expr(f"{column} div {width}")).join(bins, "_bin").where(f"{column} >= offset and {column} < offset + length")
    return met.withColumn("contig_pos", F.col(column) - F.col("offset")).withColumnRenamed("name", "contig").drop("_bin", "length", "offset")


def with_sample(df: DataFrame, callsets_: DataFrame) -> DataFrame:
    """With sample: the call set's name, by row_idx."""
    return df.join(callsets_.select("row_idx", F.col("name").alias("sample")), "row_idx")


def parse_intervals(spec: list, contigs_: list[tuple[str, int, int]]) -> list[tuple[int, int, int]]:
    """Query intervals (interval_id, begin, end), sorted by begin, from [b, e], b, "contig", {"contig": pos} and
    {"contig": [b, e]} (contig positions from 1). Reversed bounds are swapped; a begin past the contig's end is an
    error, an end past it is clamped; "contig:b-e" is understood too."""
    known = {n: (length, offset) for n, length, offset in contigs_}
    out = []

    def within(name: str, b: int, e: int) -> tuple[int, int]:
        if name not in known:
            raise ValueError(f"unknown contig {name}")
        length, offset = known[name]
        b, e = min(b, e), max(b, e)
        if b > length or b < 1:
            raise ValueError(f"{name} has no position {b}")
        return offset + b - 1, offset + min(e, length) - 1

    for x in spec:
        if isinstance(x, int):
            out.append((x, x))
        elif isinstance(x, str):
            name, _, span = x.partition(":")
            if span:
                b, _, e = span.partition("-")
                out.append(within(name, int(b), int(e or b)))
            else:
                out.append(within(name, 1, known[name][0] if name in known else 1))
        elif isinstance(x, dict):
            for name, span in x.items():
                b, e = span if isinstance(span, list) else (span, span)
                out.append(within(name, b, e))
        else:
            b, e = (x[0], x[-1])
            if min(b, e) < 0 or max(b, e) > LAST:
                raise ValueError(f"interval {x} is out of bounds")
            out.append((min(b, e), max(b, e)))
    return [(i, b, e) for i, (b, e) in enumerate(sorted(out))]


def intervals(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "interval_id int, qb long, qe long")


def partitions(begins: list[dict]) -> list[tuple[int, int, int]]:
    """(pid, begin, end) from column partitions; one without end reaches to before the next begin."""
    found = sorted(begins, key=lambda p: p["begin"])
    ends = [p["begin"] - 1 for p in found[1:]] + [LAST]
    return [(i, p["begin"], min(p.get("end", e), e)) for i, (p, e) in enumerate(zip(found, ends, strict=True))]


#: Allele-specific annotations: INFO names whose values are lists per allele. Fixed values.
ALLELE_SPECIFIC = {"AS_RAW_MQ": ["R", "VAR"], "AS_QUALapprox": ["R"], "AS_VarDP": ["R"], "AS_SB_TABLE": ["R", "VAR"]}


def fields_from_header(spark: SparkSession, path: str) -> tuple[dict[str, dict], list[tuple[str, int, int]]]:
    """Field configuration and contigs (name, length, offset) from the header lines of VCF files, merged: a field that
    several classes declare has them all. Only header lines reach the driver."""
    import re

    lines = [r.value for r in spark.read.text(path).where(F.col("value").startswith("##")).distinct().orderBy("value").collect()]
    found: dict[str, dict] = {}
    lengths: dict[str, int] = {}
    for line in lines:
        m = re.match(r"##(INFO|FORMAT|FILTER|contig)=<(.*)>$", line)
        if not m:
            continue
        kv = dict(re.findall(r'(\w+)=("[^"]*"|[^,]*)', m[2]))
        if m[1] == "contig":
            lengths[kv["ID"]] = int(kv.get("length", 0))
            continue
        f = found.setdefault(kv["ID"], {"vcf_field_class": [], "type": kv.get("Type", "String").lower(), "length": {".": "VAR"}.get(kv.get("Number", "1"), kv.get("Number", "1"))})
        f["vcf_field_class"] = sorted({*f["vcf_field_class"], m[1]})
        if kv["ID"] == "GT":
            f["length"] = "PP"
        if kv["ID"] in ALLELE_SPECIFIC:
            f["length"] = ALLELE_SPECIFIC[kv["ID"]]
        if kv["ID"] in KNOWN_COMBINE and "INFO" in f["vcf_field_class"]:
            f["VCF_field_combine_operation"] = KNOWN_COMBINE[kv["ID"]]
    out, offset = [], 0
    for name, length in lengths.items():
        out.append((name, length, offset))
        offset += length
    return fields({"fields": found}), out


def read_metadata_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A dimension table kept in a database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
