"""Combine VCF files from the command line: python -m locusweave --fields FIELDS.json --out FOLDER FILE.vcf..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from locusweave.operators.merge import MOVED, Spec, combine_gvcf
from locusweave.sources import metadata, vcf


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="locusweave")
    p.add_argument("files", nargs="+")
    p.add_argument("--fields", help="field configuration (else from the files' headers)")
    p.add_argument("--out", required=True)
    p.add_argument("--interval", action="append", help="contig:begin-end; several: only calls that reach into one of them are read")
    p.add_argument("--sites-only", action="store_true")
    p.add_argument("--no-gt", action="store_true", help="all genotypes missing")
    p.add_argument("--no-filter", action="store_true", help="no filters")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    fields, contigs = metadata.fields_from_header(spark, a.files)
    if a.fields:
        config = metadata.read_config(a.fields)
        fields, contigs = metadata.fields(config), [(r.name, r.length, r.offset) for r in metadata.contigs(spark, config).collect()]
    table = spark.createDataFrame(contigs, "name string, length long, offset long")
    asked = metadata.parse_intervals(a.interval, contigs) if a.interval else None
    samples: dict[str, int] = {}
    parts = []
    for path in a.files:
        names = vcf.read_lines(spark, path)[1]
        if twice := [n for n in names if n in samples]:
            raise ValueError(f"samples {', '.join(twice)} are in more than one file")
        rows = {n: len(samples) + i for i, n in enumerate(names)}
        samples |= rows
        parts.append(vcf.read_vcf(spark, path, fields, table, rows, divided=vcf.summed_fields(fields), within=asked if asked and len(asked) > 1 else None))
    calls = parts[0]
    for part in parts[1:]:
        calls = calls.unionByName(part)
    calls = calls.withColumnsRenamed({"AD": "ad", "PL": "pl", "GQ": "gq", "SB": "sb", "DP": "dp", "DP_FORMAT": "dp_format", "MIN_DP": "min_dp"})
    for name, kind in (("ad", "array<int>"), ("pl", "array<int>"), ("dp", "int"), ("dp_format", "int"), ("min_dp", "int")):
        if name not in calls.columns:
            calls = calls.withColumn(name, F.lit(None).cast(kind))
    ops = {n: (f["combine"], "float" if f["types"][0] == "float" else "long") for n, f in fields.items() if "INFO" in f["classes"] and f["combine"] not in (None, "DP") and n in calls.columns}
    begin, end = asked[0][1:] if asked and len(asked) == 1 else (None, None)
    records = combine_gvcf(calls, Spec(info=ops), begin, end)
    order = sorted(samples, key=samples.get)
    formats = {} if a.sites_only else {"GT": "gt", "GQ": "gq", "SB": "sb", "AD": "ad", "PL": "pl", "MIN_DP": "min_dp", "DP": "dp_format"}
    moved = [n for n, (op, _) in ops.items() if op == MOVED]
    formats |= {} if a.sites_only else {n: n for n in moved}
    vcf.write_vcf(records, a.out, [] if a.sites_only else order, table, {n: n for n in ops if n not in moved} | {"DP": "dp"}, formats, fields, not a.no_gt, not a.no_filter)


if __name__ == "__main__":
    main()
