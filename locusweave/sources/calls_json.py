"""Calls from the JSON that lists them per query interval."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: JSON field -> (column, type). Fixed values.
FIELDS = {
    "REF": ("ref", "string"), "ALT": ("alt", "array<string>"), "GT": ("gt", "array<int>"), "GQ": ("gq", "int"), "PL": ("pl", "array<int>"), "AD": ("ad", "array<int>"), "SB": ("sb", "array<int>"),
    "DP": ("dp", "int"), "DP_FORMAT": ("dp_format", "int"), "MIN_DP": ("min_dp", "int"), "PGT": ("pgt", "string"), "PID": ("pid", "string"), "ID": ("id", "string"),
    "BaseQRankSum": ("BaseQRankSum", "float"), "ClippingRankSum": ("ClippingRankSum", "float"), "MQRankSum": ("MQRankSum", "float"), "ReadPosRankSum": ("ReadPosRankSum", "float"),
    "MQ": ("MQ", "float"), "RAW_MQ": ("RAW_MQ", "float"), "MQ0": ("MQ0", "int"), "QUAL": ("qual", "float"), "FILTER": ("filter", "array<string>"),
}


def read_calls_json(spark: SparkSession, path: str) -> DataFrame:
    """Calls (row_idx, contig, col_begin, col_end and FIELDS); what a call doesn't list is null. Calls that several
    intervals list come once."""
    types = ", ".join(f"`{n}`: {t}" for n, (_, t) in FIELDS.items())
    call = f"struct<row: bigint, interval: array<bigint>, genomic_interval: map<string, array<bigint>>, fields: struct<{types}>>"
    schema = f"variant_calls array<struct<query_interval: array<bigint>, variant_calls: array<{call}>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    each = raw.select(F.explode("variant_calls").alias("q")).select(F.explode("q.variant_calls").alias("c"))
    flat = each.select(F.col("c.row").alias("row_idx"), F.map_keys("c.genomic_interval")[0].alias("contig"), F.col("c.interval")[0].alias("col_begin"), F.col("c.interval")[1].alias("col_end"), *(F.col(f"c.fields.{n}").alias(c) for n, (c, _) in FIELDS.items()))
    return flat.dropDuplicates(["row_idx", "col_begin"])


def load(path: str) -> dict:
    with open(path) as f:
        return json.load(f)
