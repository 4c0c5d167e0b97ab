"""Calls from VCF text, and records back to it.

Lines are read with the text source (gzip and plain), split natively, and turned into one row per enabled sample: no
per-row Python. Field shapes come from a field configuration (metadata.fields)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusweave.functions.alleles import NON_REF, is_symbolic
from locusweave.operators.merge import encode_gt

#: Columns of a VCF line before the samples.
HEAD = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]


#: Combine operations that add up. Fixed values.
SUMMED = ("sum", "DP", "element_wise_sum", "histogram_sum")


def divide(value: Column, idx: Column, n: int) -> Column:
    """A whole number split over n samples: the first ones get one more."""
    return F.floor(value / n) + F.when(idx < value % n, 1).otherwise(0)


def summed_fields(fields: dict[str, dict]) -> tuple[str, ...]:
    """INFO fields that are summed when calls are combined, and so are divided among the samples of a file."""
    return tuple(n for n, f in fields.items() if "INFO" in f["classes"] and f["combine"] in SUMMED and f["types"][0] in ("int", "float"))


def _share(value: Column, kind: str, length: str) -> Column:
    """A sample's part of an INFO value: by its place among the samples of its file."""
    one = lambda v: (divide(v, F.col("_s.at"), F.size("samples")) if kind == "int" else v / F.size("samples")).cast(kind)
    return one(value) if length == "1" else F.transform(value, one)


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Sample names of each file of a path, by file in order."""
    rows = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(F.input_file_name().alias("file"), "value").collect()
    return {r.file: r.value.split("\t")[9:] for r in sorted(rows, key=lambda r: r.file)}


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The data lines, split into columns of HEAD, `samples` and `file`; and the sample names of all files."""
    names = list(dict.fromkeys(n for file in headers(spark, path).values() for n in file))
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    t = raw.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("file", F.split("value", "\t").alias("_t"))
    return t.select(*(F.get("_t", F.lit(i)).alias(n) for i, n in enumerate(HEAD)), F.slice("_t", F.lit(10), F.greatest(F.size("_t") - 9, F.lit(0))).alias("samples"), "file"), names


def _value(text: Column, kind: str, length: str) -> Column:
    text = F.when(text != ".", text)
    if kind == "boolean":
        return text.isNotNull()
    if kind == "string":
        return text
    if length == "1":
        return text.try_cast(kind)
    items = F.transform(F.split(text, ","), lambda x: F.when(x != ".", x).try_cast(kind))
    return F.when(F.exists(items, lambda x: x.isNotNull()), items)


def expected_length(length: str, n_alt: Column, ploidy: Column | None = None) -> Column | None:
    """How many elements a field of this length has; None if any number is right. ploidy: of the call, for G and P."""
    if length == "A":
        return n_alt
    if length == "R":
        return n_alt + 1
    if length in ("G", "P") and ploidy is not None:  # genotypes of n_alt + 1 alleles: (n_alt + ploidy) choose ploidy
        return ploidy if length == "P" else F.aggregate(F.sequence(F.lit(1), ploidy), F.lit(1).cast("long"), lambda x, i: F.call_function("div", x * (n_alt + i), i))
    return F.lit(int(length)) if length.isdigit() else None


def read_vcf(spark: SparkSession, path: str, fields: dict[str, dict], contigs: DataFrame, rows: dict[str, int] | None = None, deletions_as_intervals: bool = True, discard_missing_gt: bool = False, check_lengths: bool = True, divided: tuple[str, ...] = (), within: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """Calls of a VCF: row_idx, sample, contig, col_begin, col_end, ref, alt, id, qual, filter, INFO and FORMAT fields; a field
    that is both has its FORMAT value in <name>_FORMAT. Columns are global positions from 0. rows: sample -> row_idx (all
    samples in order, if not given). A length that contradicts the configuration is an error naming the place. The files
    of a path may have samples of their own; of an INFO key that repeats the first value counts. divided: INFO fields whose
    values are split over all samples of their file (summed_fields). within: only calls that reach into one of these
    intervals (interval_id, begin, end) of columns, as metadata.parse_intervals gives them."""
    lines, names = read_lines(spark, path)
    rows = rows or {n: i for i, n in enumerate(names)}
    of_file = [(file, [(n, rows[n], i) for i, n in enumerate(its) if n in rows]) for file, its in headers(spark, path).items()]
    lines = lines.join(F.broadcast(spark.createDataFrame(of_file, "file string, _chosen array<struct<sample: string, row_idx: long, at: int>>")), "file")
    c = lines.join(F.broadcast(contigs.select(F.col("name").alias("chrom"), "offset", "length")), "chrom")
    alt = F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ","))
    c = c.withColumn("alt", F.transform(alt, lambda a: F.when(a == "<NON_REF>", NON_REF).otherwise(a))).withColumn("pos", F.col("pos").cast("long"))
    pairs = F.transform(F.split("info", ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit("1")).alias("v")))
    first = lambda p, i: ~p["k"].isin(".", "") & (F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    c = c.withColumn("_info", F.map_from_entries(F.filter(pairs, first)))
    end = F.try_element_at("_info", F.lit("END")).cast("long")
    indel = F.exists("alt", lambda a: ~is_symbolic(a) & (F.length(a) < F.length("ref")))
    tail = F.when(F.lit(deletions_as_intervals) & indel, F.length("ref") - 1).otherwise(0)
    c = c.withColumn("col_begin", F.col("offset") + F.col("pos") - 1).withColumn("col_end", F.coalesce(F.col("offset") + end - 1, F.col("col_begin") + tail))
    each = c.withColumn("_s", F.explode("_chosen")).withColumn("_keys", F.split("format", ":")).withColumn("_vals", F.split(F.get("samples", F.col("_s.at")), ":"))
    part = lambda name: F.get("_vals", F.array_position("_keys", F.lit(name)).cast("int") - 1)
    out = {}
    n_alt = F.size("alt")
    ploidy = F.coalesce(F.size(F.split(part("GT"), "[/|]")), F.lit(2))
    for name, f in fields.items():
        kind, length = f["types"][0], f["length"][0]
        if name in ("END", "FILTER", "ID", "QUAL", "PASS"):
            continue
        if name == "GT":
            continue
        both = {"INFO", "FORMAT"} <= set(f["classes"])
        for cls, text in (("INFO", F.try_element_at("_info", F.lit(f["vcf_name"]))), ("FORMAT", part(f["vcf_name"]))):
            if cls not in f["classes"]:
                continue
            value = _value(text, kind, length)
            want = expected_length(length, n_alt, ploidy if cls == "FORMAT" else None)
            if check_lengths and want is not None and kind not in ("string", "boolean"):
                bad = F.contains(text, F.lit(",")) if length == "1" else value.isNotNull() & (F.size(value) != want)
                value = F.when(bad, F.raise_error(F.concat(F.lit(f"{name} has a wrong number of elements at "), "chrom", F.lit(":"), F.col("pos").cast("string"), F.lit(" for "), F.col("_s.sample"))).cast(kind if length == "1" else f"array<{kind}>")).otherwise(value)
            if cls == "INFO" and name in divided:
                value = _share(value, kind, length)
            out[f"{name}_FORMAT" if both and cls == "FORMAT" else name] = value
    gt = part("GT")
    alleles = F.transform(F.split(gt, "[/|]"), lambda a: F.when(a == ".", F.lit(-1)).otherwise(a.cast("int")))
    phased = F.transform(F.regexp_extract_all(gt, F.lit("([/|])"), 1), lambda x: x == "|")
    filters = F.when(~F.col("filter").isin(".", ""), F.split("filter", ";"))
    calls = each.select(
        F.col("_s.row_idx").alias("row_idx"), F.col("_s.sample").alias("sample"), F.col("chrom").alias("contig"), "col_begin", "col_end", "ref", "alt",
        F.when(F.col("id") != ".", F.col("id")).alias("id"), F.when(F.col("qual") != ".", F.col("qual")).try_cast("float").alias("qual"), filters.alias("filter"),
        F.when(gt.isNotNull(), alleles).alias("gt"), F.when(gt.isNotNull(), phased).alias("gt_phased"), *(v.alias(n) for n, v in out.items()),
    )
    if within is not None:
        calls = reaching(calls, within)
    return calls.where(F.col("gt").isNull() | F.exists("gt", lambda a: a >= 0)) if discard_missing_gt else calls


def reaching(calls: DataFrame, within: list[tuple[int, int, int]]) -> DataFrame:
    """The calls that reach into any of a list of intervals, once each. Intervals that touch are put together first, so a
    call needs to look only at the last one that begins before its end."""
    merged: list[list[int]] = []
    for _, begin, end in sorted(within, key=lambda x: x[1:]):
        if merged and begin <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    if not merged:
        return calls.where("false")
    listed = F.lit([b for b, _ in merged]).cast("array<long>"), F.lit([e for _, e in merged]).cast("array<long>")
    before = F.size(F.filter(listed[0], lambda b: b <= F.col("col_end")))
    return calls.where((before > 0) & (F.get(listed[1], before - 1) >= F.col("col_begin")))


def to_vcf_lines(records: DataFrame, samples: list[str], contigs: DataFrame, info: dict[str, str], formats: dict[str, str], produce_gt: bool = True, produce_filter: bool = True) -> DataFrame:
    """column, line: text of combined records (merge.combine_gvcf), to be ordered by column. info and formats: VCF name
    -> column or call field. END is given where a segment has more than one position, QUAL where records have a column
    qual. Genotypes keep their phase where calls have gt_phased; without produce_gt all are missing, without
    produce_filter the filter is."""
    c = records.join(F.broadcast(contigs.select(F.col("name").alias("contig"), "offset")), "contig")
    pos = F.col("s") - F.col("offset") + 1
    shown = [F.when(F.col("t") > F.col("s"), F.concat(F.lit("END="), (F.col("t") - F.col("offset") + 1).cast("string")))]
    shown += [F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{name}="), _show(F.col(col), records.schema[col].dataType.typeName()))) for name, col in info.items()]
    text = F.concat_ws(";", *shown)
    kinds = {f.name: f.dataType.typeName() for f in records.schema["calls"].dataType.elementType.fields}
    used = {n: f for n, f in formats.items() if f in kinds}
    here = {n: _any("calls", f) for n, f in used.items()}
    keys = F.array_compact(F.array(*(F.when(here[n], F.lit(n)) for n in used)))

    def shown_call(x: Column) -> Column:
        parts = [F.when(here[n], F.coalesce(encode_gt(x["gt"], x["gt_phased"] if "gt_phased" in kinds else None, produce_gt) if n == "GT" else _show(x[f], kinds[f]), F.lit("."))) for n, f in used.items()]
        return F.struct(x["row_idx"].cast("int").alias("row"), F.concat_ws(":", F.array_compact(F.array(*parts))).alias("text"))

    # calls and, for samples without one, missing values, in the samples' order: once over the calls, whatever the samples
    missing = F.concat_ws(":", F.array_compact(F.array(*(F.when(here[n], F.lit(".")) for n in used))))
    every = F.sequence(F.lit(0), F.lit(len(samples) - 1)) if samples else F.array().cast("array<int>")
    absent = F.transform(F.array_except(every, F.transform("calls", lambda x: x["row_idx"].cast("int"))), lambda i: F.struct(i.alias("row"), missing.alias("text")))
    both = F.array_sort(F.concat(F.transform(F.filter("calls", lambda x: x["row_idx"] < len(samples)), shown_call), absent))
    per_sample = [F.array_join(F.transform(both, lambda x: x["text"]), "\t")] if samples else []
    qual = _number(F.col("qual")) if "qual" in records.columns else F.lit(".")
    filters = F.coalesce(F.array_join("filters", ";"), F.lit(".")) if produce_filter else F.lit(".")
    line = F.concat_ws("\t", F.col("contig"), pos.cast("string"), F.coalesce("ids", F.lit(".")), F.col("ref"), F.array_join("alt", ","), qual, filters, F.when(text == "", ".").otherwise(text), F.array_join(keys, ":"), *per_sample)
    return c.select(F.col("s").alias("column"), line.alias("line"))


def _number(x: Column) -> Column:
    """A number as text, without decimals if it has none."""
    return F.coalesce(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")), F.lit("."))


def _any(calls: str, field: str) -> Column:
    return F.exists(calls, lambda x: x[field].isNotNull())


def _show(c: Column, kind: str) -> Column:
    if kind == "array":
        return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")
    return c.cast("string")


TYPES = {"int": "Integer", "float": "Float", "boolean": "Flag", "string": "String"}


def header(samples: list[str], contigs: list[tuple[str, int]], info: list[str], formats: list[str], fields: dict[str, dict] | None = None) -> list[str]:
    """Header lines; numbers and types as fields has them (any number of strings, if it hasn't)."""

    def field(section: str, name: str) -> str:
        f = (fields or {}).get(name)
        length, kind = (f["length"][0], f["types"][0]) if f else (".", "string")
        if name == "GT":
            length, kind = "1", "string"
        number = "0" if kind == "boolean" else length if length in ("A", "R", "G") or length.isdigit() else "."
        return f'##{section}=<ID={name},Number={number},Type={TYPES.get(kind, "String")},Description="{name}">'

    out = ["##fileformat=VCFv4.2", '##ALT=<ID=NON_REF,Description="Any other allele">', '##INFO=<ID=END,Number=1,Type=Integer,Description="Last position of the record">']
    out += [field("INFO", n) for n in info] + [field("FORMAT", n) for n in formats]
    out += [f"##contig=<ID={n},length={length}>" for n, length in contigs]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_vcf(records: DataFrame, path: str, samples: list[str], contigs: DataFrame, info: dict[str, str], formats: dict[str, str], fields: dict[str, dict] | None = None, produce_gt: bool = True, produce_filter: bool = True) -> None:
    """VCF text, in order: part files sorted and ranged by position, with the header in the first file's place. See
    to_vcf_lines and header."""
    spark = records.sparkSession
    known = [(r.name, r.length) for r in contigs.select("name", "length", "offset").orderBy("offset").collect()]
    head = spark.createDataFrame([(i - 1_000_000, line) for i, line in enumerate(header(samples, known, list(info), list(formats), fields))], "column long, line string")
    lines = head.unionByName(to_vcf_lines(records, samples, contigs, info, formats, produce_gt, produce_filter))
    lines.orderBy("column").select("line").write.mode("overwrite").text(path)
