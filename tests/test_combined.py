"""Combined records, variants and files against known cells."""

import json
import random
import re

import cells
import pytest
from pyspark.sql import functions as F

from locusweave import registry
from locusweave.functions import alleles as A
from locusweave.operators import diff, intervals, merge, variants
from locusweave.sources import csv_cells, metadata, sinks, vcf

SPEC = merge.Spec(
    info={n: ("median", "float") for n in ("BaseQRankSum", "ClippingRankSum", "MQRankSum", "ReadPosRankSum", "MQ")} | {"RAW_MQ": ("sum", "double"), "MQ0": ("median", "int")},
    format=("gq", "sb", "min_dp"),
)


@pytest.fixture(scope="module")
def calls(spark):
    lines = spark.createDataFrame([(x,) for x in cells.CSV_LINES], "line string")
    return csv_cells.parse(lines, cells.CSV_FIELDS).withColumn("contig", F.lit("1")).withColumn("id", F.lit(None).cast("string")).cache()


@pytest.fixture(scope="module")
def deletions(spark):
    return spark.createDataFrame(cells.DELETIONS, "row_idx long, col_begin long, col_end long, ref string, alt array<string>, gt array<int>, dp int, dp_format int, ad array<int>, pl array<int>, BaseQRankSum float, MQ float").withColumn("contig", F.lit("1")).withColumn("min_dp", F.lit(None).cast("int")).cache()


def test_csv_cells(calls):
    rows = {(r.row_idx, r.col_begin): r for r in calls.collect()}
    a = rows[0, 17384]
    assert (a.ref, a.alt, a.pl, a.ad, a.sb, a.gt, a.pgt, a.dp, a.dp_format, a.filter) == ("G", ["A", "<NON_REF>"], [504, 0, 9807, 678, 1870, 2548], [58, 22, 17], [58, 0, 22, 0], [0, 1], "0|1", None, 80, ["0"])
    b = rows[0, 12140]
    assert (b.alt, b.ad, b.pl, b.min_dp, b.sb) == (["<NON_REF>"], None, [0, 0, 0], 0, None)


def test_csv_round_trip(spark, calls):
    lines = [r.line for r in csv_cells.to_lines(calls, cells.CSV_FIELDS).collect()]
    assert sorted(lines) == sorted(cells.CSV_LINES)


def test_combined_snv(calls):
    out = {r.s: r for r in merge.combine_gvcf(calls, SPEC).collect()}
    assert sorted((r.s + 1, r.t + 1) for r in out.values()) == [(12141, 12144), (12145, 12277), (12278, 12295), (17385, 17385)]
    r = out[17384]
    assert (r.ref, r.alt, r.dp, r.MQ0) == ("G", ["A", "T", "<NON_REF>"], 276, 3)
    assert [round(r[n], 3) for n in ("BaseQRankSum", "ClippingRankSum", "MQRankSum", "ReadPosRankSum", "MQ", "RAW_MQ")] == [-2.074, -1.859, -0.432, 0.005, 31.72, 8.0]
    assert r.calls[0].pl == [504, 0, 9807, 678, 1870, 2548, 678, 1870, 2548, 2548] and r.calls[0].ad == [58, 22, 17, 17]
    assert r.calls[1].pl == [3336, 4536, 7349, 358, 958, 0, 4536, 7349, 958, 7349] and r.calls[1].ad == [0, 37, 120, 37] and r.calls[1].gt == [2, 2]
    assert r.calls[2].pl == [1018, 0, 1116, 1137, 1224, 2361, 1137, 1224, 2361, 2361]
    assert all(out[s].dp is None for s in (12140, 12144, 12277)) and out[12144].ref == "C" and out[12277].ref == "N"


def test_interval_begins_inside_a_block(calls):
    out = sorted((r.s + 1, r.t + 1, r.ref) for r in merge.combine_gvcf(calls, SPEC, 12150, 10**9).collect())
    assert out == [(12151, 12277, "N"), (12278, 12295, "N"), (17385, 17385, "G")]


def test_reference_fill(spark, calls):
    bases = spark.createDataFrame([("1", 12277, "c"), ("1", 12150, "x")], "contig string, pos long, base string")
    out = {r.s: r.ref for r in merge.combine_gvcf(calls, SPEC, reference=bases).collect()}
    assert out[12277] == "C"
    assert {r.s: r.ref for r in merge.combine_gvcf(calls, SPEC, 12150, 10**9, bases).collect()}[12150] == "N"


def test_spanning_deletions(deletions):
    spec = merge.Spec(info={"BaseQRankSum": ("median", "float"), "MQ": ("median", "float")}, format=())
    out = {r.s + 1: r for r in merge.combine_gvcf(deletions, spec).collect()}
    assert sorted(out) == [8029500, 8029501, 8029502]
    a = out[8029500]
    assert (a.ref, a.alt, a.dp, round(a.BaseQRankSum, 3), round(a.MQ, 2)) == ("TGG", ["T", "TG", "<NON_REF>"], 197, 1.067, 59.59)
    assert [c.ad for c in a.calls] == [[6, 2, 0, 0], [45, 1, 32, 0], [47, 0, 10, 0]]
    assert a.calls[2].pl == [89, 229, 1348, 0, 1119, 1086, 229, 1348, 1119, 1348]
    b = out[8029501]
    assert (b.ref, b.alt, b.dp, b.BaseQRankSum) == ("N", ["*", "<NON_REF>"], 197, None)
    assert [c.pl for c in b.calls] == [[40, 0, 197, 58, 203, 262], [733, 0, 1573, 862, 1670, 2532], [89, 0, 1086, 229, 1119, 1348]]
    assert [c.ad for c in b.calls] == [[6, 2, 0], [45, 32, 0], [47, 10, 0]]
    assert out[8029502].dp == 112 and [c.row_idx for c in out[8029502].calls] == [0, 1]


def test_vcf_and_least_pl_genotype(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(cells.MIN_PL_VCF)
    fields = metadata.fields({"fields": {n: {"vcf_field_class": c, "type": t, "length": length} for n, c, t, length in (("DP", ["INFO", "FORMAT"], "int", 1), ("MQRankSum", ["INFO"], "float", 1), ("RAW_MQ", ["INFO"], "float", 1), ("AD", ["FORMAT"], "int", "R"), ("PL", ["FORMAT"], "int", "G"), ("GQ", ["FORMAT"], "int", 1), ("SB", ["FORMAT"], "int", 4))}})
    contigs = spark.createDataFrame([("1", 249250621, 0)], "name string, length long, offset long")
    calls = vcf.read_vcf(spark, str(path), fields, contigs)
    row = calls.first()
    assert (row.col_begin, row.col_end, row.alt, row.gt, row.PL, row.DP, row.DP_FORMAT, row.AD) == (1274364, 1274366, ["T", "TA", "<NON_REF>"], [1, 2], [591, 353, 368, 166, 0, 123, 542, 379, 171, 547], 26, 24, [1, 7, 16, 0])
    assert round(row.qual, 2) == 562.77 and row.filter is None
    named = calls.withColumnsRenamed({"PL": "pl", "AD": "ad", "DP": "dp", "DP_FORMAT": "dp_format"}).withColumn("min_dp", F.lit(None).cast("int"))
    for least, want in ((False, [2, 1]), (True, [1, 1])):
        spec = merge.Spec(info={"MQRankSum": ("median", "float")}, min_pl_genotype=least)
        out = {r.s + 1: r for r in merge.combine_gvcf(named, spec).collect()}
        assert out[1274365].calls[0].gt == [1, 2] and out[1274366].calls[0].gt == want and out[1274367].calls[0].gt == want
        assert out[1274366].calls[0].pl == [591, 166, 123, 542, 171, 547] and out[1274366].dp == 26
    lines = [r.line for r in vcf.to_vcf_lines(merge.combine_gvcf(named, spec), ["HG01958"], contigs, {"MQRankSum": "MQRankSum", "DP": "dp"}, {"GT": "gt", "AD": "ad", "PL": "pl"}).orderBy("column").collect()]
    assert lines[0].split("\t") == ["1", "1274365", ".", "TAA", "T,TA,<NON_REF>", ".", ".", "MQRankSum=-1.011;DP=26", "GT:AD:PL", "1/2:1,7,16,0:591,353,368,166,0,123,542,379,171,547"]


def test_wrong_length_is_an_error(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(cells.MIN_PL_VCF.replace("1,7,16,0", "1,7"))
    fields = metadata.fields({"fields": {"AD": {"vcf_field_class": ["FORMAT"], "type": "int", "length": "R"}}})
    contigs = spark.createDataFrame([("1", 249250621, 0)], "name string, length long, offset long")
    with pytest.raises(Exception, match="AD has a wrong number of elements at 1:1274365 for HG01958"):
        vcf.read_vcf(spark, str(path), fields, contigs).collect()


def test_wrong_number_of_genotype_values_is_an_error(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(cells.MIN_PL_VCF.replace("591,353,", "591,"))
    fields = metadata.fields({"fields": {"PL": {"vcf_field_class": ["FORMAT"], "type": "int", "length": "G"}}})
    contigs = spark.createDataFrame([("1", 249250621, 0)], "name string, length long, offset long")
    with pytest.raises(Exception, match="PL has a wrong number of elements"):
        vcf.read_vcf(spark, str(path), fields, contigs).collect()


def test_files_with_their_own_samples(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    (tmp_path / "a.vcf").write_text(head + "A\n1\t10\t.\tC\tT\t50\t.\tDP=5;DP=7\tGT:AD\t0|1:3,2\n")
    (tmp_path / "b.vcf").write_text(head + "B\tC\n1\t10\t.\tC\tT\t.\t.\tDP=6\tGT:AD\t0/1:4,1\t1/1:0,9\n")
    fields = metadata.fields({"fields": {"AD": {"vcf_field_class": ["FORMAT"], "type": "int", "length": "R"}, "DP": {"vcf_field_class": ["INFO"], "type": "int", "length": 1}}})
    contigs = spark.createDataFrame([("1", 1000, 0)], "name string, length long, offset long")
    calls = vcf.read_vcf(spark, str(tmp_path), fields, contigs)
    got = {r.sample: (r.row_idx, r.gt, r.gt_phased, r.AD, r.DP, r.qual) for r in calls.collect()}
    assert got == {"A": (0, [0, 1], [True], [3, 2], 5, 50.0), "B": (1, [0, 1], [False], [4, 1], 6, None), "C": (2, [1, 1], [False], [0, 9], 6, None)}
    records = calls.groupBy("contig", F.col("col_begin").alias("s"), F.col("col_end").alias("t"), "ref", "alt").agg(F.max("qual").alias("qual"), F.array_sort(F.collect_list(F.struct("row_idx", "gt", "gt_phased", "AD"))).alias("calls")).withColumns({"ids": F.lit(None).cast("string"), "filters": F.array(F.lit("low"))})
    lines = lambda **kw: [r.line.split("\t")[5:] for r in vcf.to_vcf_lines(records, ["A", "B", "C", "D"], contigs, {}, {"GT": "gt", "AD": "AD"}, **kw).collect()]
    assert lines() == [["50", "low", ".", "GT:AD", "0|1:3,2", "0/1:4,1", "1/1:0,9", ".:."]]
    assert lines(produce_gt=False, produce_filter=False) == [["50", ".", ".", "GT:AD", ".|.:3,2", "./.:4,1", "./.:0,9", ".:."]]
    assert '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="AD">' in vcf.header(["A"], [("1", 1000)], ["DP"], ["AD"], fields)


def test_open_ended_intervals(spark):
    calls = spark.createDataFrame([(0, "1", 5, 20), (0, "1", 4000, 4100), (1, "1", 9, 9)], "row_idx long, contig string, col_begin long, col_end long")
    from locusweave.operators import intervals

    parts = spark.createDataFrame([(0, 0, 3999), (1, 4000, 2**63 - 2)], "pid long, p_begin long, p_end long")
    got = intervals.partition_cells(calls, parts).select("pid", "row_idx", "col_begin").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 5), (0, 1, 9), (1, 0, 4000)]
    assert intervals.partition_cells(calls.where("false"), parts).count() == 0


def test_general_ploidy(spark):
    calls = spark.createDataFrame(cells.TRIPLOID, "row_idx long, col_begin long, col_end long, ref string, alt array<string>, gt array<int>, pl array<int>").withColumn("contig", F.lit("1"))
    out = {r.s: r for r in merge.combine_gvcf(calls, merge.Spec(per_allele=(), info={}, format=(), general_ploidy=True)).collect()}
    assert out[17384].alt == ["A", "T", "*", "<NON_REF>"]
    for (s, row), want in cells.TRIPLOID_PL.items():
        assert next(c.pl for c in out[s].calls if c.row_idx == row) == list(map(int, want.split(",")))
    assert next(c.gt for c in out[17384].calls if c.row_idx == 3) == [0, 4, 0] and out[17385].calls[0].gt == [0, 2, 0]


def test_variants(spark, calls):
    q = spark.createDataFrame([(0, 0, 10**9)], "interval_id int, qb long, qe long")
    v = variants.variants(calls, q, SPEC).orderBy("number").collect()
    assert [(r.col_begin, [c.row_idx for c in r.calls]) for r in v] == [(12140, [0]), (12144, [1]), (17384, [0, 2]), (17384, [1])]
    contigs = spark.createDataFrame([("1", 249250621, 0)], "name string, length long, offset long")
    found = {r.number: json.loads(r.json, parse_float=str) for r in sinks.variants_json(variants.variants(calls, q, SPEC), contigs).collect()}
    assert len(found) == 4 and (found[0]["interval"], found[0]["genomic_interval"], found[0]["common_fields"]) == ([12140, 12294], {"1": [12141, 12295]}, {})
    first, second = found[2]["variant_calls"]
    assert (first["row"], second["row"], first["genomic_interval"], first["fields"]["REF"], first["fields"]["ALT"]) == (0, 2, {"1": [17385, 17385]}, "G", ["A", "<NON_REF>"])
    assert (first["fields"]["MQ"], first["fields"]["RAW_MQ"], second["fields"]["BaseQRankSum"]) == ("31.719999", "5.500000", "1.046000") and "RAW_MQ" not in second["fields"]


def test_variant_numbers_go_on_from_bin_to_bin(spark):
    rows = [(r, "1", b, b, "A", ["C"], [0, 1]) for b in range(100, 90_000, 7_000) for r in (0, 1)] + [(2, "1", 100, 100, "A", ["G"], [0, 1])]
    calls = spark.createDataFrame(rows, "row_idx long, contig string, col_begin long, col_end long, ref string, alt array<string>, gt array<int>")
    q = spark.createDataFrame([(0, 0, 10**9), (1, 50_000, 60_000)], "interval_id int, qb long, qe long")
    v = variants.variants(calls, q, merge.Spec(per_allele=(), per_genotype=(), info={}, format=())).collect()
    for i, n in ((0, 14), (1, 1)):
        mine = sorted(((r.number, r.col_begin, r.calls[0].row_idx) for r in v if r.interval_id == i))
        assert [m[0] for m in mine] == list(range(n)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_info_field_moved_to_format(spark, deletions):
    spec = merge.Spec(info={"BaseQRankSum": (merge.MOVED, "float"), "MQ": ("median", "float")}, format=())
    out = {r.s + 1: r for r in merge.combine_gvcf(deletions, spec).collect()}
    assert "BaseQRankSum" not in out[8029500].asDict()
    for s in (8029500, 8029501):  # a spanning deletion drops INFO fields, not those that are FORMAT fields now
        assert [round(c.BaseQRankSum, 3) for c in out[s].calls] == [1.067, 1.82, -0.703]
    assert out[8029501].MQ is None


def test_values_divided_among_samples(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\n" + "".join(f"1\t{p}\t.\tC\tT\t.\t.\tDP=11;RAW_MQ=6;MQ=7\tGT\t0|1\t0/1\t1/1\n" for p in (10, 20, 30)))
    kind = lambda t, op: {"vcf_field_class": ["INFO"], "type": t, "length": 1, "VCF_field_combine_operation": op}
    fields = metadata.fields({"fields": {"DP": kind("int", "sum"), "RAW_MQ": kind("float", "sum"), "MQ": kind("float", "median")}})
    contigs = spark.createDataFrame([("1", 1000, 0)], "name string, length long, offset long")
    assert vcf.summed_fields(fields) == ("DP", "RAW_MQ")
    calls = vcf.read_vcf(spark, str(tmp_path), fields, contigs, divided=vcf.summed_fields(fields), within=[(0, 0, 12), (1, 25, 40), (2, 9, 10)])
    assert sorted((r.sample, r.col_begin, r.DP, r.RAW_MQ, r.MQ) for r in calls.collect()) == [(n, p, dp, 2.0, 7.0) for n, dp in (("A", 4), ("B", 4), ("C", 3)) for p in (9, 29)]
    assert vcf.reaching(calls, []).count() == 0


def test_features_in_order(spark, tmp_path):
    rows = [(0, "b", 105, 110), (1, "a", 50, 60), (0, "a", 7, 55), (2, "b", 101, 101)]
    sinks.write_calls(spark.createDataFrame(rows, "row_idx long, contig string, col_begin long, col_end long"), f"{tmp_path}/t")
    contigs = spark.createDataFrame([("b", 50, 100), ("a", 100, 0)], "name string, length long, offset long")
    get = lambda *a: [(r.contig, r.start, r.end, r.row_idx) for r in sinks.features(spark, f"{tmp_path}/t", contigs, *a).collect()]
    assert get() == [("a", 8, 56, 0), ("a", 51, 61, 1), ("b", 2, 2, 2), ("b", 6, 11, 0)]
    assert get("a", 57, 70) == [("a", 51, 61, 1)] and get("b") == [("b", 2, 2, 2), ("b", 6, 11, 0)] and get("c") == []


def test_difference_of_triploid_records(spark):
    gold = spark.createDataFrame([("1", 5, 5, "A", ["C", "G"], 1.0, [1, 2, 3], list(range(10)))], "contig string, pos long, col_end long, ref string, alt array<string>, qual double, ad array<int>, pl array<int>")
    order = [0, 2, 1]  # the other order of ALT
    place = {g: i for i, g in enumerate(A.genotypes(3, 3))}
    swapped = [place[tuple(sorted(order[a] for a in g))] for g in A.genotypes(3, 3)]
    test = spark.createDataFrame([("1", 5, 5, "A", ["G", "C"], 1.0, [1, 3, 2], swapped)], gold.schema)
    assert diff.diff(gold, test, ploidy=F.lit(3)).count() == 0
    assert [r.field for r in diff.diff(gold, gold.withColumn("pl", F.array(*map(F.lit, swapped))), ploidy=F.lit(3)).collect()] == ["pl"]


def test_table_layout_and_scan(spark, calls, tmp_path):
    path = f"{tmp_path}/table"
    sinks.write_calls(calls, path)
    assert sinks.is_table(spark, path) and sinks.list_tables(spark, str(tmp_path)) == ["table"]
    assert sinks.scan(spark, path, ["row_idx", "col_begin"], [1], 0, 13_000, 1000).collect() == [(1, 12144)]
    sinks.compact(spark, path, f"{tmp_path}/again")
    assert spark.read.parquet(f"{tmp_path}/again").count() == 5
    assert sinks.drop_table(spark, path) and not sinks.is_table(spark, path)


def test_self_difference(calls):
    r = calls.select("contig", F.concat("row_idx", F.lit("")).alias("x"), F.col("col_begin").alias("pos"), "col_end", "ref", "alt", "qual", "ad", "pl").withColumn("contig", F.concat_ws(".", "contig", "x")).drop("x")
    assert diff.diff(r, r).count() == 0
    moved = r.where("pos < 17384").withColumn("col_end", F.col("col_end") - 1).unionByName(r.where("pos >= 17384"))
    assert {(x.kind, x.pos) for x in diff.diff(r, moved).collect()} == {("partial block", 12140), ("partial block", 12144)}


def test_overlap_of_intervals(spark, calls):
    q = spark.createDataFrame([(0, 12100, 12100), (1, 12141, 12150), (2, 17384, 17384)], "interval_id int, qb long, qe long")
    assert sorted((r.interval_id, r.row_idx, r.col_begin) for r in intervals.overlap(calls, q).collect()) == [(1, 0, 12140), (1, 1, 12144), (2, 0, 17384), (2, 1, 17384), (2, 2, 17384)]


def test_calls_json(spark, calls):
    q = spark.createDataFrame([(0, 0, 10**9)], "interval_id int, qb long, qe long")
    found = intervals.overlap(calls, q).withColumn("offset", F.lit(0).cast("long"))
    j = json.loads(sinks.calls_json(found, ["ref", "alt", "gt", "pl"]).first().json)
    assert j["query_interval"] == [0, 10**9] and len(j["variant_calls"]) == 5
    assert j["variant_calls"][0] == {"row": 0, "interval": [12140, 12294], "genomic_interval": {"1": [12141, 12295]}, "fields": {"REF": "C", "ALT": ["<NON_REF>"], "GT": [0, 0], "pl": [0, 0, 0]}}
    vectors = sinks.column_vectors(found, ["ref"]).first()
    assert vectors.POSITION == [12141, 12145, 17385, 17385, 17385] and vectors.indices == [0, 1, 0, 1, 2]
    assert set(json.loads(sinks.positions_json(found, ["ref"]).first().json)) == {"12141_12295", "12145_12277", "17385"}


def test_nothing_is_shuffled_once_per_segment(spark):
    """Calls are dealt to tiles with the fields a query needs; their copies in segments aren't shuffled."""
    from locusweave import registry

    for name in ("merged_ref", "pl_remap_diploid", "combined_gvcf", "dummy_genotyping_median", "reference_fill", "info_sum"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
        assert dealt and not [line for line in dealt if " s#" in line.split("hashpartitioning")[1] and " t#" in line], name


def test_segments_over_tiles(spark):
    """A block over many tiles, a long deletion, and tiles without an edge; the next edge may be any number of tiles on."""
    rows = [(0, "c", 5, 2000, "A", ["<NON_REF>"]), (1, "c", 700, 703, "TGGC", ["T", "<NON_REF>"]), (1, "c", 126, 127, "A", ["<NON_REF>"]), (2, "d", 255, 256, "A", ["<NON_REF>"])]
    calls = spark.createDataFrame(rows, "row_idx long, contig string, col_begin long, col_end long, ref string, alt array<string>")
    got = sorted((r.contig, r.s, r.t, [c.row_idx for c in r.calls]) for r in intervals.gathered(calls, ["col_begin"]).collect())
    assert got == [("c", 5, 125, [0]), ("c", 126, 127, [0, 1]), ("c", 128, 699, [0]), *[("c", p, p, [0, 1]) for p in range(700, 704)], ("c", 704, 2000, [0]), ("d", 255, 256, [2])]


def test_differences_are_found_in_one_pass(spark):
    """One full outer join, whose parts aren't joined again for the blocks; blocks over bins, and two at one place."""
    r = spark.createDataFrame([("1", 5, 25_000, "A", ["<NON_REF>"], 1.0, [1, 2], [0, 1, 2]), ("1", 30_000, 30_000, "A", ["C"], 1.0, [1, 2], [0, 1, 2]), ("1", 40_000, 40_001, "A", ["<NON_REF>"], 1.0, [1], [0])], "contig string, pos long, col_end long, ref string, alt array<string>, qual double, ad array<int>, pl array<int>")
    other = r.where("pos < 30000").withColumns({"pos": F.lit(24_000).cast("long"), "col_end": F.lit(26_000).cast("long")}).unionByName(r.where("pos = 30000").withColumn("ad", F.array(F.lit(1), F.lit(9))))
    found = diff.diff(r, other)
    assert sorted((x.pos, x.kind, x.field) for x in found.collect()) == [(5, "partial block", ""), (24_000, "partial block", ""), (30_000, "differs", "ad"), (40_000, "only in gold", "")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_element_wise_sums_end_with_the_last_value(spark):
    from locusweave.functions.combine import COMBINE

    rows = [([[1, None, None], None, [2, None]],), ([[None], []],), ([None],), ([[1], [None, None, 4]],)]
    df = spark.createDataFrame(rows, "v array<array<long>>")
    assert [r[0] for r in df.select(COMBINE["element_wise_sum"](F.col("v"), "long")).collect()] == [[3], None, None, [1, None, 4]]


def test_calls_are_rebuilt_once(spark):
    """Gathered calls are dealt as they are and rebuilt once, by the last step; merged alleles aren't worked out per call."""
    plan = lambda q: registry.queries()[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # dealt (1), remapped (1); what follows the colon are the texts, not calls
    assert len(re.findall(r"struct\((?:row_idx|\w+), (?:lambda )?[\w#.]*row_idx", plan("combined_gvcf"))) <= 2
    for query in ("allele_lookup", "ad_remap", "gt_remap", "pl_remap_diploid"):
        steps = plan(query)
        assert not re.search(r"transform\(calls#\d+, lambdafunction\([^\n]*array_distinct", steps), query


def test_remapped_arrays(spark):
    """Calls that have all merged alleles or NON_REF alone take a shorter way; both are held against enumeration."""
    nr = A.NON_REF
    rows = [(merged, mine, [10 * i + 1 for i in range(n)], gt) for merged in ([nr], ["A", nr], ["*", "A", "T", nr], ["A"], ["A", "T"]) for mine in ([nr], ["A", nr], ["T", "A", nr], ["*", "A", "T", nr], ["A"], ["A", "T"]) for n in (0, 3, 5, 6, 7, 15) for gt in ([0, 0], [-1, -1], [0, 1], [1, 2], [4, 9], [2], [])]
    df = spark.createDataFrame(rows, "merged array<string>, mine array<string>, pl array<int>, gt array<int>").withColumn("source", A.sources(F.col("merged"), F.col("mine")))
    for r in df.withColumn("out", A.remap_diploid(F.col("pl"), F.col("source"))).withColumn("new", A.remap_gt(F.col("gt"), F.col("merged"), F.col("mine"))).collect():
        other = r.mine.index(nr) + 1 if nr in r.mine else None
        source = [0, *(r.mine.index(a) + 1 if a in r.mine else other for a in r.merged)]
        assert r.source == source
        if None not in source:
            at = [max(j, k) * (max(j, k) + 1) // 2 + min(j, k) for i, k in enumerate(source) for j in source[: i + 1]]
            assert r.out == [r.pl[i] if i < len(r.pl) else None for i in at]
        unknown = r.merged.index(nr) + 1 if nr in r.merged else -1
        assert r.new == [a if a <= 0 else r.merged.index(r.mine[a - 1]) + 1 if a <= len(r.mine) and r.mine[a - 1] in r.merged else unknown for a in r.gt]


def test_short_remap_and_least_genotype_as_the_general_ones(spark):
    rows = [([5, 3, 9, 1, 7, 2], [0, 1, 2]), ([5, 3, 9, 1, 7, 2], [0, 2, 1]), ([4, 4, 4, 4, 4, 4], [0, 1]), ([5, None, 9, None, 7, 2], [0, 2]), ([5, 3, 3], [0, 1, 1]), ([None, None, None], [0, 1]), (None, [0, 1]), (list(range(10, 0, -1)), [0, 2, 3])]
    df = spark.createDataFrame(rows, "v array<int>, source array<int>").withColumn("short", A.remap_diploid_short(F.col("v"), F.col("source")))
    df = df.withColumn("general", A.remap_diploid(F.col("v"), F.col("source"))).withColumn("least", A.least_genotype(F.col("short"), F.size("source")))
    for r in df.collect():
        assert r.short == r.general
        n = len(r.source)
        have = [(r.short[k * (k + 1) // 2 + j], j, k) for j in range(n) for k in range(j, n) if r.short and r.short[k * (k + 1) // 2 + j] is not None]
        assert r.least == (list(min(have)[1:]) if have else None)


def _dealt(df):
    """The fields that calls are dealt to tiles with, once for each time that tiles are made."""
    return re.findall(r"struct\((row_idx, row_idx#.*?)\) AS _c#", df._jdf.queryExecution().optimizedPlan().toString())


def test_queries_shuffle_only_what_they_return(spark):
    fields = {n: [[x.split("#")[0] for x in d.split(", ")[1::2]] for d in _dealt(registry.queries()[n](spark, "/root/testdata/sf0.001"))] for n in ("merged_ref", "reference_fill", "merged_alt", "move_to_format")}
    ends = ["_b", "_e", "_dense"]
    assert fields["merged_ref"] == [["row_idx", "col_begin", "ref", *ends]]
    assert fields["reference_fill"] == fields["merged_ref"] * 2  # records and bases: the same exchange
    assert fields["merged_alt"] == [["row_idx", "col_begin", "ref", "alt", *ends]]
    assert not set(fields["move_to_format"][0]) & {"dp", "min_dp", "dp_format", "id", "filter"}


def test_what_is_combined_never_becomes_rows_of_calls(spark):
    for n in ("info_sum", "info_dp", "merged_ref", "segments"):
        top = registry.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]
        assert top.startswith("Generate") and "calls#" not in top.rsplit("[", 1)[1]
    merged = registry.queries()["merged_alt"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " AS mine#" not in merged


def test_spanning_fields_stay_behind_where_nothing_spans(spark):
    c = merge.pieces(registry.calls(spark, "/root/testdata/sf0.001"), registry.SPEC)
    kept = intervals.sweep(c, fields=["_span", "gt"], keep=lambda c: c["_span"])
    every = intervals.sweep(c, fields=["_span", "gt"]).where("_span")
    assert sorted(map(str, kept.collect())) == sorted(map(str, every.collect()))


def test_medians_of_merged_genotypes_as_by_merged_calls(spark):
    """Every tile is worked on once, in arrays; held against alleles merged by columns and genotypes by enumeration, on odd
    calls: of ploidy none to three, without NON_REF, PL or some of it, with too short PL, breakends, equal and over 50 alleles, over many tiles."""
    nr = A.NON_REF
    shapes = [("A", [nr]), ("A", ["C", nr]), ("A", ["C"]), ("TGG", ["T", nr]), ("TGG", ["TG", "T", nr]), ("TG", ["T", "TGGA"]), ("A", ["A[2:5[", nr]), ("AC", ["GT", nr]), ("A", [nr, "C", "C"]), ("TGG", ["*", "T"]), ("A", ["A" * i for i in range(2, 54)]), ("é", ["éa", nr]), ("A", [])]
    gts = [[0, 1], [0, 1], [0, 1], [1], [0, 0, 1], [], None]
    rng, rows = random.Random(7), []
    for row in range(6):
        place = 0
        while place < 900:
            place += rng.choice([1, 1, 2, 3, 5, 40])
            ref, alt = rng.choice(shapes)
            length = rng.choice([0, 7, 300]) if alt == [nr] else len(ref) - 1
            pl = rng.choice([None, [], [rng.choice([None, -5, 2**31 - 1]) for _ in range(6)]]) if rng.random() < 0.2 else [rng.randint(0, 99) for _ in range(rng.choice([3, 6, 10, 1500]))]
            rows.append((row, f"c{place // 400}", place, place + length, ref, alt, rng.choice(gts), pl))
    calls = spark.createDataFrame(rows, "row_idx long, contig string, col_begin long, col_end long, ref string, alt array<string>, gt array<int>, pl array<int>")
    want = {}
    for r in merge.merge_alleles(merge.segment_calls(calls, merge.Spec(per_allele=(), info={}), ["gt", "pl"])).where("size(alt) <= 50").collect():
        for c, source in zip(r.calls, r.source, strict=True):
            if c.pl is not None and c.gt is not None and len(c.gt) in (1, 2):
                for g, i in enumerate(A._places(tuple(source), len(c.gt))):
                    if 0 <= i < len(c.pl) and c.pl[i] is not None:
                        want.setdefault((r.contig, r.s, r.t, g), []).append(c.pl[i])
    found = variants.dummy_genotyping(calls)
    got = {(r.contig, r.s, r.t, r.genotype): r.median_pl for r in found.collect()}
    assert len(got) > 1500 and got == {k: sorted(v, reverse=True)[len(v) // 2] for k, v in want.items()}
    assert variants.dummy_genotyping(calls.where("false")).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "array_distinct" not in plan and plan.count("Window [") == 2  # calls are cut once


def test_next_begins_of_every_tile(spark):
    rows = [(0, "c", 5, 400), (1, "c", 10, 10), (1, "c", 70, 71), (0, "c", 1000, 1000), (0, "d", 63, 63)]
    calls = spark.createDataFrame(rows, "row_idx long, contig string, col_begin long, col_end long")
    got = sorted((r.contig, r["_tile"], r["_next"]) for r in intervals.next_begins(calls).collect())
    assert got == [("c", 0, 70), *[("c", t, 1000) for t in range(1, 7)], ("c", 15, None), ("d", 0, None), ("d", 1, None)]
