"""Fields from headers, partition loading, projection, and combining files from the command line."""

import pytest

from locusweave.__main__ import main
from locusweave.operators import intervals
from locusweave.plans.projection import flatten_tuples, plan_columns
from locusweave.sources import metadata

HEADER = """##fileformat=VCFv4.2
##contig=<ID=1,length=1000>
##contig=<ID=2,length=500>
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth, all">
##INFO=<ID=MQ,Number=1,Type=Float,Description="x">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="y">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="z">
"""


def vcf(name, *records):
    return HEADER + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + name + "\n" + "".join(f"{r}\n" for r in records)


def test_header(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(vcf("A"))
    fields, contigs = metadata.fields_from_header(spark, str(tmp_path / "a.vcf"))
    assert contigs == [("1", 1000, 0), ("2", 500, 1000)]
    assert fields["DP"]["classes"] == ["FORMAT", "INFO"] and fields["GT"]["length"] == ["PP"] and fields["PL"]["length"] == ["G"]
    assert fields["MQ"]["combine"] == "median" and fields["MQ"]["types"] == ["float"]


def test_combine_files(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(vcf("A", "1\t10\t.\tC\t<NON_REF>\t.\t.\tEND=20\tGT:DP:PL\t0/0:3:0,1,2", "2\t5\trs1\tG\tA,<NON_REF>\t50\tPASS\tDP=9;MQ=30.5\tGT:AD:PL\t0/1:4,5,0:10,0,20,30,40,50"))
    (tmp_path / "b.vcf").write_text(vcf("B", "2\t5\trs2\tG\tT,<NON_REF>\t60\t.\tDP=7;MQ=40.5\tGT:AD:PL\t1/1:0,7,0:20,5,0,30,40,50"))
    main(["--out", str(tmp_path / "out"), str(tmp_path / "a.vcf"), str(tmp_path / "b.vcf")])
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert lines[0] == "##fileformat=VCFv4.2" and body[0][:8] == ["1", "10", ".", "N" if body[0][3] == "N" else "C", "<NON_REF>", ".", ".", "END=20"]
    assert body[1][:5] == ["2", "5", "rs1;rs2", "G", "A,T,<NON_REF>"] and body[1][7] == "MQ=40.5;DP=16"
    assert body[1][9].split(":")[0] == "0/1" and body[1][10].split(":")[0] == "2/2"
    with pytest.raises(ValueError, match="more than one file"):
        main(["--out", str(tmp_path / "x"), str(tmp_path / "a.vcf"), str(tmp_path / "a.vcf")])


def test_partition_bounds(spark):
    calls = spark.createDataFrame([(0, "1", 5, 12), (1, "1", 15, 15), (2, "1", 30, 31)], "row_idx long, contig string, col_begin long, col_end long")
    assert [r.row_idx for r in intervals.load_partition(calls, 10, 20, True).orderBy("row_idx").collect()] == [0, 1]
    assert [r.row_idx for r in intervals.load_partition(calls, 10, 20, True, 3, 1).collect()] == [1]
    with pytest.raises(Exception, match="call outside the partition: row 2, column 30"):
        intervals.load_partition(calls, 10, 20).collect()


def test_projection(spark):
    columns = ["row_idx", "contig", "col_begin", "col_end", "ref", "alt", "gt", "pl", "dp", "dp_format", "id"]
    fields = {"pl": {"length": ["G"], "classes": ["FORMAT"]}, "dp_format": {"length": ["1"], "classes": ["FORMAT"]}}
    assert plan_columns(["pl"], fields, columns) == ["row_idx", "contig", "col_begin", "col_end", "ref", "alt", "pl", "gt"]
    assert plan_columns(["id"], fields, columns) == ["row_idx", "contig", "col_begin", "col_end", "id"]
    assert "pl" not in plan_columns([], fields, columns, sites_only=True) and "dp_format" in plan_columns([], fields, columns, sites_only=True)
    with pytest.raises(ValueError, match="unknown fields: nope"):
        plan_columns(["nope"], fields, columns)
    df = spark.sql("select struct(1 as a, 'x' as b) as pair")
    assert flatten_tuples(df, "pair").columns == ["pair_tuple_element_0", "pair_tuple_element_1"]
