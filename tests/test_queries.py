"""Every registered query against its SQL, and properties of the sweep."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusweave import registry
from locusweave.functions import alleles as A
from locusweave.operators import analytics, intervals
from locusweave.sources import metadata
from locusweave.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("lineitem", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    cursor = duck.execute(registry.oracle_sql()[name])
    order = [d[0] for d in cursor.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 8), st.booleans()), min_size=1, max_size=12))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_sweep_against_positions(spark, raw):
    seen, rows = set(), []
    for row, begin, length, deletion in raw:
        if (row, begin) not in seen:
            seen.add((row, begin))
            rows.append((row, "c", begin, begin + (2 if deletion else length), "TGG" if deletion else "T", ["T", "<NON_REF>"] if deletion else ["<NON_REF>"]))
    calls = spark.createDataFrame(rows, "row_idx long, contig string, col_begin long, col_end long, ref string, alt array<string>")
    got = {(r.s, r.t): set(r.m) for r in intervals.sweep(calls).groupBy("s", "t").agg(F.collect_list(F.struct("row_idx", "col_begin")).alias("m")).collect()}
    active = {}
    for row, _, b, e, ref, _ in rows:
        following = [x[2] for x in rows if x[0] == row and x[2] > b]
        for p in range(b, min([e, *(f - 1 for f in following)]) + 1):
            active.setdefault(p, set()).add((row, b, len(ref) == 3))
    want, p = {}, 0
    for p in sorted(active):
        members = {(r, b) for r, b, _ in active[p]}
        last = max(want, default=None, key=lambda k: k[1])
        if last and last[1] == p - 1 and want[last] == members and not any(d for *_, d in active[p]):
            del want[last]
            want[last[0], p] = members
        else:
            want[p, p] = members
    assert {k: {tuple(x) for x in v} for k, v in got.items()} == want


def test_genotype_order_and_index(spark):
    for ploidy in (1, 2, 3, 4):
        g = A.genotypes(4, ploidy)
        assert len(g) == A.genotype_count(4, ploidy)
        df = spark.createDataFrame([(list(x),) for x in g], "g array<int>")
        assert [r[0] for r in df.select(A.genotype_index(F.col("g"))).collect()] == list(range(len(g)))


def test_equi_load_bins_restart_after_overshoot(spark):
    h = spark.createDataFrame([(i, n) for i, n in enumerate([5, 1, 1, 9, 2, 2, 1])], "bin long, n long")
    assert [tuple(r) for r in analytics.equi_load_bins(h, 3).orderBy("first").collect()] == [(0, 2, 7), (3, 3, 9), (4, 6, 5)]
    with pytest.raises(ValueError):
        analytics.equi_load_bins(h, 7)


def test_intervals_from_configuration():
    contigs = [("1", 1000, 0), ("2", 500, 1000)]
    assert metadata.parse_intervals([[5, 2], 7, "2", {"2": [10, 9999]}, {"1": 3}, "1:20-30"], contigs) == [(0, 2, 2), (1, 2, 5), (2, 7, 7), (3, 19, 29), (4, 1000, 1499), (5, 1009, 1499)]
    with pytest.raises(ValueError):
        metadata.parse_intervals([{"2": [501, 502]}], contigs)
    with pytest.raises(ValueError):
        metadata.parse_intervals([[-1, 4]], contigs)
    assert metadata.partitions([{"begin": 100}, {"begin": 0}]) == [(0, 0, 99), (1, 100, metadata.LAST)]


def test_stream_is_idempotent_and_checks_keys(spark, tmp_path):
    a = spark.createDataFrame([(1, 2), (3, 4)], "row_idx long, col_begin long")
    a.coalesce(1).write.parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, ingest.append_all(spark, f"{tmp_path}/in", ("row_idx", "col_begin")).collect())) == [(1, 2), (3, 4)]
    a.unionByName(a).coalesce(1).write.parquet(f"{tmp_path}/twice")
    with pytest.raises(Exception, match="repeat row_idx, col_begin"):
        ingest.append_all(spark, f"{tmp_path}/twice", ("row_idx", "col_begin"))
    batch = spark.createDataFrame([(1, 3), (1, 9), (2, 1)], "row_idx long, col_begin long")
    assert [r.row_idx for r in ingest.out_of_order(batch, spark.createDataFrame([(1, 5), (2, 1)], batch.schema), "row_idx", "col_begin").collect()] == [1]
    done = []
    ingest.import_samples(lambda names: spark.createDataFrame([(n,) for n in names], "sample string"), list("abcde"), f"{tmp_path}/samples", 2, done.append)
    assert done == [0, 1, 2] and spark.read.parquet(f"{tmp_path}/samples").count() == 5
