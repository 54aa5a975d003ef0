import math
import random

import pytest
from fixtures import PROFILE, SIZES, STB, rows
from pyspark.sql import functions as F

from locusforge.functions.nullmodel import null_model, poisson_limits
from locusforge.operators import coverage, intervals


def stb(spark):
    return spark.createDataFrame(STB, "scaffold string, genome string")


@pytest.mark.parametrize("min_cov,freq", [(5, 0.8), (10, 0.5)])
def test_heterogeneity_matches_brute_force(spark, min_cov, freq):
    data = rows("a") + [("a", "lost", 0, "NA", 9, 9, 0, 0), ("a", "lost", 1, None, None, 0, 0, 0)]
    genome, want = dict(STB), {}
    for _, chrom, _, _, *c in data:
        c = [x or 0 for x in c]
        if sum(c) >= min_cov:
            n, h = want.get(genome.get(chrom), (0, 0))
            want[genome.get(chrom)] = n + 1, h + (max(c) / sum(c) < freq)
    got = coverage.strain_heterogeneity(spark.createDataFrame(data, PROFILE), stb(spark), min_cov, freq).collect()
    assert {r.genome: (r[f"total_sites_at_{min_cov}_coverage"], r.heterogeneous_sites) for r in got} == want
    assert all(r.strain_heterogeneity == r.heterogeneous_sites / r[f"total_sites_at_{min_cov}_coverage"] for r in got)


def test_lengths_breadth_and_matrices(spark):
    bed = spark.createDataFrame([(c, 0, n // 2) for c, n in SIZES.items()] + [(c, n // 2, n) for c, n in SIZES.items()], "scaffold string, start long, end long")
    lengths = coverage.genome_lengths(stb(spark), bed)
    assert {r.genome: r.genome_length for r in lengths.collect()} == {"genome1": 30, "genome2": 30}
    data = rows("a") + rows("b", chroms=("chr3",))
    b = coverage.genome_breadth(spark.createDataFrame(data, PROFILE), lengths, stb(spark))
    want = {}
    for s, chrom, _, _, *c in data:
        if sum(c) >= 1:
            k = (s, dict(STB)[chrom])
            want[k] = want.get(k, 0) + 1
    assert {(r.sample, r.genome): r.breadth for r in b.collect()} == {k: n / 30 for k, n in want.items()}
    matrix = coverage.breadth_matrix(b, ["a", "b"])
    assert {r.genome: r.b is None for r in matrix.collect()} == {"genome1": True, "genome2": False}
    tables = [b.where(F.col("sample") == s).select("genome", F.col("breadth").alias(s)) for s in "ab"]
    joined = coverage.collect_breadth_tables(tables)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, matrix.collect()))
    assert {(r.genome, r["sample"]): r.breadth for r in coverage.unpivot_breadth(joined).collect()}["genome1", "b"] == 0.0
    for bad in (lambda: coverage.collect_breadth_tables([]), lambda: coverage.breadth_matrix(b, [])):
        with pytest.raises(ValueError):
            bad()


def test_null_model(spark):
    limits = dict(poisson_limits())
    assert len(limits) == 10_000 and [limits[n] for n in (153, 154, 1066, 1067, 2453, 2454, 9855, 9856)] == [0, 1, 1, 2, 2, 3, 6, 7]
    for n in (1, 500, 3000, 10_000):
        mean, k = n * 0.001 / 3, limits[n]
        tail = lambda j: 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(j))
        assert tail(k) > 0.05 >= tail(k + 1)
    assert null_model(spark, max_total_reads=3).count() == 3


def test_annotation_matches_brute_force(spark):
    r = random.Random(2)
    ranges = [(f"g{i}", r.choice("xy"), s := r.randrange(300), s + r.randrange(60)) for i in range(40)] + [("same1", "x", 10, 20), ("same2", "x", 10, 15), (None, "x", 0, 300), ("bad", "x", 9, 3)]
    positions = [(r.choice("xyz"), r.randrange(400)) for _ in range(300)] + [(None, 3)]
    want = [(c, p, max(((a, g) for g, s, a, e in ranges if g and s == c and a <= p <= e), default=(0, "NA"))[1]) for c, p in positions]
    p = spark.createDataFrame(positions, "chrom string, pos int").withColumn("gene", F.lit("old"))
    got = intervals.annotate_genes(p, spark.createDataFrame(ranges, "gene string, scaffold string, start int, end int"), bin_size=25)
    key = lambda t: tuple(str(x) for x in t)
    assert sorted(((r.chrom, r.pos, r.gene) for r in got.collect()), key=key) == sorted(want, key=key)


def test_ranges_segments_headers_and_sequences(spark):
    ranges = spark.createDataFrame([("g", "x", "3", "5"), ("h", "y", "1", "1"), ("i", "y", "2", "1")], "gene string, scaffold string, start string, end string")
    assert sorted((r.scaffold, r.pos) for r in intervals.explode_ranges(ranges).collect()) == [("x", 3), ("x", 4), ("x", 5), ("y", 1)]
    only = spark.createDataFrame([("y",)], "scaffold string")
    assert intervals.explode_ranges(ranges, only).count() == 1
    s = intervals.segments(spark.createDataFrame([("a", 10), ("b", 25), ("c", 0), ("d", None)], "scaffold string, length long"), 10)
    assert sorted(map(tuple, s.collect())) == [("a", 0, 10), ("b", 0, 10), ("b", 10, 20), ("b", 20, 25)]
    lines = spark.createDataFrame([(">sc_1_7 # 100 # 400 # 1 # ID",), ("ACGT",), (">odd",)], "value string")
    assert [tuple(r) for r in intervals.gene_ranges(lines).collect()] == [("sc_1_7", "sc_1", 100, 400), ("odd", "odd", None, None)]


def test_fasta(spark, tmp_path):
    from locusforge.sources import io

    (tmp_path / "x.fa").write_text(">one first\nACGT\nAC\r\n>two\n\n>three\nA\n")
    got = {r.scaffold: r.length for r in io.read_fasta_lengths(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"one": 6, "two": 0, "three": 1}
    with pytest.raises(FileNotFoundError):
        io.read_fasta_lengths(spark, str(tmp_path / "none.fa"))


def test_chunks_are_contiguous_and_the_last_takes_the_rest(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "i int").repartition(5)
    got = {}
    for r in intervals.chunks(df, 5, ["i"]).collect():
        got.setdefault(r.chunk, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9, 10, 11], 3: [12, 13, 14, 15], 4: list(range(16, 23))}
    assert intervals.chunks(df.limit(0), 3, ["i"]).isEmpty()
    with pytest.raises(ValueError):
        intervals.chunks(df, 0, ["i"])
