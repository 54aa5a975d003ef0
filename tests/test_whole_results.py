"""Queries give whole results: no list of ids, labels or coverages in the code limits them."""

from __future__ import annotations

import math
from datetime import datetime

from locusforge.functions.nullmodel import poisson_limits
from locusforge.plans import reference

AT = datetime(2024, 1, 1)


def save(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def profile_tables(spark, folder, rows):
    """rows: sample, chrom, pos, A, C, G, T. The scaffolds x and y lie in the genomes gx and gy, of 10 and 20 positions."""
    save(spark, folder, "profile", [(s, c, p, "NA", *n, AT) for s, c, p, *n in rows], "sample string, chrom string, pos int, gene string, A int, C int, G int, T int, loaded_at timestamp")
    save(spark, folder, "stb", [("x", "gx", None), ("y", "gy", None)], "scaffold string, genome string, removed_at timestamp")
    save(spark, folder, "genomes_bed_file", [("x", 0, 10, None), ("y", 0, 20, None)], "scaffold string, start_pos long, end_pos long, removed_at timestamp")
    return str(folder)


def test_breadth_has_every_sample(spark, tmp_path):
    rows = [(s, c, p, n, 0, 0, 0) for s, c, k, n in (("S0000000", "x", 2, 3), ("other", "x", 5, 1), ("other", "y", 4, 7), ("third", "y", 1, 1), ("bare", "x", 3, 0)) for p in range(k)]
    d = profile_tables(spark, tmp_path, rows)
    covered = {(g, s): 0.0 for g in ("gx", "gy") for s in ("S0000000", "other", "third", "bare")}
    for s, c, _, *n in rows:
        covered["g" + c, s] += (sum(n) > 0) / {"x": 10, "y": 20}[c]
    long = reference.breadth_unpivot(spark, d).collect()
    assert len(long) == 8 and {(r.genome, r["sample"]): round(r.breadth, 9) for r in long} == {k: round(v, 9) for k, v in covered.items()}
    matrix = reference.breadth_matrix_full_join(spark, d)
    assert matrix.columns == ["genome", "S0000000", "bare", "other", "third"]
    assert {(r.genome, s): round(r[s] or 0.0, 9) for r in matrix.collect() for s in matrix.columns[1:]} == {k: round(v, 9) for k, v in covered.items()}


def test_ibs_lists_have_every_label(spark, tmp_path):
    people = {"A": "lowland_a", "B": "lowland_a", "C": "coast", "D": "x.y`z", "E": None}
    data = [("g1", "A", "B", 9), ("g1", "A", "C", 5), ("g1", "B", "C", 4), ("g1", "C", "D", 3), ("g2", "A", "D", 8), ("g2", "A", "E", 2)]
    save(spark, tmp_path, "comparison", [(g, 20000, 1, 0.5, v, 1, 1, 1.0, a, b, AT) for g, a, b, v in data], "genome string, total_positions long, share_allele_pos long, genome_pop_ani double, max_consecutive_length long, shared_genes_count long, identical_gene_count long, perc_id_genes double, sample_1 string, sample_2 string, compared_at timestamp")
    save(spark, tmp_path, "sample_population", list(people.items()), "sample string, population string")
    want = {}
    for g, a, b, v in data:
        p = sorted(filter(None, (people[a], people[b])))
        if len(p) == 2:
            want.setdefault((g, ("within" if p[0] == p[1] else "between") + "_population_" + "|".join(p)), []).append(v)
    got = reference.ibs_lists(spark, str(tmp_path))
    labels = sorted({k for _, k in want})
    assert len(labels) == 4 and got.columns == ["genome", *labels]
    assert {(r[0], k): x for r in got.collect() for k, x in zip(labels, r[1:])} == {(g, k): ",".join(map(str, sorted(want.get((g, k), [-1])))) for g in ("g1", "g2") for k in labels}


def limit(cov):
    """Greatest k that at least that many errors reach with a probability of more than 5 %."""
    mean, k, below = cov * 0.001 / 3, 0, 0.0
    while 1 - (below := below + math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))) > 0.05:
        k += 1
    return k


def test_error_filter_keeps_deep_loci(spark, tmp_path):
    rows = [(s, "x", p, *counts) for s, turn in (("S0", False), ("S1", True)) for p, n in enumerate((6, 99, 100, 160, 2000, 9999, 10_001, 25_000)) for counts in [(1, n - 9, 2, 6) if n > 9 else (n, 0, 0, 0)] for counts in [counts[::-1] if turn else counts]]
    d = profile_tables(spark, tmp_path, rows)
    want = {(s, p): tuple(n if n >= limit(sum(c)) else 0 for n in c) for s, _, p, *c in rows}
    assert max(limit(sum(c)) for *_, c in ((s, p, c) for s, _, p, *c in rows)) > 7 and all(map(any, want.values()))
    assert {(r["sample"], r.pos): (r.A, r.C, r.G, r.T) for r in reference.error_adjust(spark, d).collect()} == want
    r = reference.compare_genomes_error_model(spark, d).first()
    assert (r.total_positions, r.share_allele_pos) == (8, 0)  # no two top bases are the same, however deep


def test_null_model_of_great_coverage_ends():
    limits = poisson_limits(error_rate=0.9, max_total_reads=4000)
    assert len(limits) == 4000 and limits[-1][1] == 1257
