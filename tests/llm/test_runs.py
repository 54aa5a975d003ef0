"""p1: repeated runs against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from locusforge.llm.runs import agglomerate, repeated_runs


def brute(rows, max_gap, max_step, min_rows):
    best = {}
    for seq, at, stamp, *v in rows:
        if seq is None or at is None or None in v:
            continue
        k = (seq, at)
        if k not in best or (stamp, v) > best[k]:
            best[k] = (stamp, v)
    out, run = [], []
    for (seq, at), (_, v) in sorted(best.items()):
        if run and not (run[-1][0] == seq and (max_gap is None or at - run[-1][1] <= max_gap) and all(abs(a - b) <= max_step for a, b in zip(v, run[-1][2]))):
            out.append(run)
            run = []
        run.append((seq, at, v))
    out += [run] if run else []
    return sorted((r[0][0], r[0][1], r[-1][1], len(r)) for r in out if len(r) >= min_rows)


def found(spark, rows, max_gap, max_step, min_rows, chunk, **kw):
    df = spark.createDataFrame(rows, "k string, pos long, stamp int, a int, b int").withColumn("seq", F.lit("clash"))
    out = repeated_runs(df, F.col("k"), F.col("pos"), [F.col("a"), F.col("b")], max_gap=max_gap, max_step=max_step, min_rows=min_rows, chunk=chunk, prefer=[F.col("stamp")], **kw)
    return sorted(tuple(r) for r in out.collect())


def test_matches_brute_force_with_nulls_ties_and_a_hot_sequence(spark):
    r = random.Random(3)
    rows = []
    for k, n in (("hot", 3000), ("b", 60), ("c", 1), (None, 20)):
        rows += [(k, r.randrange(0, 3 * n), r.randrange(3), r.choice([0, 1, 1, 2, 9, None]), r.choice([5, 5, 6])) for _ in range(n)]
    rows += rows[:50] + [("b", None, 1, 1, 1)]
    for gap, step, least, chunk in ((3, 1, 2, 16), (None, 1, 3, 64), (5, 10, 1, 7), (3, 0, 2, 10**9)):
        assert found(spark, rows, gap, step, least, chunk) == brute(rows, gap, step, least)


def test_a_run_over_many_chunks_is_one(spark):
    rows = [("x", i, 0, 1, 1) for i in range(500)]
    assert found(spark, rows, 1, 0, 5, 3) == [("x", 0, 499, 500)]


def test_a_dropped_run_between_two_keeps_them_apart(spark):
    rows = [("x", i, 0, 9 if i == 5 else 1, 1) for i in range(11)]
    assert found(spark, rows, 3, 1, 2, 4) == [("x", 0, 4, 5), ("x", 6, 10, 5)]


def test_empty(spark):
    assert found(spark, [], 3, 1, 1, 10) == []


def test_agglomerate_heads():
    at, v = np.array([1, 2, 9, 10, 11]), np.array([[1], [2], [3], [4], [9]])
    fresh = np.array([True, False, False, False, False])
    assert agglomerate(at, at, v, v, fresh, 2, 1).tolist() == [0, 0, 2, 2, 4]


def by_means(at, v, fresh, max_gap, max_step, earliest=False):
    """Merge the most similar neighbours, all pairs scored anew each time; with ``earliest`` the first that meet the limits."""
    runs = [[i] for i in range(len(at))]
    while True:
        best = None
        for k in range(len(runs) - 1):
            a, b = runs[k], runs[k + 1]
            gap = at[b[0]] - at[a[-1]]
            step = max(abs(np.mean(v[a], axis=0) - np.mean(v[b], axis=0)))
            if not fresh[b[0]] and step <= max_step and (max_gap is None or gap <= max_gap) and (best is None or not earliest and (round(step, 9), gap, k) < best):
                best = (round(step, 9), gap, k)
        if best is None:
            return [r[0] for r in runs for _ in r]
        runs[best[2] : best[2] + 2] = [runs[best[2]] + runs[best[2] + 1]]


def test_means_are_scored_again_after_every_merge():
    r = random.Random(8)
    other = 0
    for _ in range(150):
        n = r.randrange(2, 40)
        at = np.cumsum([r.choice([1, 1, 2, 7]) for _ in range(n)])
        v = np.array([[r.randrange(8), r.randrange(3)] for _ in range(n)])
        fresh = np.array([True] + [r.random() < 0.1 for _ in range(n - 1)])
        gap = r.choice([None, 2])
        got = agglomerate(at, at, v, v, fresh, gap, 2, "mean", v, np.ones(n, int)).tolist()
        assert got == by_means(at, v, fresh, gap, 2)
        other += got != by_means(at, v, fresh, gap, 2, earliest=True)
    assert other > 20  # the order of merges matters


def test_mean_runs_end_where_a_drift_has_gone_too_far(spark):
    rows = [("x", i, 0, i // 2, 0) for i in range(40)]
    assert found(spark, rows, 1, 1, 1, 1000) == [("x", 0, 39, 40)]
    means = found(spark, rows, 1, 1, 1, 1000, linkage="mean")
    assert len(means) > 5 and sum(m[3] for m in means) == 40
    v = np.array([[i // 2, 0] for i in range(40)])
    heads = by_means(np.arange(40), v, np.arange(40) == 0, 1, 1)
    assert [m[1] for m in means] == sorted(set(heads))
    assert sum(m[3] for m in found(spark, rows, 1, 1, 1, 7, linkage="mean")) == 40 and found(spark, [], 1, 1, 1, 7, linkage="mean") == []
