import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from locusforge.operators import references, skew
from locusforge.plans import problems


def test_tree_sums_match_for_hot_null_and_single_keys(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, r.randrange(10**6), -r.randrange(1000)]), r.choice([None, 1, 5])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "key string, pos int, cov int").withColumn("n_rows", F.lit("clash")).withColumn("__node", F.lit("clash")).repartition(7)
    for fan_in, partitions in ((2, None), (2, 60), (32, None)):
        out = skew.tree_aggregate(df.drop("n_rows"), ["key"], {"n": (F.count(F.lit(1)), "sum"), "top": (F.max("pos"), "max"), "least": (F.min("cov"), "min")}, fan_in, partitions)
        assert {x.key: (x.n, x.top, x.least) for x in out.collect()} == {k: (len(v := [x for x in rows if x[0] == k]), max(-(10**9) if x[1] is None else x[1] for x in v), min(x[2] or 9 for x in v)) for k in {x[0] for x in rows}}
    summary = {x.scaffold: (x.n_rows, x.covered_positions, x.n_complete, x.coverage_sum) for x in skew.position_summary(df.withColumnRenamed("key", "scaffold"), 2).collect()}
    assert summary == {k: (len(v := [x for x in rows if x[0] == k]), len({x[1] for x in v} - {None}), sum(x[2] is not None for x in v), sum(x[2] or 0 for x in v)) for k in ("hot", "a", "b")}
    counts = skew.count_by_key(df, F.col("key"))
    n = {k: sum(x[0] == k for x in rows) for k in ("hot", "a", "b")}
    assert {x.key for x in skew.heavy_keys(counts, 20).collect()} == {k for k in n if n[k] * 100 >= 20 * len(rows)}
    assert skew.heavy_keys(skew.count_by_key(df.limit(0), F.col("key")), 3).isEmpty()


def test_no_round_brings_more_than_fan_in_states_of_a_hot_key_together(spark, monkeypatch):
    """One key holds 90 % of the rows at ten positions; the states that meet are counted in every grouping of the tree."""
    fan_in, leaves, met = 4, 30, []
    rows = spark.range(0, 9000, 1, leaves).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("scaffold"), (F.col("id") % 10).cast("int").alias("pos"), F.lit(2).alias("cov"))
    states = {leaf: {(k, p // 256) for k, p, _ in map(tuple, rows.where(F.spark_partition_id() == leaf).collect())} for leaf in range(leaves)}
    for r in range(skew.rounds_for(leaves, fan_in)):  # one state a key and leaf, then one a key and node
        nodes, into = {}, {}
        for node, keys in states.items():
            for k in keys:
                into[node // fan_in, k] = into.get((node // fan_in, k), 0) + 1
            nodes.setdefault(node // fan_in, set()).update(keys)
        met.append(max(into.values()))
        states = nodes
    assert met == [4, 4, 2] and list(states) == [0]
    plan = skew.position_states(rows, fan_in)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f"div {fan_in}") >= 2 and plan.count("Aggregate [scaffold") == 3
    got = {r.scaffold: (r.n_rows, r.covered_positions, r.coverage_sum) for r in skew.position_summary(rows, fan_in).collect()}
    assert got["hot"] == (8100, 9, 16200) and sum(v[0] for v in got.values()) == 9000


def test_genome_summary_counts_a_scaffold_of_two_genomes_twice(spark):
    s = spark.createDataFrame([("x", 1, 1, 1, 2), ("y", 2, 2, 2, 4), ("z", 9, 9, 9, 9)], "scaffold string, n_rows long, covered_positions long, n_complete long, coverage_sum long")
    stb = spark.createDataFrame([("x", "g"), ("y", "g"), ("y", "h"), ("z", None)], "scaffold string, genome string")
    assert {r.genome: (r.n_scaffolds, r.n_rows, r.coverage_sum) for r in skew.genome_summary(s, stb).collect()} == {"g": (2, 3, 6), "h": (1, 2, 4)}


def test_orphans_match_brute_force(spark):
    r, t0 = random.Random(3), datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(days=r.randrange(120))
    refs = [(r.choice("st"), r.choice("abcdexx") if r.random() < 0.95 else None, when()) for _ in range(400)]
    refs += refs[:20]
    held = [(r.choice("abcdyx"), s := when(), r.choice([None, s + timedelta(days=r.randrange(-5, 40))])) for _ in range(25)] + [(None, t0, None)]
    want = {}
    for sample, k, at in refs:
        if k is not None and not any(h == k and a <= at and (e is None or e > at) for h, a, e in held):
            key = (f"{at:%Y-%m}", sample, k)
            want[key] = want.get(key, 0) + 1
    df = spark.createDataFrame(refs, "sample string, chrom string, loaded_at timestamp_ntz")
    parents = spark.createDataFrame(held, "scaffold string, loaded_at timestamp_ntz, removed_at timestamp_ntz")
    rows = references.reference_rows(df, "profile", F.col("chrom"), sample=F.col("sample"))
    other = references.reference_rows(df.limit(0), "p", F.col("chrom"))
    valid = references.validity(parents, "stb", F.col("scaffold"))
    got = references.orphan_report([rows, other], [valid, references.validity(parents.limit(0), "bed", F.col("scaffold"))], {"profile": ["stb", "bed"], "p": ["stb"]}).collect()
    assert {(x.period, x["sample"], x.key): x.n_rows for x in got if x.target_table == "stb"} == want
    assert sum(x.n_rows for x in got if x.target_table == "bed") == sum(x[1] is not None for x in refs) and {x.ref_table for x in got} == {"profile"}
    assert references.orphan_report([other], [valid], {"p": ["stb"]}).isEmpty()


def test_tables_are_read_once_for_all_their_targets(spark):
    plan = problems.p6_found(spark, "/root/testdata/sf0.01")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert final.count("FileScan parquet [sample") == 1 and "ReusedExchange" in final and "NestedLoop" not in final and "Cartesian" not in final


def test_the_rest_stands_without_the_llm_folder(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "locusforge", tmp_path / "locusforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'p3_found' in q and 'p8_found' not in q and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    for p in (root / "locusforge").rglob("*.py"):
        assert "llm" in p.parts or "locusforge.llm" not in p.read_text()
