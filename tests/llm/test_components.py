"""p5: connected components against brute force."""

import random

import pyarrow as pa

from locusforge.llm import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, a, b in edges:
        if None not in (g, a, b) and a != b:
            parent[find((g, a))] = find((g, b))
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return sorted((x[0], min(m[1] for m in ms), x[1]) for ms in groups.values() for x in ms)


def found(spark, edges, **kw):
    df = spark.createDataFrame(edges, "g string, a string, b string").repartition(5).selectExpr("*", "1 as root", "2 as node")
    return sorted(tuple(r) for r in components.connected_components(df, "g", "a", "b", **kw).collect())


def some_edges(seed):
    r = random.Random(seed)
    edges = [(r.choice("xy"), f"n{r.randrange(120)}", f"n{r.randrange(120)}") for _ in range(90)]
    edges += [("chain", f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("star", "s", f"t{i}") for i in range(60)]
    return edges + edges[:20] + [(None, "a", "b"), ("x", None, "b"), ("x", "a", None), ("x", "self", "self")]


def test_forests(spark):
    edges = some_edges(1)
    assert found(spark, edges, fan_in=2) == brute(edges)


def test_graphs_above_the_bound_are_split_by_their_records(spark):
    edges = some_edges(2)
    assert found(spark, edges, bound=20) == brute(edges)


def test_a_record_with_more_neighbours_than_the_bound(spark):
    edges = [("g", "m", f"{r}{i:03}") for i in range(120) for r in "az"] + [("g", f"z{i:03}", f"z{i + 1:03}") for i in range(40)]
    assert found(spark, edges, bound=20) == brute(edges)


def test_very_many_small_graphs_in_one_partition_leave_one_by_one():
    rows = [(f"g{i:05}", f"n{k}", f"n{k + 1}") for i in range(3000) for k in range(3)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[s : s + 500])], names=["graph", "node", "root"]) for s in range(0, len(rows), 500)]
    out, size = [], []
    for b in components._forest(800, own=True)(iter(batches)):
        size.append(b.num_rows)
        out += zip(*(c.to_pylist() for c in b.columns))
    assert sorted(out) == sorted((f"g{i:05}", f"n{k}", "n0", True) for i in range(3000) for k in range(4)) and max(size) <= 104 and len(size) > 100


def test_empty(spark):
    assert found(spark, []) == []
