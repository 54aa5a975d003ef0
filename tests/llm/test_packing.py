"""p2: packing keeps every item whole and wastes little."""

import math
import random

import numpy as np
import pytest

from locusforge.llm import packing


def placed(spark, rows, capacity):
    df = spark.createDataFrame(rows, "item string, length long, lead string, terms array<string>").selectExpr("*", "1 as batch_id", "2 as piece")
    return [r.asDict() for r in packing.pack(df.select("item", "length", "lead", "terms", "batch_id"), capacity).collect()]


def test_items_are_whole_batches_hold_and_little_is_wasted(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    r = random.Random(1)
    rows = [(f"i{i:04}", max(1, int(r.paretovariate(1) * 10)), r.choice(["hot", "hot", f"g{i % 7}"]), ["t", f"u{i % 5}"]) for i in range(900)]
    out, capacity = placed(spark, rows, 500), 500
    length, batches = {}, {}
    for o in out:
        length.setdefault(o["item"], []).append((o["piece_start"], o["piece_length"]))
        batches[o["batch_id"]] = batches.get(o["batch_id"], 0) + o["piece_length"]
    for item, n, _, _ in rows:
        at = 0
        for s, k in sorted(length[item]):
            assert s == at
            at += k
        assert at == n and len(length[item]) == math.ceil(n / capacity)
    assert max(batches.values()) <= capacity and all(batches[o["batch_id"]] == o["batch_length"] for o in out)
    assert len(batches) <= math.ceil(sum(n for _, n, _, _ in rows) / capacity) + 2


def test_related_items_lie_together(spark):
    rows = [(f"{g}{i}", 10, g, [g]) for g in "abcd" for i in range(5)]
    of = {}
    for o in placed(spark, rows, 50):
        of.setdefault(o["batch_id"], set()).add(o["item"][0])
    assert sorted(map(len, of.values())) == [1, 1, 1, 1]


def test_nulls_zeros_and_empty(spark):
    assert placed(spark, [], 10) == []
    out = placed(spark, [("a", None, None, None), ("b", 0, "x", []), (None, 5, "x", []), ("c", 10, None, [None]), ("d", 21, "x", None)], 10)
    assert sorted((o["item"], o["piece"], o["piece_length"]) for o in out) == [("c", 0, 10), ("d", 0, 10), ("d", 1, 10), ("d", 2, 1)]
    with pytest.raises(ValueError):
        placed(spark, [], 0)


def test_fill_prefers_longest_seed():
    lengths = np.array([3, 6, 4, 7])
    assert sorted(map(sorted, packing.fill(lengths, [[], [], [], []], 10))) == [[0, 3], [1, 2]]


def test_bm25_ranks_shared_rare_terms_first():
    index = packing.Bm25([["a", "x"], ["a"], ["x"], ["a", "b"], ["a"]])
    s = index.scores(0)
    assert s[2] > s[1] > s[3] > 0  # the rarer shared term, then the shorter list
