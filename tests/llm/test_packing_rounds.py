"""p2: rounds that close few batches go on with other neighbours."""

import pyarrow as pa

from locusforge.llm import packing


def test_rounds_that_gain_little_are_mixed(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    monkeypatch.setattr(packing, "SHARDS", 1)
    # the items of the two genomes lie in different shards; only items of both fill a batch
    a, b = "g0", "g1"
    for long, short in ((300, 200), (290, 200)):  # the second never fills a batch to the share that closes it
        rows = [(f"{g}-{i}", n, g, [g]) for g, n in ((a, long), (b, short)) for i in range(100)]
        out = packing.pack(spark.createDataFrame(rows, "item string, length long, lead string, terms array<string>"), 500).collect()
        assert sorted((r["item"], r.piece_length) for r in out) == sorted((i, n) for i, n, *_ in rows)
        size = {}
        for r in out:
            size[r.batch_id] = size.get(r.batch_id, 0) + r.piece_length
        assert all(size[r.batch_id] == r.batch_length <= 500 for r in out)
        assert len(size) < 120, (long, len(size))  # 150 before, 100 at best


def test_a_hot_leading_term_is_cut_into_shards_of_bounded_size(spark, monkeypatch):
    sizes = []
    fill = packing.fill
    monkeypatch.setattr(packing, "SHARD", 50)
    rows = [(f"i{i:04}", 1 + i % 90, "hot" if i % 3 == 0 else f"g{i}", ["t"]) for i in range(1500)]
    df = spark.createDataFrame(rows, "item string, length long, lead string, terms array<string>")
    out = packing.pack(df, 100).collect()
    assert sorted((r["item"], r.piece_length) for r in out) == sorted((i, n) for i, n, *_ in rows)
    batches = {}
    for r in out:
        batches[r.batch_id] = batches.get(r.batch_id, 0) + r.piece_length
    assert max(batches.values()) <= 100 and len(batches) <= 1.06 * sum(n for _, n, *_ in rows) / 100
    monkeypatch.setattr(packing, "fill", lambda lengths, terms, capacity: sizes.append(len(lengths)) or fill(lengths, terms, capacity))
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 3})())}))
    t = pa.table({"item": [f"i{k}" for k in range(130)], "lead": ["hot"] * 130, "terms": [["t"]] * 130, "piece": [0] * 130, "piece_start": [0] * 130, "length": [7] * 130})
    rows = [r for b in packing._packer(100, 0)(iter(t.to_batches(max_chunksize=40))) for r in b.to_pylist()]
    assert sizes == [50, 50, 30] and len(rows) == 130 and {r["batch_id"].rsplit("-", 1)[0] for r in rows} == {"0-3-0", "0-3-1", "0-3-2"}
