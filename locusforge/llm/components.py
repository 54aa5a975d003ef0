"""Groups of records that pairwise matches link directly or through others.

Union-find runs inside partitions of edges; only a spanning forest of each partition goes on. Forests are merged
in rounds: each round brings fewer sets of forests together until one partition holds the forest of one graph. A task
never holds more than about ``bound`` records: rows come in order of their graphs, a graph is put out as soon as it ends, and
one that grows larger is put out in pieces. The records of such graphs are then split by ranges of hashes, and the forests of
those ranges, in which every record meets all its neighbours, are merged by their roots until they no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from locusforge.session import cut_lineage, shuffle_partitions

#: Records that one task holds (about 0.3 GB of Python objects).
BOUND = 1_000_000
FAN_IN = 8
_SCHEMA = pa.schema([("graph", pa.string()), ("node", pa.string()), ("root", pa.string()), ("whole", pa.bool_())])
_DDL = "graph string, node string, root string, whole boolean"


class _Forest:
    """Union-find over (graph, record)."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.parent: list[int] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, graph: str, x: str, y: str) -> None:
        ids, parent = self.ids, self.parent
        i = ids.setdefault((graph, x), len(parent))
        if i == len(parent):
            parent.append(i)
        j = ids.setdefault((graph, y), len(parent))
        if j == len(parent):
            parent.append(j)
        i, j = self.find(i), self.find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)

    def stars(self, own: bool, cut: set[str]) -> Iterator[pa.RecordBatch]:
        """(graph, node, root, whole): every record with the smallest of its tree, that one itself only if ``own``."""
        names, least = list(self.ids), {}
        for i, k in enumerate(names):
            r = self.find(i)
            if r not in least or k < least[r]:
                least[r] = k
        out: list[list] = [[], [], [], []]
        for i, k in enumerate(names):
            root = least[self.find(i)]
            if own or k != root:
                for column, v in zip(out, (*k, root[1], k[0] not in cut)):
                    column.append(v)
            if len(out[0]) >= 50_000:
                yield _batch(out)
                out = [[], [], [], []]
        if out[0]:
            yield _batch(out)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _forest(bound: int, own: bool = False, by_record: bool = False):
    """Forests of (graph, node, root) rows. Rows in order of their graphs are put out graph by graph; ``whole`` says whether all
    rows of the graph that the task got are in one forest. With ``by_record`` rows are in order of graph and node, and the rows
    of a record stay in one forest."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut, last, record = _Forest(), set(), None, None
        for b in batches:
            for g, x, y in zip(*(b.column(i).to_pylist() for i in range(3))):
                n = len(held.parent)
                if n >= bound and (not by_record or x != record or g != last):  # a piece of the graph at hand
                    cut.add(g)
                    yield from held.stars(own, cut)
                    held = _Forest()
                elif g != last and n >= bound // 8:
                    yield from held.stars(own, cut)
                    held, cut = _Forest(), cut & {g}
                held.link(g, x, y)
                last, record = g, x
        yield from held.stars(own, cut)

    return over


def _united(edges: DataFrame, bound: int, sets: int) -> DataFrame:
    """(graph, node, root) of graphs too large for one task, by union-find over hash ranges of their records.

    Each round has two steps. In the first every record meets all its neighbours, and they join the smallest; in the second
    every record meets the smaller ones it was joined to, whose trees join in turn. Links of a record with more than ``bound``
    neighbours are split over several ranges; the pieces meet again in the second step. It ends when every record has one root
    and no root has another.
    """
    union = _forest(bound, by_record=True)
    columns = ["graph", "node", "root"]
    rows = edges.select(*columns).distinct()
    while True:
        both = rows.select("graph", F.inline(F.array(F.struct(F.col("node").alias("u"), F.col("root").alias("v")), F.struct(F.col("root").alias("u"), F.col("node").alias("v")))))
        parts = both.groupBy("graph", "u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound).select("graph", "u", F.ceil(F.col("n") / bound).alias("parts"))
        placed = both.join(parts, ["graph", "u"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)))
        placed = placed.repartition(sets, "graph", "u", "part").sortWithinPartitions("graph", "u").select("graph", F.col("u").alias("node"), F.col("v").alias("root"))
        near = placed.mapInArrow(union, _DDL).select(*columns)
        far = near.repartition(sets, "graph", "node").sortWithinPartitions("graph", "node").mapInArrow(union, _DDL)
        rows = cut_lineage(far.select(*columns).distinct())
        several = rows.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        deep = rows.select("graph", F.col("root").alias("node")).join(rows.select("graph", "node"), ["graph", "node"], "left_semi")
        if several.isEmpty() and deep.isEmpty():
            return rows.unionByName(rows.select("graph", F.col("root").alias("node"), "root").distinct())


def connected_components(links: DataFrame, graph: str, a: str, b: str, fan_in: int = FAN_IN, bound: int = BOUND) -> DataFrame:
    """``graph, root, node``: one row per record of a group of two or more; root is the smallest record in it.

    links: any number of rows, repeated, in either direction, links of a record with itself or with a null end
    (both link nothing) included; a null graph is no graph. Records are strings and compared bytewise. An empty
    input gives an empty result; columns that are not named do not matter.
    """
    edges = links.select(F.col(graph).cast("string").alias("graph"), F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("root"))
    forest = edges.dropna().where("node <> root").mapInArrow(_forest(bound), _DDL)
    sets = every = shuffle_partitions(links.sparkSession)
    while sets > fan_in:
        sets = -(-sets // fan_in)
        # forests of one graph come together in `sets` partitions, whatever they hold
        placed = forest.withColumn("set", F.pmod(F.xxhash64("node", "root"), F.lit(sets))).repartition("graph", "set").sortWithinPartitions("graph")
        forest = placed.select("graph", "node", "root").mapInArrow(_forest(bound), _DDL)
    placed = forest.select("graph", "node", "root").repartition("graph").sortWithinPartitions("graph")
    last = cut_lineage(placed.mapInArrow(_forest(bound, own=True), _DDL))
    # a graph that came in pieces may have put out some of them before it was known to be too large
    cut = last.where("not whole").select("graph").distinct()
    if cut.isEmpty():
        return last.select("graph", "root", "node")
    done = last.join(cut, "graph", "left_anti").select("graph", "root", "node")
    rest = last.join(cut, "graph", "left_semi").where("node <> root")
    return done.unionByName(_united(rest, bound, every).select("graph", "root", "node"))
