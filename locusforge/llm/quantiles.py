"""Percentiles with a guaranteed rank error from mergeable q-digests.

A value is a leaf of a binary tree over the universe [-2**33, 2**33), which holds every 32-bit count and the sum of four of
them; a node stands for a dyadic range. A digest is a set of nodes with counts. Compression moves a pair of siblings into
their parent wherever the three together count at most ``n // (LEVELS * SHARE)``. Every node above the leaves then counts at
most that, so that a percentile read from the digest has a rank error of at most ``LEVELS`` times as much, i.e. a
``SHARE``-th of the values. Digests merge by adding the counts of equal nodes, and the errors of merged digests add up to at
most the same share of the sum. As long as ``n`` is below ``LEVELS * SHARE`` nothing is compressed and percentiles are exact.

A row holds the digests of all metrics of one key, packed as pairs of 64-bit numbers: metric and node, count. Rows are packed
inside each input partition, so that values are never shuffled one by one, and merged in a tree of bounded fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from locusforge.operators.skew import FAN_IN, rounds_for

#: Levels of the tree, i.e. bits of the universe, and its least value.
LEVELS, LEAST = 34, -(2**33)
#: The rank error is at most this part of the number of values.
SHARE = 1000
#: Rows that are packed, and nodes that are merged, in one go.
ROWS, NODES = 400_000, 1_000_000
_NODE_BITS, _METRIC_BITS = LEVELS + 1, 4
_CODE_BITS = _NODE_BITS + _METRIC_BITS
_NODE, _CODE = (1 << _NODE_BITS) - 1, (1 << _CODE_BITS) - 1


def rank_error(n: str) -> Column:
    """The bound of the rank error of ``n`` values, as :func:`most` makes it."""
    return F.expr(f"(`{n}` div {LEVELS * SHARE}) * {LEVELS}")


def most(n, share: int = SHARE):
    """Count that a node above the leaves may have in a digest of ``n`` values."""
    return n // (LEVELS * share)


def compress(node: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes and counts with every pair of siblings moved up where the family counts at most ``limit``."""
    done_node, done_n = [], []
    order = np.argsort(node, kind="stable")
    node, n = node[order], n[order]
    for level in range(LEVELS, 0, -1):
        at = np.searchsorted(node, 1 << level)  # nodes of this level are the greatest that are left
        low, low_n = node[at:], n[at:]
        if not len(low):
            continue
        parent, first = np.unique(low >> 1, return_index=True)
        pair = np.add.reduceat(low_n, first)
        up = np.searchsorted(node[:at], parent)
        up_ok = (up < at) & (node[np.minimum(up, max(at - 1, 0))] == parent) if at else np.zeros(len(parent), bool)
        total = pair + np.where(up_ok, n[np.minimum(up, max(at - 1, 0))] if at else 0, 0)
        move = total <= limit
        which = np.searchsorted(parent, low >> 1)
        stay = ~move[which]
        done_node.append(low[stay])
        done_n.append(low_n[stay])
        base = n[:at].copy()
        base[up[move & up_ok]] = total[move & up_ok]
        add = move & ~up_ok
        node, n = np.concatenate([node[:at], parent[add]]), np.concatenate([base, total[add]])
        order = np.argsort(node, kind="stable")
        node, n = node[order], n[order]
    done_node.append(node)
    done_n.append(n)
    node, n = np.concatenate(done_node), np.concatenate(done_n)
    order = np.argsort(node)
    return node[order], n[order]


def node_range(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each node."""
    shift = LEVELS + 1 - np.frexp(node.astype(float))[1]
    return (node << shift) - (1 << LEVELS) + LEAST, ((node + 1) << shift) - 1 - (1 << LEVELS) + LEAST


def leaf(value: np.ndarray) -> np.ndarray:
    """Leaves of whole numbers; those outside the universe become its ends."""
    return np.clip(value, LEAST, LEAST + 2**LEVELS - 1) - LEAST + (1 << LEVELS)


# Nodes of many groups lie in one array of ``at`` = group, metric and node as one number, in order, and one of counts.


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _added(at: np.ndarray, n: np.ndarray | None, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal nodes added up, and the digests of large groups compressed. Without ``n`` each counts 1."""
    if n is None:
        at = np.sort(at)
    else:
        order = np.argsort(at, kind="stable")
        at, n = at[order], n[order]
    first = _runs(at)
    n = np.diff(np.append(first, len(at))) if n is None else np.add.reduceat(n, first) if len(first) else n
    at = at[first]
    segment = _runs(at >> _NODE_BITS)
    limit = most(np.add.reduceat(n, segment), share) if len(segment) else segment
    large = np.flatnonzero(limit > 0)
    if not len(large):
        return at, n
    ends, parts, done = np.append(segment[1:], len(at)), [], 0
    for g in large:
        s, e = int(segment[g]), int(ends[g])
        node, count = compress(at[s:e] & _NODE, n[s:e], int(limit[g]))
        parts += [(at[done:s], n[done:s]), (node + (at[s] & ~_NODE), count)]
        done = e
    parts.append((at[done:], n[done:]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _packed(keys: pa.Table, at: np.ndarray, n: np.ndarray) -> pa.Table:
    """``keys`` (a row per group) with the nodes of each group as ``state``."""
    pairs = np.column_stack([at & _CODE, n]).astype("<i8")
    ends = np.searchsorted(at >> _CODE_BITS, np.arange(keys.num_rows), "right") * 16
    offsets = np.append(0, ends).astype(np.int32)
    state = pa.Array.from_buffers(pa.binary(), keys.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(pairs))])
    return keys.append_column("state", state)


def _unpacked(state: pa.ChunkedArray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and counts of the rows of ``state``, each row belonging to a group."""
    column = state.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    pairs = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<i8").reshape(-1, 2)
    return pairs[:, 0] | (np.repeat(group, np.diff(offsets) // 16) << _CODE_BITS), pairs[:, 1]


def _coded(t: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """A number per row that equal keys share, in order of their first rows, and those rows. Null is a key."""
    code = np.zeros(t.num_rows, np.int64)
    for i in range(keys):
        d = t.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
        first, code = np.unique(code, return_index=True, return_inverse=True)[1:]
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[code], first[order]


def _packer(keys: int, share: int):
    """Rows (keys, values) to one packed row for each key in every ROWS rows; those are added up while they are few."""

    def pack(t: pa.Table) -> pa.Table:
        code, first = _coded(t, keys)
        parts = []
        for m, c in enumerate(t.columns[keys:]):
            c = c.combine_chunks()
            ok = c.is_valid().to_numpy(zero_copy_only=False)
            v = c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[ok]
            parts.append((code[ok] << _CODE_BITS) | (m << _NODE_BITS) | leaf(v))
        return _packed(t.select(range(keys)).take(pa.array(first)), *_added(np.concatenate(parts), None, share))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, packed = [], 0, []
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= ROWS:
                packed, held, rows = [*packed, pack(pa.Table.from_batches(held))], [], 0
                if sum(p.nbytes for p in packed) > 16 * NODES:
                    one = _combined(pa.concat_tables(packed), keys, share)
                    packed = [] if one.nbytes > 8 * NODES else [one]
                    yield from one.to_batches() if not packed else ()
        if rows:
            packed.append(pack(pa.Table.from_batches(held)))
        if packed:
            yield from (_combined(pa.concat_tables(packed), keys, share) if len(packed) > 1 else packed[0]).to_batches()

    return over


def _combined(t: pa.Table, keys: int, share: int) -> pa.Table:
    """A packed row for each key, in order of their first rows."""
    code, first = _coded(t, keys)
    return _packed(t.select(range(keys)).take(pa.array(first)), *_added(*_unpacked(t.column(keys), code), share))


def _gatherer(keys: int, share: int):
    """Packed rows in any order to fewer ones: all that come together within NODES nodes."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size > 32 * NODES:
                one = _combined(pa.Table.from_batches(held), keys, share)
                held, size = [], 0
                if one.nbytes > 16 * NODES:
                    yield from one.to_batches()
                else:
                    held, size = one.to_batches(), one.nbytes
        if held:
            yield from _combined(pa.Table.from_batches(held), keys, share).to_batches()

    return over


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: int, share: int) -> Iterator[pa.Table]:
    """One packed row for each key of sorted packed rows; never more than about NODES nodes are held."""
    held: list[pa.Table] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.Table.from_batches([b]))
        size += b.nbytes
        if size > 16 * NODES:
            t = _combined(pa.concat_tables(held), keys, share)
            yield t.slice(0, t.num_rows - 1)
            held = [t.slice(t.num_rows - 1)]
            size = held[0].nbytes
    if held:
        yield _combined(pa.concat_tables(held), keys, share)


def _read(at: np.ndarray, n: np.ndarray, percents: Sequence[int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Group and metric of each digest as one number, its number of values, and its percentiles."""
    segment = at >> _NODE_BITS
    starts = _runs(segment)
    total = np.add.reduceat(n, starts)
    which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
    low, high = node_range(at & _NODE)
    if (low != high).any():
        # by greatest value, smaller ranges first: what lies before a node is certainly not above it
        order = np.lexsort((-low, high, which))
        high, n = high[order], n[order]
    run = np.cumsum(n)
    run -= (np.cumsum(total) - total)[which]
    out = []
    for p in percents:
        # runs grow within a digest, so the first that is large enough follows all that are not
        small = np.add.reduceat((run * 100 < p * total[which]).astype(np.int64), starts)
        out.append(high[starts + small])
    return segment[starts], total, out


def _finisher(keys: int, whole: object, percents: Sequence[int], share: int, types: list[pa.DataType]):
    """Percentiles of every key (first keys, period), and of the first keys over all periods, named ``whole``.

    Rows are sorted by all keys. Each period's digest goes out and is added to that of all periods, so that the digest of one
    period and that of all are held, however many periods a key has.
    """

    def rows(names: pa.Table, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        group, total, p = _read(at, n, percents)
        metric = (group & ((1 << _METRIC_BITS) - 1)).astype(np.int8)
        columns = [names.column(i).combine_chunks().take(pa.array(group >> _METRIC_BITS)) for i in range(keys)]
        columns = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        names_out = [*(names.schema.names[:keys]), "metric", "n", *(f"p{x}" for x in percents)]
        return pa.record_batch([*columns, pa.array(metric), *map(pa.array, (total, *p))], names=names_out)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: pa.Table | None = None
        for t in _sorted_groups(batches, keys, share):
            if not t.num_rows:
                continue
            at, n = _unpacked(t.column(keys), np.arange(t.num_rows))
            yield rows(t, at, n)
            every = t.set_column(keys - 1, t.schema.field(keys - 1), pa.array([whole] * t.num_rows, types[keys - 1]))
            every = every if open_key is None else pa.concat_tables([open_key, every])
            one = _combined(every, keys, share)
            open_key, closed = one.slice(one.num_rows - 1), one.slice(0, one.num_rows - 1)
            if closed.num_rows:
                yield rows(closed, *_unpacked(closed.column(keys), np.arange(closed.num_rows)))
        if open_key is not None:
            yield rows(open_key, *_unpacked(open_key.column(keys), np.zeros(1, np.int64)))

    return over


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def pack(rows: DataFrame, keys: Sequence[str], values: Sequence[str], share: int = SHARE) -> DataFrame:
    """``keys, state``: packed digests of the whole-number ``values`` (at most 16) of each key in each input partition.

    Null values count nowhere; null keys are keys; empty input gives no rows; columns that are not named do not matter. Values
    outside the universe (none that 32-bit numbers or the sum of four of them can have) become its ends, so that a percentile equal to an
    end means at least or at most that.
    """
    if not 0 < len(values) <= 1 << _METRIC_BITS:
        raise ValueError("between 1 and 16 values")
    some = rows.select(*keys, *values)
    return some.mapInArrow(_packer(len(keys), share), f"{_ddl(rows, keys)}, state binary")


def gather(states: DataFrame, keys: Sequence[str], share: int = SHARE) -> DataFrame:
    """Packed rows of equal keys added up within each partition, without a shuffle."""
    return states.select(*keys, "state").mapInArrow(_gatherer(len(keys), share), f"{_ddl(states, keys)}, state binary")


def gather_tree(states: DataFrame, keys: Sequence[str], partitions: int, fan_in: int = FAN_IN, share: int = SHARE) -> DataFrame:
    """Packed rows merged in rounds, until at most ``fan_in`` rows of a key and partition are left of ``partitions``."""
    for left in range(rounds_for(partitions, fan_in) - 1, 0, -1):
        node = "__node" if "__node" in states.columns else None
        states = states.withColumn("__node", F.expr(f"`__node` div {fan_in}") if node else F.expr(f"spark_partition_id() div {fan_in}"))
        at = [*keys, "__node"]
        states = gather(states.repartition(*at), at, share)
    return states.select(*keys, "state")


def percentiles(states: DataFrame, keys: Sequence[str], whole: object, percents: Sequence[int], share: int = SHARE) -> DataFrame:
    """``keys, metric, n, p<percent>...``: the least value that at least that share of the values does not exceed, up to the error.

    The last key is the period. A row for each key, and one for the keys before it with ``whole`` as period, merged from the periods'
    digests. ``states`` must hold all rows of equal keys but the period in one partition, as after ``repartition``.
    """
    types = [f.type for f in pa.schema([(k, _arrow(t)) for k, t in states.select(*keys).dtypes])]
    ddl = ", ".join(f"{c} long" for c in ["n", *(f"p{p}" for p in percents)])
    placed = states.select(*keys, "state").sortWithinPartitions(*keys)
    return placed.mapInArrow(_finisher(len(keys), whole, tuple(percents), share, types), f"{_ddl(states, keys)}, metric byte, {ddl}")


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "date": pa.date32()}[kind]
