"""Runs of equal or nearly equal consecutive events, by adjacent agglomeration.

Every event starts as a run of its own. A doubly linked list holds the runs of a sequence in order, a
priority queue the neighbouring pairs that meet the limits; the most similar pair (then the closest, then the
earliest) is merged, its neighbours are scored again, until no pair meets them. How similar two runs are is a setting:
``adjoining`` compares the two events that meet, so that a long drift stays one run as long as each step is small, and the
order of merges does not change the result; ``mean`` compares the means of the runs, which move with every merge, so that the
order decides and a drift is cut where it has gone too far.

Long sequences are cut into chunks of their order value. Within a chunk only the first and the last run can
still grow, so only those go to a second pass over the whole sequence. Both passes stream over sorted
partitions: no sequence is ever held in one piece, however long it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


LINKAGES = ("adjoining", "mean")


def agglomerate(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, fresh: np.ndarray, max_gap: int | None, max_step: int, linkage: str = "adjoining", sums: np.ndarray | None = None, n_rows: np.ndarray | None = None) -> np.ndarray:
    """For runs in order, the index of the run that each is merged into (its own if it heads a run).

    start, end: order values of the first and last event; first, last: their values, one column per field; sums, n_rows: sums of the
    values and number of events, for ``mean`` only; fresh: whether a run begins another sequence than the one before.
    """
    n = len(start)
    head = np.arange(n)
    if n < 2:
        return head
    mean = linkage == "mean"
    gap = start[1:] - end[:-1]
    center = sums / n_rows[:, None] if mean else None
    step = np.abs(center[1:] - center[:-1]).max(axis=1) if mean else np.abs(first[1:] - last[:-1]).max(axis=1)
    near = ~fresh[1:] if max_gap is None else ~fresh[1:] & (gap <= max_gap)
    meets = near & (step <= max_step)
    if not meets.any():
        return head
    if mean:  # a merge may bring a further neighbour near: whole stretches take part in which any pair meets the limits
        stretch = np.cumsum(np.append(True, ~near))
        takes = np.isin(stretch, stretch[1:][meets])
    else:
        near = meets
        takes = np.append(meets, False) | np.append(False, meets)
    part = np.flatnonzero(takes)
    linked = near[part[:-1]] & (np.diff(part) == 1)
    after = np.where(np.append(linked, False), np.arange(1, len(part) + 1), -1).tolist()
    before = np.where(np.append(False, linked), np.arange(-1, len(part) - 1), -1).tolist()
    newest, into = [0] * len(part), list(range(len(part)))
    gaps = np.append(gap, 0)[part].tolist()  # to the run after; a merged run takes over the gap of its right part
    total, count = (sums[part].astype(float), n_rows[part].astype(float)) if mean else (None, None)
    slot = {p: i for i, p in enumerate(part.tolist())}
    at = np.flatnonzero(meets)
    queue = [(s, g, slot[p], 0) for s, g, p in zip(step[at].tolist(), gap[at].tolist(), at.tolist())]
    heapq.heapify(queue)
    steps = np.append(step, 0)[part].tolist()

    def score(left: int) -> None:
        """Put the pair of a run and the one after it into the queue, in place of what it has there."""
        newest[left] += 1
        if left >= 0 and after[left] >= 0:
            if mean:
                right = after[left]
                steps[left] = float(np.abs(total[left] / count[left] - total[right] / count[right]).max())
            if steps[left] <= max_step:
                heapq.heappush(queue, (steps[left], gaps[left], left, newest[left]))

    while queue:
        _, _, left, stamp = heapq.heappop(queue)
        if stamp != newest[left]:
            continue
        right = after[left]
        into[right], newest[right] = left, -1  # what the queue holds of the right run is void
        gaps[left], steps[left], after[left] = gaps[right], steps[right], after[right]
        if after[left] >= 0:
            before[after[left]] = left
        if mean:
            total[left] += total[right]
            count[left] += count[right]
            if before[left] >= 0:
                score(before[left])
        score(left)
    for i, p in enumerate(part.tolist()):
        if into[i] != i:
            into[i] = into[into[i]]  # runs before this one have found their heads
        head[p] = part[into[i]]
    return head


_FIXED = [("seq", pa.string()), ("chunk", pa.int64()), ("run_start", pa.int64()), ("run_end", pa.int64()), ("n_rows", pa.int64())]


def _schema(fields: int) -> pa.Schema:
    return pa.schema([*_FIXED, *((f"{w}{i}", pa.int64()) for w in "fls" for i in range(fields)), ("edge", pa.bool_())])


def _ddl(fields: int) -> str:
    return "seq string, chunk long, run_start long, run_end long, n_rows long, " + ", ".join(f"{w}{i} long" for w in "fls" for i in range(fields)) + ", edge boolean"


def _pass(fields: int, max_gap: int | None, max_step: int, min_rows: int, second: bool, linkage: str = "adjoining"):
    """A function over Arrow batches in order.

    First pass: events (seq, chunk, at, v0..) sorted by seq, chunk and at, of which only the first of equal order
    values counts. Out come the runs of at least min_rows and, marked as edges whatever their size, the first and
    last run of each chunk. Second pass: those runs sorted by seq, edge and run_start; only edges of different
    chunks may join, as nothing lies between them.
    """
    names = [f"{w}{i}" for w in "fls" for i in range(fields)]
    schema = _schema(fields)

    def as_runs(t: pa.Table) -> pa.Table:
        at, values = t["at"], [t[f"v{i}"] for i in range(fields)]
        return pa.table([t["seq"], t["chunk"], at, at, pa.array(np.ones(len(at), np.int64)), *values, *values, *values, pa.array(np.zeros(len(at), bool))], schema=schema)

    def fresh_of(t: pa.Table) -> np.ndarray:
        seq, chunk = t["seq"].combine_chunks(), t["chunk"].to_numpy()
        new = np.ones(len(seq), bool)
        if len(seq) > 1:
            new[1:] = pc.not_equal(seq[1:], seq[:-1]).to_numpy(zero_copy_only=False)
            if second:
                edge = t["edge"].to_numpy()
                new[1:] |= (chunk[1:] == chunk[:-1]) | ~edge[1:] | ~edge[:-1]
            else:
                new[1:] |= chunk[1:] != chunk[:-1]
        return new

    def single(t: pa.Table) -> pa.Table:
        """Of events with the same order value only the first."""
        start, end, fresh = t["run_start"].to_numpy(), t["run_end"].to_numpy(), fresh_of(t)
        fresh[1:] |= start[1:] != end[:-1]
        return t if fresh.all() else t.filter(pa.array(fresh))

    def merge(t: pa.Table, opened: bool, closing: bool) -> tuple[pa.Table, pa.Table, bool]:
        """Finished runs, the run still open at the end, and whether that one heads its chunk."""
        t = t if second else single(t)
        start, end, fresh = t["run_start"].to_numpy(), t["run_end"].to_numpy(), fresh_of(t)
        values, n_rows = np.column_stack([t[c].to_numpy() for c in names]), t["n_rows"].to_numpy()
        first, last, sums = values[:, :fields], values[:, fields : 2 * fields], values[:, 2 * fields :]
        head = agglomerate(start, end, first, last, fresh, max_gap, max_step, linkage, sums, n_rows)
        heads = np.flatnonzero(head == np.arange(len(head)))
        tails = np.append(heads[1:], len(head)) - 1
        total = np.add.reduceat(n_rows, heads)
        h, l = pa.array(heads), pa.array(tails)
        heads_chunk = fresh[heads]
        heads_chunk[0] = opened
        if second:
            edge, keep = t["edge"].to_numpy()[heads], total >= min_rows
        else:
            edge = heads_chunk | np.append(heads_chunk[1:], closing)
            keep = edge | (total >= min_rows)
        cols = [t["seq"].take(h), t["chunk"].take(l), t["run_start"].take(h), t["run_end"].take(l), pa.array(total)]
        added = map(pa.array, np.add.reduceat(sums, heads, axis=0).T)
        out = pa.table([*cols, *(t[c].take(h) for c in names[:fields]), *(t[c].take(l) for c in names[fields : 2 * fields]), *added, pa.array(edge)], schema=schema)
        n = len(heads) - (not closing)
        return out.slice(0, n).filter(pa.array(keep[:n])), out.slice(n), bool(heads_chunk[-1])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads_chunk = schema.empty_table(), True
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t.cast(schema) if second else as_runs(t)
            if held.num_rows:
                t = pa.concat_tables([held, t])
            if linkage == "adjoining":  # what lies behind the last run never changes it
                out, held, heads_chunk = merge(t, heads_chunk if held.num_rows else True, False)
            else:  # means depend on all events of a stretch
                t = t if second else single(t)
                cut = int(np.flatnonzero(fresh_of(t))[-1])
                out, held = merge(t.slice(0, cut), True, True)[0] if cut else schema.empty_table(), t.slice(cut)
            yield from out.to_batches()
        if held.num_rows:
            yield from merge(held, heads_chunk, True)[0].to_batches()

    return over


def repeated_runs(events: DataFrame, seq: Column, at: Column, values: list[Column], *, max_gap: int | None, max_step: int, min_rows: int, chunk: int, prefer: list[Column] | None = None, linkage: str = "adjoining") -> DataFrame:
    """``seq, run_start, run_end, n_rows``: one row per maximal run of at least ``min_rows`` events.

    seq: string key of the sequence; at: order value as a long; values: whole-number fields, of which each may
    differ by at most ``max_step`` between neighbouring runs, whose order values lie at most ``max_gap`` apart
    (None: any distance). linkage: ``adjoining`` or ``mean``, what of the runs is compared. Means are merged within chunks first, then
    the runs at the ends of chunks. Of events with the same order value the first by ``prefer`` counts (greatest first), ties
    broken by the values themselves, greatest first. ``chunk`` is the stretch of order values handled in one piece.

    Events with a null key, order value or field are left out; an empty input gives an empty result; columns
    that are not named do not matter.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    n, prefer = len(values), prefer or []
    rows = events.select(seq.alias("seq"), at.cast("long").alias("at"), *(v.cast("long").alias(f"v{i}") for i, v in enumerate(values)), *(p.alias(f"p{i}") for i, p in enumerate(prefer)))
    rows = rows.dropna(subset=["seq", "at", *(f"v{i}" for i in range(n))]).withColumn("chunk", F.expr(f"cast(floor(at / {chunk}) as bigint)"))
    order = [F.desc(f"p{i}") for i in range(len(prefer))] + [F.desc(f"v{i}") for i in range(n)]
    rows = rows.repartition("seq", "chunk").sortWithinPartitions("seq", "chunk", "at", *order)
    pieces = rows.select("seq", "chunk", "at", *(f"v{i}" for i in range(n))).mapInArrow(_pass(n, max_gap, max_step, min_rows, False, linkage), _ddl(n))
    spread = F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("chunk"))  # inner runs of a long sequence stay apart
    pieces = pieces.withColumn("spread", spread).repartition("seq", "spread").drop("spread").sortWithinPartitions("seq", "edge", "run_start")
    return pieces.mapInArrow(_pass(n, max_gap, max_step, min_rows, True, linkage), _ddl(n)).select("seq", "run_start", "run_end", "n_rows")
