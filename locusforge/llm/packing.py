"""Items of varying length in containers of fixed capacity, by lexical retrieval.

Items lie in order of their leading terms and are cut into shards of equal size: terms with few items share one, a term with many
has several, whatever its share of all. A shard has a BM25 inverted index over its items' terms. The longest unused item
seeds a container; its unused neighbours, best score first and longer before shorter, fill the room that is left, and
items without a common term come last, so that relatedness never costs room. Containers that a shard could not fill are
opened again and their items packed in a further, smaller round, until one shard holds them. As soon as a round brings
little, the next ones deal the items by a hash of the round, so that they meet others, until such a round brings nothing
either. Items longer than the capacity are divided into full containers and one rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from locusforge.session import cut_lineage

#: Items in a shard at most, shards in a task on average; containers filled to this share stay as they are.
SHARD, SHARDS, FULL = 2000, 4, 0.995
#: A round brings little if more than this share of its items lies in containers that are not full.
LITTLE = 0.9
K1, B = 1.2, 0.75
_ROW = pa.schema([("item", pa.string()), ("lead", pa.string()), ("terms", pa.list_(pa.string())), ("piece", pa.int64()), ("piece_start", pa.int64()), ("length", pa.int64()), ("batch_id", pa.string()), ("batch_length", pa.int64())])
_DDL = "item string, lead string, terms array<string>, piece long, piece_start long, length long, batch_id string, batch_length long"


class Bm25:
    """Inverted index over the term lists of a shard."""

    def __init__(self, terms: list[list[str]]):
        postings: dict[str, dict[int, int]] = {}
        for i, ts in enumerate(terms):
            for t in ts:
                at = postings.setdefault(t, {})
                at[i] = at.get(i, 0) + 1
        n = len(terms)
        size = np.array([len(t) for t in terms], float)
        norm = K1 * (1 - B + B * size / max(size.mean() if n else 1.0, 1e-9))
        self.n, self.terms, self.index = n, terms, {}
        for t, at in postings.items():
            who, tf = np.fromiter(at.keys(), np.int64, len(at)), np.fromiter(at.values(), float, len(at))
            idf = math.log(1 + (n - len(at) + 0.5) / (len(at) + 0.5))
            self.index[t] = who, idf * tf * (K1 + 1) / (tf + norm[who])

    def scores(self, i: int) -> np.ndarray:
        out = np.zeros(self.n)
        for t in set(self.terms[i]):
            who, weight = self.index[t]
            out[who] += weight
        return out


def fill(lengths: np.ndarray, terms: list[list[str]], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every length must be in 1..capacity."""
    index = Bm25(terms)
    order = np.argsort(-lengths, kind="stable")
    used = np.zeros(len(lengths), bool)
    out = []
    for seed in order:
        if used[seed]:
            continue
        used[seed] = True
        held, room = [int(seed)], int(capacity - lengths[seed])
        fits = order[~used[order] & (lengths[order] <= room)] if room else order[:0]
        if len(fits):
            fits = fits[np.argsort(-index.scores(seed)[fits], kind="stable")]  # ties stay longest first
            while len(fits):
                # all leading neighbours that fit together, then those that still fit
                n = int(np.searchsorted(np.cumsum(lengths[fits]), room, "right"))
                take = fits[: max(n, 1)]
                held += take.tolist()
                used[take] = True
                room -= int(lengths[take].sum())
                rest = fits[len(take) :]
                fits = rest[lengths[rest] <= room]
        out.append(held)
    return out


def _packer(capacity: int, round_no: int):
    """Rows in order to rows with their containers; every SHARD rows are packed together."""

    def pack(table: pa.Table, name: str) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("item", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy()
        ids, totals = np.empty(len(lengths), object), np.zeros(len(lengths), np.int64)
        for k, held in enumerate(fill(lengths, table["terms"].to_pylist(), capacity)):
            ids[held] = f"{name}-{k}"
            totals[held] = lengths[held].sum()
        return pa.table([*(table[c] for c in ("item", "lead", "terms", "piece", "piece_start", "length")), pa.array(ids, pa.string()), pa.array(totals)], schema=_ROW)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= SHARD:
                yield from pack(held.slice(0, SHARD), f"{round_no}-{task}-{shard}").to_batches()
                held, shard = held.slice(SHARD), shard + 1
        if held is not None and held.num_rows:
            yield from pack(held, f"{round_no}-{task}-{shard}").to_batches()

    return over


def _packed(pieces: DataFrame, total: int, capacity: int, round_no: int, mixed: bool) -> DataFrame:
    """``pieces`` with their containers. The tasks are ranges of (leading term, hash), of which a sample of the rows gives the borders,
    so that a hot term is cut like any other; ``mixed`` deals by a hash of the round instead, whatever the terms."""
    tasks = max(1, -(-total // (SHARD * SHARDS)))
    salt = F.xxhash64("item", "piece", F.lit(round_no if mixed else 0))
    keyed = pieces.withColumns({"__term": F.lit("") if mixed else F.col("lead"), "__salt": salt})
    placed = keyed.repartition(1) if tasks == 1 else keyed.repartitionByRange(tasks, "__term", "__salt")
    rows = placed.sortWithinPartitions("__term", "__salt").select("item", "lead", "terms", "piece", "piece_start", "length")
    return cut_lineage(rows.mapInArrow(_packer(capacity, round_no), _DDL))


def _places(packed: DataFrame) -> DataFrame:
    return packed.select("item", "piece", "piece_start", F.col("length").alias("piece_length"), "batch_id", "batch_length")


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``item, piece, piece_start, piece_length, batch_id, batch_length``: where every item lies.

    items: ``item, length, lead, terms`` with one row per item. Items with a null name or a null, zero or negative
    length are left out; a null lead or term list counts as empty. Items of equal length and terms are placed in order of their
    names. An empty input gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = items.where("item is not null and length > 0").select("item", F.col("length").cast("long").alias("total"), F.coalesce("lead", F.lit("")).alias("lead"), F.coalesce(F.array_compact("terms"), F.array().cast("array<string>")).alias("terms"))
    whole = rows.withColumn("full", F.expr(f"total div {capacity}"))
    full = whole.where("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    done = full.select("item", "piece", (F.col("piece") * capacity).alias("piece_start"), F.lit(capacity).cast("long").alias("piece_length"), F.concat_ws("#", "item", F.col("piece").cast("string")).alias("batch_id"), F.lit(capacity).cast("long").alias("batch_length"))
    loose = whole.where(f"total % {capacity} > 0").select("item", "lead", "terms", F.col("full").alias("piece"), (F.col("full") * capacity).alias("piece_start"), F.expr(f"total % {capacity}").alias("length"))
    loose = cut_lineage(loose)
    left, round_no, mixed = loose.count(), 0, False
    best, fewest = None, math.inf  # the containers that hold the loose items so far, and their number
    while left:
        packed = _packed(loose, left, capacity, round_no, mixed)
        is_open = F.col("batch_length") < int(FULL * capacity)
        each = packed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.first("batch_length").alias("batch_length"))
        again, n, n_open = each.agg(F.coalesce(F.sum(F.when(is_open, F.col("n"))), F.lit(0)), F.count(F.lit(1)), F.count_if(is_open)).first()
        little = again > LITTLE * left
        if left <= SHARD or (little and n >= fewest and mixed):  # one shard, or nothing gained by mixing
            done = done.unionByName(_places(best if fewest <= n else packed))
            break
        if not little or n < fewest:
            done = done.unionByName(_places(packed.where(~is_open)))
            best, fewest, left = packed.where(is_open), n_open, again
            loose = best.select("item", "lead", "terms", "piece", "piece_start", "length")
        mixed, round_no = mixed or little, round_no + 1
    return done


def name_terms(c: Column) -> Column:
    """Parts of a name, and the first digits of its numbers, as terms."""
    parts = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.concat(parts, F.transform(parts, lambda x: F.concat(F.lit("~"), F.substring(x, 1, 6))), F.transform(parts, lambda x: F.concat(F.lit("~"), F.substring(x, 1, 9))))
