"""Per-key aggregation that a few very large keys do not hold up.

A tree over the input partitions. Spark cuts its input into splits of fixed size (``spark.sql.files.maxPartitionBytes``);
those are the leaves: the rows of a key inside one partition are combined where they are read, into one state. Rounds of
bounded fan-in then merge the states of neighbouring partitions. However many rows a key has, and however few different
values, nobody ever receives more than ``fan_in`` states of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min, "or": F.bit_or}
FAN_IN = 32


def rounds_for(partitions: int, fan_in: int = FAN_IN) -> int:
    """Rounds of the tree over so many leaves; at least one, as keys must come together."""
    rounds, reach = 1, fan_in
    while reach < partitions:
        rounds, reach = rounds + 1, reach * fan_in
    return rounds


def tree_aggregate(df: DataFrame, keys: Sequence[str], partial: dict[str, tuple[Column, str]], fan_in: int = FAN_IN, partitions: int | None = None) -> DataFrame:
    """Aggregate ``df`` by ``keys`` through a tree over its partitions.

    partial: output name -> (aggregate over rows, how two states merge: sum, max, min, or). partitions: the number of partitions
    of ``df``, or more; it sets the number of rounds and is read from the plan if not given, which for a scan costs
    nothing, but runs the exchanges of any other input.

    The first grouping is by key and number of the partition div ``fan_in``: its partial step makes one state for each key of a
    partition, its final step merges up to ``fan_in`` of them; each further round divides that number again until none is left.
    Null keys form a group of their own, an empty ``df`` gives an empty result, repeated rows all count, and columns of
    ``df`` that are not named do not matter.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    if clash := set(partial) & set(keys):
        raise ValueError(f"names used twice: {sorted(clash)}")
    rounds = rounds_for(df.rdd.getNumPartitions() if partitions is None else partitions, fan_in)
    state = df.drop("__node").withColumn("__node", F.spark_partition_id())
    step = [e.alias(n) for n, (e, _) in partial.items()]
    for left in range(rounds - 1, -1, -1):
        state = state.withColumn("__node", F.expr(f"`__node` div {fan_in}")) if left else state
        state = state.groupBy(*keys, *(["__node"] if left else [])).agg(*step)
        step = [_MERGE[how](n).alias(n) for n, (_, how) in partial.items()]
    return state


def count_by_key(df: DataFrame, key: Column, fan_in: int = FAN_IN) -> DataFrame:
    """``key, n_rows, is_key`` for every key; null comes with is_key false."""
    return tree_aggregate(df.select(key.alias("key")), ["key"], {"n_rows": (F.count(F.lit(1)), "sum"), "is_key": (F.max(F.col("key").isNotNull()), "max")}, fan_in)


def heavy_keys(counts: DataFrame, percent: int = 3) -> DataFrame:
    """The keys of ``count_by_key`` that hold at least ``percent`` % of all rows; null is no key but counts as rows.

    Filter and total both use the aggregated ``is_key``: a filter on ``key`` would be pushed below the exchange, and a
    total without the column would be pruned differently, so that the total could not reuse the exchange.
    """
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("is_key").isNotNull(), F.col("n_rows"))), F.lit(0)).alias("t")).scalar()
    return counts.where(F.col("is_key") & (F.col("n_rows") * 100 >= F.lit(percent) * total)).select("key", "n_rows")


#: Words of 64 positions in the set of a range of positions.
WORDS = 4
_SETS = [f"w{i}" for i in range(WORDS)]


def position_states(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``scaffold, range, n_rows, n_complete, coverage_sum, w0..``: one state for each range of ``64 * WORDS`` positions.

    The set of covered positions is a set of bits, so that states merge by OR and never hold more than the range, however often a
    position comes. A row without position has a null range and covers nothing.
    """
    word, bit = F.expr(f"pmod(pos, {64 * WORDS}) div 64"), F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))")
    some = rows.where(F.col("scaffold").isNotNull()).select("scaffold", F.col("pos").cast("long").alias("pos"), F.col("cov").cast("long").alias("cov"))
    some = some.withColumn("range", F.expr(f"cast(floor(pos / {64 * WORDS}) as bigint)"))
    partial = {"n_rows": (F.count(F.lit(1)), "sum"), "n_complete": (F.count("cov"), "sum"), "coverage_sum": (F.coalesce(F.sum("cov"), F.lit(0).cast("long")), "sum")}
    sets = {w: (F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))), "or") for i, w in enumerate(_SETS)}
    return tree_aggregate(some, ["scaffold", "range"], partial | sets, fan_in, rows.rdd.getNumPartitions())


def position_summary(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``scaffold, n_rows, covered_positions, n_complete, coverage_sum`` of each scaffold.

    rows: ``scaffold, pos, cov`` (cov null where a count is null), read from files. Rows without a scaffold are left out, rows
    without a position count as rows but cover nothing. One tree over the input partitions gives a state for each range
    of positions, a second one over the partitions of those states adds up the ranges of a scaffold.
    """
    states = position_states(rows, fan_in)
    covered = sum((F.bit_count(w).cast("long") for w in _SETS[1:]), F.bit_count(_SETS[0]).cast("long"))
    partial = {c: (F.sum(c), "sum") for c in ("n_rows", "n_complete", "coverage_sum")} | {"covered_positions": (F.sum(covered), "sum")}
    out = tree_aggregate(states, ["scaffold"], partial, fan_in, _shuffled(rows))
    return out.select("scaffold", "n_rows", "covered_positions", "n_complete", "coverage_sum")


def _shuffled(df: DataFrame) -> int:
    """Partitions that an exchange leaves at most."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def genome_summary(scaffolds: DataFrame, stb: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``genome, n_scaffolds, n_rows, covered_positions, n_complete, coverage_sum`` by adding scaffold summaries.

    stb: distinct ``scaffold, genome``. A scaffold of two genomes counts for both; one without a genome is left out. A tree over the
    partitions of the scaffolds, so that a genome of very many scaffolds is no burden either.
    """
    partial = {"n_scaffolds": (F.count(F.lit(1)), "sum")} | {c: (F.sum(c), "sum") for c in ("n_rows", "covered_positions", "n_complete", "coverage_sum")}
    return tree_aggregate(scaffolds.join(stb.where(F.col("genome").isNotNull()), "scaffold"), ["genome"], partial, fan_in, _shuffled(scaffolds))
