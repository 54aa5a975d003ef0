"""References to records that do not exist at the time of the reference.

Distinct foreign keys, each with the tables it points to, are anti-joined with the validity intervals of the parent keys;
the orphan keys are joined back to the references for counts per table and period. Every referring table is read and
grouped once, whatever the number of its targets: both sides of the join back share that exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusforge.conventions import period


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the intervals [t0, t1) of each key as disjoint intervals; t1 null is open."""
    end = F.struct(F.col("t1").isNull().alias("open"), F.col("t1").alias("at"))
    before = Window.partitionBy(*keys).orderBy("t0").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*keys).orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(end).over(before)
    new = F.when(reach.isNull() | (~reach["open"] & (reach["at"] < F.col("t0"))), 1).otherwise(0)
    return (
        df.withColumn("__new", new)
        .withColumn("__island", F.sum("__new").over(run))
        .groupBy(*keys, "__island")
        .agg(F.min("t0").alias("t0"), F.max(end).alias("__end"))
        .select(*keys, "t0", F.col("__end.at").alias("t1"))
    )


def validity(parents: DataFrame, table: str, key: Column, loaded: str = "loaded_at", removed: str = "removed_at") -> DataFrame:
    """``target_table, key, t0, t1``: when the rows of a parent table hold its keys.

    Rows with a null key or load time, or removed at or before their load time, hold nothing. Repeated rows are dropped here,
    so that a key of very many rows travels once per load time.
    """
    rows = parents.select(F.lit(table).alias("target_table"), key.alias("key"), F.col(loaded).alias("t0"), F.col(removed).alias("t1"))
    rows = rows.where("key is not null and t0 is not null and (t1 is null or t1 > t0)").groupBy("target_table", "key", "t0")
    return rows.agg(F.max(F.struct(F.col("t1").isNull().alias("open"), F.col("t1").alias("at"))).alias("e")).select("target_table", "key", "t0", F.col("e.at").alias("t1"))


def united(valid: DataFrame) -> DataFrame:
    """The intervals of :func:`validity` as disjoint ones: united first within a month of loading and then per key, so that a key
    of very many load times is not sorted in one task row by row."""
    months = _islands(valid.withColumn("month", period("t0")), ["target_table", "key", "month"])
    return _islands(months.drop("month"), ["target_table", "key"])


def reference_rows(df: DataFrame, table: str, key: Column, at: str = "loaded_at", sample: Column | None = None) -> DataFrame:
    """``ref_table, sample, key, at, n_rows`` of the distinct references of a table; counts stay whole. A null key is no reference."""
    # names that no source has: an alias that changes nothing is dropped in one use and kept in the other, and then the plans differ
    rows = df.select((F.lit("") if sample is None else sample).alias("__sample"), key.alias("__key"), F.col(at).alias("__at")).where("__key is not null")
    counted = rows.groupBy("__sample", "__key", "__at").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.lit(table).alias("ref_table"), F.col("__sample").alias("sample"), F.col("__key").alias("key"), F.col("__at").alias("at"), "n_rows")


def orphan_report(refs: list[DataFrame], held: list[DataFrame], targets: dict[str, list[str]]) -> DataFrame:
    """``ref_table, target_table, period, sample, key, n_rows`` of the references without a valid parent at their time.

    refs: :func:`reference_rows` of each referring table; held: :func:`validity` of each parent table; targets: the parent tables
    of each referring table. A null time is an orphan only if the key has no interval at all; an empty parent table makes
    every reference an orphan; empty references give no rows.
    """
    rows, valid = reduce(DataFrame.unionByName, refs), united(reduce(DataFrame.unionByName, held))
    # a condition on n_rows keeps it in both uses, so that the exchange of the grouping is the same plan and made once
    pointed = rows.where("n_rows > 0").withColumn("target_table", F.explode(_targets(targets)))
    keys = pointed.select("target_table", "key", "at").distinct()
    parents = valid.select(F.col("target_table").alias("__t"), F.col("key").alias("__k"), "t0", "t1")
    in_time = F.col("at").isNull() | ((F.col("t0") <= F.col("at")) & (F.col("t1").isNull() | (F.col("t1") > F.col("at"))))
    lost = keys.join(parents, (F.col("target_table") == F.col("__t")) & (F.col("key") == F.col("__k")) & in_time, "left_anti")
    lost = lost.select(F.col("target_table").alias("__t"), F.col("key").alias("__k"), F.col("at").alias("__a"))
    found = pointed.join(lost, (F.col("target_table") == F.col("__t")) & (F.col("key") == F.col("__k")) & F.col("at").eqNullSafe(F.col("__a")), "left_semi")
    return found.groupBy("ref_table", "target_table", period("at").alias("period"), "sample", "key").agg(F.sum("n_rows").alias("n_rows"))


def _targets(targets: dict[str, list[str]]) -> Column:
    out = F.array().cast("array<string>")
    for table, of in targets.items():
        out = F.when(F.col("ref_table") == table, F.array(*map(F.lit, of))).otherwise(out)
    return out
