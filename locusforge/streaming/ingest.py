"""Pileup text to profiles, as a batch or a stream of files, and idempotent completion of comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from locusforge.conventions import BASES
from locusforge.functions.pileup import base_counts, clean_bases
from locusforge.operators import allpairs
from locusforge.operators.intervals import NO_NAME, annotate_genes
from locusforge.operators.registry import remaining_pairs
from locusforge.schemas import PROFILE
from locusforge.sources import io


def pileup_counts(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``chrom, pos, A, C, G, T`` and the columns to keep of lines ``chrom pos ref depth bases [...]`` in ``value``; lines with fewer
    fields are left out."""
    f = F.split("value", "\t")
    rows = lines.where(F.size(f) >= 5).select(*keep, f[0].alias("chrom"), F.trim(f[1]).try_cast("int").alias("pos"), clean_bases(f[4]).alias("__bases"))
    return rows.where("chrom <> '' and pos is not null").select(*keep, "chrom", "pos", *(c.cast("int").alias(b) for c, b in zip(base_counts(F.col("__bases")), BASES)))


def pileup_profile(lines: DataFrame, ranges: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Profile of pileup lines, annotated with genes if ranges are given. Stateless without ranges, so also for streams."""
    counts = pileup_counts(lines, keep)
    counts = counts.withColumn("gene", F.lit(NO_NAME)) if ranges is None else annotate_genes(counts, ranges)
    return counts.select(*keep, *PROFILE.names)


def stream_pileups(spark: SparkSession, source: str, target: str, checkpoint: str, ranges: DataFrame | None = None) -> StreamingQuery:
    """Take all new text files of a folder into a Parquet folder, each file once; the query ends by itself.

    With ranges each micro-batch is annotated as a batch; a repeated batch overwrites its own folder, so that a restart
    leaves neither gaps nor doubles.
    """
    lines = spark.readStream.text(source)
    if ranges is None:
        q = pileup_profile(lines).writeStream.format("parquet").option("path", target).outputMode("append")
    else:
        def write(batch: DataFrame, number: int) -> None:
            io.write_parquet(pileup_profile(batch, ranges), f"{target}/batch={number}", mode="overwrite")

        q = lines.writeStream.foreachBatch(write)
    return q.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete(names: DataFrame, done_path: str, compare: Callable[[DataFrame | allpairs.Wanted], DataFrame], as_set: bool = False) -> bool:
    """Compare the pairs that ``done_path`` lacks and append the result; False if nothing was left to do.

    compare: takes ``sample_1, sample_2``, or the pairs as a set of bits, and gives rows of the comparison table. Running it again adds
    nothing.
    """
    spark = names.sparkSession
    done = io.read_parquet(spark, done_path)
    left = allpairs.missing(names, done)
    if not left.count():
        return False
    pairs = left if as_set else remaining_pairs(names, done).select(F.col("profile_1").alias("sample_1"), F.col("profile_2").alias("sample_2"))
    io.write_parquet(compare(pairs).select(*done.columns), done_path, mode="append")
    return True
