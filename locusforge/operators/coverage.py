"""Summaries of profiles per genome: breadth of coverage, strain heterogeneity, lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from locusforge.conventions import BASES
from locusforge.operators.blocks import combined
from locusforge.operators.compare import with_coverage


def strain_heterogeneity(profile: DataFrame, stb: DataFrame, min_cov: int = 5, freq_threshold: float = 0.8) -> DataFrame:
    """Sites per sample and genome covered at least ``min_cov`` times, and those whose commonest base is rarer than the threshold.

    Scaffolds without a genome form a group with a null genome.
    """
    sites = with_coverage(profile).where(F.col("cov") >= F.greatest(F.lit(min_cov), F.lit(1)))
    mixed = F.greatest(*BASES) / F.col("cov") < freq_threshold
    per_scaffold = sites.groupBy("sample", F.col("chrom").alias("scaffold")).agg(F.count(F.lit(1)).alias("n"), F.count_if(mixed).alias("h"))
    total = f"total_sites_at_{min_cov}_coverage"
    sums = per_scaffold.join(stb.select("scaffold", "genome"), "scaffold", "left").groupBy("sample", "genome").agg(F.sum("n").alias(total), F.sum("h").alias("heterogeneous_sites"))
    return sums.withColumn("strain_heterogeneity", F.col("heterogeneous_sites") / F.col(total))


def genome_lengths(stb: DataFrame, bed: DataFrame) -> DataFrame:
    """``genome, genome_length``: the segments of a scaffold, then the scaffolds of a genome added up."""
    per_scaffold = bed.groupBy("scaffold").agg(F.sum(F.col("end").cast("long") - F.col("start").cast("long")).alias("n"))
    return per_scaffold.join(stb.select("scaffold", "genome"), "scaffold", "left").groupBy("genome").agg(F.sum("n").alias("genome_length"))


def genome_breadth(profile: DataFrame, lengths: DataFrame, stb: DataFrame, min_cov: int = 1) -> DataFrame:
    """``sample, genome, breadth``: share of the genome's length that the sample covers; null where no length is known."""
    per_scaffold = with_coverage(profile).where(F.col("cov") >= min_cov).groupBy("sample", F.col("chrom").alias("scaffold")).agg(F.count(F.lit(1)).alias("n"))
    sums = per_scaffold.join(stb.select("scaffold", "genome"), "scaffold", "left").groupBy("sample", "genome").agg(F.sum("n").alias("n"))
    known = lengths.groupBy("genome").agg(F.max("genome_length").alias("genome_length"))
    return sums.join(known, "genome", "left").select("sample", "genome", (F.col("n") / F.expr("nullif(genome_length, 0)")).alias("breadth"))


def breadth_matrix(breadth: DataFrame, samples: list[str]) -> DataFrame:
    """One row per genome and a column per sample of the list, which fixes the schema."""
    if not samples:
        raise ValueError("no samples named")
    return breadth.groupBy("genome").pivot("sample", samples).agg(F.max("breadth"))


def collect_breadth_tables(tables: list[DataFrame]) -> DataFrame:
    """Full outer join on genome of tables ``genome, <sample>``, as one union and grouping rather than a chain of joins."""
    if not tables:
        raise ValueError("no breadth tables provided")
    names = [c for t in tables for c in t.columns if c != "genome"]
    return reduce(DataFrame.unionByName, (unpivot_breadth(t, fill=None) for t in tables)).groupBy("genome").pivot("sample", names).agg(F.max("breadth"))


def unpivot_breadth(matrix: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """``genome, sample, breadth`` of a matrix; nulls become ``fill``."""
    long = matrix.unpivot("genome", [c for c in matrix.columns if c != "genome"], "sample", "breadth")
    return long if fill is None else long.fillna(fill, ["breadth"])


def long_breadth(breadth: DataFrame, samples: DataFrame) -> DataFrame:
    """``genome, sample, breadth`` of every genome of the table with every sample of ``samples``; 0 where there is none."""
    known = breadth.groupBy("genome", "sample").agg(F.max("breadth").alias("breadth"))
    every = combined(breadth.select("genome").distinct(), samples.select("sample").distinct())
    return every.join(known, ["genome", "sample"], "left").fillna(0.0, ["breadth"])
