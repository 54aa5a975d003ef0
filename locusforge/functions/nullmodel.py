"""Counts that sequencing errors alone explain, per coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from locusforge.schemas import NULL_MODEL


def poisson_limits(error_rate: float = 0.001, max_total_reads: int = 10_000, p_threshold: float = 0.05) -> list[tuple[int, int]]:
    """(coverage, greatest k with P(X >= k) > p_threshold) for X Poisson with mean coverage * error_rate / 3."""
    out = []
    for n in range(1, max_total_reads + 1):
        mean = n * error_rate / 3
        k = max(0, int(mean - 20 * math.sqrt(mean)))  # less has no weight; exp(-mean) would be 0 at great means
        term = below = math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if k else math.exp(-mean)  # P(X < k + 1)
        while 1 - below > p_threshold:
            k += 1
            term *= mean / k
            below += term
        out.append((n, k))
    return out


def null_model(spark: SparkSession, error_rate: float = 0.001, max_total_reads: int = 10_000, p_threshold: float = 0.05) -> DataFrame:
    return spark.createDataFrame(poisson_limits(error_rate, max_total_reads, p_threshold), NULL_MODEL)
