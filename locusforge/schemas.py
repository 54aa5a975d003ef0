"""Schemas of the tables, in one place; every read of a text or Parquet source names one of them."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _of(**fields) -> StructType:
    kinds = {"s": StringType(), "i": IntegerType(), "l": LongType(), "d": DoubleType()}
    return StructType([StructField(k, kinds[v]) for k, v in fields.items()])


PROFILE = _of(chrom="s", pos="i", gene="s", A="i", C="i", G="i", T="i")
STB = _of(scaffold="s", genome="s")
BED = _of(scaffold="s", start="l", end="l")
#: One order of columns for producer and consumer of gene ranges.
GENE_RANGE = _of(gene="s", scaffold="s", start="l", end="l")
GENE_LOC = _of(scaffold="s", gene="s", pos="l")
GENOME_LENGTH = _of(genome="s", genome_length="l")
NULL_MODEL = _of(cov="l", max_error_count="l")
COMPARISON = _of(genome="s", total_positions="l", share_allele_pos="l", genome_pop_ani="d", max_consecutive_length="l", shared_genes_count="l", identical_gene_count="l", perc_id_genes="d", sample_1="s", sample_2="s")
REGISTRY = _of(profile_name="s", profile_location="s", scaffold_location="s", reference_db_id="s", gene_db_id="s")
POPULATION = _of(sample="s", population="s")


def require(columns: list[str], wanted: StructType, exact: bool = False) -> None:
    """Raise ValueError if columns are missing, or, if exact, too many."""
    missing, extra = set(wanted.names) - set(columns), set(columns) - set(wanted.names)
    if missing or (exact and extra):
        raise ValueError(f"columns missing: {sorted(missing)}" + (f"; unexpected: {sorted(extra)}" if exact and extra else ""))
