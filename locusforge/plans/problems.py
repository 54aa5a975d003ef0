"""Queries p3_ and p6_ (skewed keys, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from locusforge.conventions import coverage, scaffold_name
from locusforge.operators import references, skew
from locusforge.session import read_table

HEAVY_PERCENT = 3


def _profile_positions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "profile").select(scaffold_name("chrom").alias("scaffold"), "pos", coverage().alias("cov"))


def _current_stb(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (scaffold, genome) of the rows that are not removed."""
    stb = read_table(spark, d, "stb")
    return stb.where("removed_at is null and genome is not null and scaffold is not null").select(scaffold_name("scaffold").alias("scaffold"), "genome").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    profile = skew.count_by_key(read_table(spark, d, "profile"), scaffold_name("chrom"))
    stb = skew.count_by_key(read_table(spark, d, "stb"), F.col("genome"))
    return (
        skew.heavy_keys(profile, HEAVY_PERCENT).select(F.lit("profile.chrom").alias("key_field"), F.col("key").alias("key_value"))
        .unionByName(skew.heavy_keys(stb, HEAVY_PERCENT).select(F.lit("stb.genome").alias("key_field"), F.col("key").alias("key_value")))
    )


def p3_scaffold_summary(spark: SparkSession, d: str) -> DataFrame:
    s = skew.position_summary(_profile_positions(spark, d))
    return s.select("scaffold", "n_rows", "covered_positions", F.expr("coverage_sum / nullif(n_complete, 0)").alias("mean_coverage"))


def p3_genome_summary(spark: SparkSession, d: str) -> DataFrame:
    g = skew.genome_summary(skew.position_summary(_profile_positions(spark, d)), _current_stb(spark, d))
    return g.select("genome", "n_scaffolds", "n_rows", "covered_positions", F.expr("coverage_sum / nullif(n_complete, 0)").alias("mean_coverage"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    profile, stb, bed = (read_table(spark, d, t) for t in ("profile", "stb", "genomes_bed_file"))
    scaffold = scaffold_name("scaffold")
    refs = [references.reference_rows(profile, "profile", scaffold_name("chrom"), sample=F.col("sample")), references.reference_rows(stb, "stb", scaffold), references.reference_rows(bed, "genomes_bed_file", scaffold)]
    held = [references.validity(stb, "stb", scaffold), references.validity(bed, "genomes_bed_file", scaffold)]
    return references.orphan_report(refs, held, {"profile": ["stb", "genomes_bed_file"], "stb": ["genomes_bed_file"], "genomes_bed_file": ["stb"]})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "target_table", "period", "sample", F.col("key").alias("scaffold"))


def p6_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan rows and distinct orphan scaffolds per referring table, target table and month."""
    per_key = _orphans(spark, d).groupBy("ref_table", "target_table", "period", "key").agg(F.sum("n_rows").alias("n"))
    return per_key.groupBy("ref_table", "target_table", "period").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_scaffolds"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_scaffold_summary, p3_genome_summary, p6_found, p6_orphan_counts)}


_NAME = "lower(trim({}))"
_POSITIONS = f"""SELECT {_NAME.format('chrom')} AS scaffold, count(*) AS n_rows, count(DISTINCT pos) AS covered_positions,
  count(A+C+G+T) AS n_complete, coalesce(sum(CAST(A AS BIGINT)+C+G+T), 0) AS coverage_sum
FROM profile WHERE chrom IS NOT NULL GROUP BY 1"""
_REFS = f"""refs AS (
  SELECT 'profile' AS ref_table, sample, {_NAME.format('chrom')} AS scaffold, loaded_at FROM profile WHERE chrom IS NOT NULL
  UNION ALL SELECT 'stb', '', {_NAME.format('scaffold')}, loaded_at FROM stb WHERE scaffold IS NOT NULL
  UNION ALL SELECT 'genomes_bed_file', '', {_NAME.format('scaffold')}, loaded_at FROM genomes_bed_file WHERE scaffold IS NOT NULL),
held AS (
  SELECT DISTINCT 'stb' AS target_table, {_NAME.format('scaffold')} AS scaffold, loaded_at, removed_at FROM stb
  UNION SELECT DISTINCT 'genomes_bed_file', {_NAME.format('scaffold')}, loaded_at, removed_at FROM genomes_bed_file),
keys AS (
  SELECT DISTINCT ref_table, t.target_table, scaffold, loaded_at
  FROM refs JOIN (VALUES ('stb'), ('genomes_bed_file')) t(target_table) ON t.target_table <> refs.ref_table),
fine AS (
  SELECT DISTINCT k.ref_table, k.target_table, k.scaffold, k.loaded_at
  FROM keys k JOIN held h ON h.target_table = k.target_table AND h.scaffold = k.scaffold AND h.loaded_at <= k.loaded_at
    AND (h.removed_at IS NULL OR h.removed_at > k.loaded_at)),
lost AS (
  SELECT k.* FROM keys k LEFT JOIN fine f ON f.ref_table = k.ref_table AND f.target_table = k.target_table AND f.scaffold = k.scaffold
    AND f.loaded_at = k.loaded_at WHERE f.scaffold IS NULL),
found AS (
  SELECT r.ref_table, l.target_table, strftime(r.loaded_at, '%Y-%m') AS period, r.sample, r.scaffold
  FROM refs r JOIN lost l ON l.ref_table = r.ref_table AND l.scaffold = r.scaffold AND l.loaded_at = r.loaded_at)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""WITH p AS (SELECT {_NAME.format('chrom')} AS k, count(*) AS n FROM profile GROUP BY 1),
g AS (SELECT genome AS k, count(*) AS n FROM stb GROUP BY 1)
SELECT 'profile.chrom' AS key_field, k AS key_value FROM p WHERE k IS NOT NULL AND n * 100 >= {HEAVY_PERCENT} * (SELECT sum(n) FROM p)
UNION ALL SELECT 'stb.genome', k FROM g WHERE k IS NOT NULL AND n * 100 >= {HEAVY_PERCENT} * (SELECT sum(n) FROM g)""",
        "p3_scaffold_summary": f"""WITH s AS ({_POSITIONS})
SELECT scaffold, CAST(n_rows AS BIGINT) AS n_rows, CAST(covered_positions AS BIGINT) AS covered_positions,
  CAST(coverage_sum AS DOUBLE) / nullif(n_complete, 0) AS mean_coverage FROM s""",
        "p3_genome_summary": f"""WITH s AS ({_POSITIONS}),
m AS (SELECT DISTINCT {_NAME.format('scaffold')} AS scaffold, genome FROM stb WHERE removed_at IS NULL AND genome IS NOT NULL AND scaffold IS NOT NULL)
SELECT genome, CAST(count(*) AS BIGINT) AS n_scaffolds, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(covered_positions) AS BIGINT) AS covered_positions,
  CAST(sum(coverage_sum) AS DOUBLE) / nullif(sum(n_complete), 0) AS mean_coverage FROM s JOIN m USING (scaffold) GROUP BY genome""",
        "p6_found": f"WITH {_REFS} SELECT DISTINCT * FROM found",
        "p6_orphan_counts": f"""WITH {_REFS} SELECT ref_table, target_table, period, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT scaffold) AS BIGINT) AS n_scaffolds
FROM found GROUP BY 1, 2, 3""",
    }
