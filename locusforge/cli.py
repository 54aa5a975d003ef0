"""Command line: python -m locusforge.cli GROUP COMMAND ..."""

from __future__ import annotations

import argparse
import importlib.util

from pyspark.sql import SparkSession, functions as F

from locusforge import schemas
from locusforge.functions.nullmodel import null_model
from locusforge.operators import compare, coverage, intervals
from locusforge.operators.registry import ComparisonConfig, ComparisonDatabase, ProfileDatabase
from locusforge.session import build_session
from locusforge.sources import io
from locusforge.streaming.ingest import complete, pileup_profile


def _profile(spark: SparkSession, path: str, sample: str):
    return io.read_parquet(spark, path).select(F.lit(sample).alias("sample"), *schemas.PROFILE.names)


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")


def build_null_model(spark, a):
    io.write_parquet(null_model(spark, a.error_rate, a.max_total_reads, a.p_threshold), a.output)


def merge_parquet(spark, a):
    io.write_parquet(io.merge_parquet(spark, a.input_dir), a.output)


def process_mpileup(spark, a):
    ranges = io.read_gene_ranges(spark, a.gene_range_table) if a.gene_range_table else None
    io.write_parquet(pileup_profile(spark.read.text(a.pileup), ranges), a.output)


def make_bed(spark, a):
    io.write_tsv(intervals.segments(io.read_fasta_lengths(spark, a.fasta), a.max_scaffold_length), a.output)


def genome_lengths(spark, a):
    io.write_parquet(coverage.genome_lengths(io.read_stb(spark, a.stb), io.read_bed(spark, a.bed)), a.output)


def genome_breadth_matrix(spark, a):
    name = a.name or _name(a.profile)
    b = coverage.genome_breadth(_profile(spark, a.profile, name), io.read_parquet(spark, a.genome_lengths), io.read_stb(spark, a.stb), a.min_cov)
    io.write_parquet(b.select("genome", F.col("breadth").alias(name)), a.output)


def collect_breadth_tables(spark, a):
    io.write_parquet(coverage.collect_breadth_tables([io.read_parquet(spark, p) for p in a.tables]), a.output)


def strain_heterogeneity(spark, a):
    h = coverage.strain_heterogeneity(_profile(spark, a.profile, _name(a.profile)), io.read_stb(spark, a.stb), a.min_cov, a.freq_threshold)
    io.write_parquet(h.drop("sample"), a.output)


def build_profile_db(spark, a):
    ProfileDatabase.from_csv(spark, a.csv).save_as_new_database(a.output)


def build_comparison_config(spark, a):
    db = ComparisonDatabase(ProfileDatabase(spark, a.profile_db), ComparisonConfig.from_dict({"gene_db_id": a.gene_db_id, "reference_id": a.reference_db_id, "scope": a.scope, "min_cov": a.min_cov, "min_gene_compare_len": a.min_gene_compare_len, "stb_file_loc": a.stb, "null_model_loc": a.null_model or ""}), a.comp_db)
    if not io.exists(spark, a.comp_db):
        db.location = None
        db.save_new_compare_database(a.comp_db)
    db.dump(a.output)


def to_complete_table(spark, a):
    io.write_csv(ComparisonDatabase.load(spark, a.database).to_complete_input_table(), a.output)


def gene_range_table(spark, a):
    io.write_tsv(io.read_gene_fasta(spark, a.gene_fasta), a.output)


def gene_loc_table(spark, a):
    io.write_parquet(intervals.explode_ranges(io.read_gene_fasta(spark, a.gene_fasta), io.read_lines(spark, a.scaffolds, "scaffold")), a.output)


def single_compare_genome(spark, a):
    p1, p2 = (_profile(spark, p, n or _name(p)) for p, n in ((a.profile_1, a.name_1), (a.profile_2, a.name_2)))
    model = io.read_parquet(spark, a.null_model) if a.null_model else None
    out = compare.compare_pair(p1, p2, io.read_stb(spark, a.stb), model, min_cov=a.min_cov, min_gene_length=a.min_gene_compare_len, scope=a.scope, method=a.method, memory_mode=a.memory_mode)
    io.write_parquet(out, a.output)


def prepare_profiling(spark, a):
    lengths = io.read_fasta_lengths(spark, a.fasta)
    bed = intervals.segments(lengths)
    io.write_tsv(bed, f"{a.output}/genomes_bed_file.bed")
    io.write_tsv(io.read_gene_fasta(spark, a.gene_fasta), f"{a.output}/gene_range_table.tsv")
    io.write_parquet(coverage.genome_lengths(io.read_stb(spark, a.stb), bed), f"{a.output}/genome_lengths.parquet")


def profile_single(spark, a):
    rows = pileup_profile(spark.read.text(a.pileup), io.read_gene_ranges(spark, a.gene_range_table))
    if a.bed:
        bed = io.read_bed(spark, a.bed).select(F.col("scaffold").alias("chrom")).distinct()
        rows = rows.join(bed, "chrom", "left_semi")
    io.write_parquet(rows, a.output)
    io.write_tsv(compare.scaffolds(io.read_parquet(spark, a.output)), f"{a.output}.scaffolds")


def run_compare_genomes(spark, a):
    """All remaining pairs of a database in one plan, appended to its comparison table."""
    db = ComparisonDatabase.load(spark, a.database)
    model = io.read_parquet(spark, db.config.null_model_loc) if db.config.null_model_loc else None
    stb = compare.scope_stb(io.read_stb(spark, db.config.stb_file_loc), db.config.scope)
    names = [tuple(r) for r in db.profiles.df.select("profile_location", "profile_name").distinct().toLocalIterator()]  # a path per sample
    if not names:
        print("nothing left to compare")
        return
    profiles = io.by_file(io.read_parquet(spark, sorted({p for p, _ in names})), names, "sample").select("sample", *schemas.PROFILE.names)

    def run(pairs):
        rows = compare.prepare(compare.in_scope(profiles, stb) if db.config.scope != "all" else profiles, db.config.min_cov, model)
        return compare.compare_genomes(compare.compared(rows, a.method, pairs), stb, db.config.min_gene_compare_len)

    print("compared" if complete(db.profiles.df, db.location, run) else "nothing left to compare")


def run_profile(spark, a):
    """All samples of a table in one plan: pileup text in, one folder of profiles by sample out, with their breadth and heterogeneity."""
    table = spark.read.csv(a.input_table, header=True)
    if lost := {"sample_name", "pileup"} - set(table.columns):
        raise ValueError(f"Input table missing required columns: {sorted(lost)}")
    names = [tuple(r) for r in table.select("pileup", "sample_name").distinct().toLocalIterator()]
    if gone := io.missing(spark, (p for p, _ in names)):
        raise FileNotFoundError(gone[0])
    lines = io.by_file(spark.read.text(sorted({p for p, _ in names})), names, "sample")
    rows = pileup_profile(lines, io.read_gene_ranges(spark, a.gene_range_table), keep=("sample",))
    wanted = io.read_bed(spark, a.bed_file).select(F.col("scaffold").alias("chrom")).distinct()
    io.write_parquet(rows.join(wanted, "chrom", "left_semi"), f"{a.run_dir}/profiles", partition_by=["sample"])
    profiles, stb = io.read_parquet(spark, f"{a.run_dir}/profiles"), io.read_stb(spark, a.stb_file)
    io.write_parquet(coverage.genome_breadth(profiles, io.read_parquet(spark, a.genome_length_file), stb), f"{a.run_dir}/breadth")
    io.write_parquet(coverage.strain_heterogeneity(profiles, stb), f"{a.run_dir}/heterogeneity")


def build_comp_database(spark, a):
    """A comparison database from profiles and a configuration, going on from an existing comparison table if one is given."""
    if a.comp_db_file and not io.exists(spark, a.comp_db_file):
        raise FileNotFoundError(f"{a.comp_db_file} does not exist.")
    db = ComparisonDatabase(ProfileDatabase(spark, a.profile_db_dir), ComparisonConfig.from_json(a.config_file), a.comp_db_file)
    db.save_new_compare_database(f"{a.output_dir}/comparisons")
    db.dump(f"{a.output_dir}/database.json")


def setup_problems(spark) -> list[str]:
    """What keeps the engine from working here: Java and Python sides are run once over a few rows."""
    found = []
    for name in ("pyarrow", "pandas", "numpy"):
        if importlib.util.find_spec(name) is None:
            found.append(f"the Python package {name} is missing")
    try:
        lines = spark.createDataFrame([("c\t1\tN\t2\tAc\tII",)], "value string")
        profile = pileup_profile(lines).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("sample"), "*")
        if compare.compared(profile).where("gene is not null").count() != 1:
            found.append("a comparison of two samples gave a wrong result")
    except Exception as e:  # noqa: BLE001
        found.append(f"a comparison of two samples failed: {e}")
    return found


def test(spark, a):
    found = setup_problems(spark)
    print("\n".join(found) if found else "The setup works: pileup text was counted and two samples were compared.")


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="locusforge")
    root.add_argument("--master", default="local[*]")
    groups = root.add_subparsers(dest="group", required=True)
    sub = {g: groups.add_parser(g).add_subparsers(dest="command", required=True) for g in ("utilities", "gene_tools", "compare", "profile", "run")}
    groups.add_parser("test").set_defaults(run=test)

    def command(group: str, name: str, run, *options):
        p = sub[group].add_parser(name)
        p.set_defaults(run=run)
        for o in options:
            flag, kw = (o, {}) if isinstance(o, str) else o
            required = not kw or set(kw) == {"nargs"}
            p.add_argument(f"--{flag}", **({"required": True} if required else {}), **kw)

    opt = lambda name, default=None, kind=str: (name, {"default": default, "type": kind})
    command("utilities", "build-null-model", build_null_model, opt("error-rate", 0.001, float), opt("max-total-reads", 10_000, int), opt("p-threshold", 0.05, float), "output")
    command("utilities", "merge_parquet", merge_parquet, "input-dir", "output")
    command("utilities", "process_mpileup", process_mpileup, "pileup", opt("gene-range-table"), "output")
    command("utilities", "make_bed", make_bed, "fasta", opt("max-scaffold-length", intervals.MAX_SEGMENT, int), "output")
    command("utilities", "get_genome_lengths", genome_lengths, "stb", "bed", "output")
    command("utilities", "genome_breadth_matrix", genome_breadth_matrix, "profile", "stb", "genome-lengths", opt("name"), opt("min-cov", 1, int), "output")
    command("utilities", "collect_breadth_tables", collect_breadth_tables, ("tables", {"nargs": "+"}), "output")
    command("utilities", "strain_heterogeneity", strain_heterogeneity, "profile", "stb", opt("min-cov", 5, int), opt("freq-threshold", 0.8, float), "output")
    command("utilities", "build-profile-db", build_profile_db, "csv", "output")
    command("utilities", "build-comparison-config", build_comparison_config, "profile-db", "comp-db", "gene-db-id", "reference-db-id", opt("scope", "all"), opt("min-cov", 5, int), opt("min-gene-compare-len", 100, int), "stb", opt("null-model"), "output")
    command("utilities", "to-complete-table", to_complete_table, "database", "output")
    command("gene_tools", "gene-range-table", gene_range_table, "gene-fasta", "output")
    command("gene_tools", "gene-loc-table", gene_loc_table, "gene-fasta", "scaffolds", "output")
    command("compare", "single_compare_genome", single_compare_genome, "profile-1", "profile-2", opt("name-1"), opt("name-2"), "stb", opt("null-model"), opt("min-cov", 5, int), opt("min-gene-compare-len", 100, int), opt("scope", "all"), opt("method", "popani"), opt("memory-mode", "heavy"), "output")
    command("profile", "prepare_profiling", prepare_profiling, "fasta", "gene-fasta", "stb", "output")
    command("profile", "profile-single", profile_single, "pileup", "gene-range-table", opt("bed"), "output")
    command("run", "profile", run_profile, "input-table", "stb-file", "gene-range-table", "bed-file", "genome-length-file", "run-dir")
    command("run", "compare_genomes", run_compare_genomes, "database", opt("method", "popani"))
    command("run", "build-comp-database", build_comp_database, "profile-db-dir", "config-file", opt("comp-db-file"), "output-dir")
    return root


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or build_session(a.master)
    a.run(spark, a)


if __name__ == "__main__":
    main()
