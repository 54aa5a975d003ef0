"""Comparison of profiles: coverage and error filters, shared loci, runs without difference, genome and gene statistics.

Everything works on any number of sample pairs at once: loci and the pieces counted from them carry ``sample_1, sample_2``, and a
single comparison is the case of one pair. Profiles have ``sample, chrom, pos, gene, A, C, G, T``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from locusforge.conventions import BASES
from locusforge.functions import ani
from locusforge.operators import pairing
from locusforge.session import shuffle_partitions

PAIR = ["sample_1", "sample_2"]
NO_NAME = "NA"
MIN_COVERAGE, MIN_GENE_LENGTH = 5, 100


def with_coverage(profile: DataFrame) -> DataFrame:
    """Counts as longs and their sum ``cov``; null counts as 0."""
    counts = {b: F.coalesce(F.col(b).cast("long"), F.lit(0).cast("long")) for b in BASES}
    return profile.withColumns(counts).withColumn("cov", F.col("A") + F.col("C") + F.col("G") + F.col("T"))


def coverage_filter(profile: DataFrame, min_cov: int = MIN_COVERAGE) -> DataFrame:
    """Rows covered at least ``min_cov`` times, with ``cov``."""
    return with_coverage(profile).where(F.col("cov") >= min_cov)


def adjust_for_errors(profile: DataFrame, model: DataFrame, clamp: bool = False) -> DataFrame:
    """Base counts below the model's limit for the coverage set to 0.

    A coverage that the model lacks sets all counts to 0, unless ``clamp`` gives it the limit of the greatest one.
    The model has a row per coverage; it is joined with a broadcast only below Spark's size threshold.
    """
    limits = model.select(F.col("cov").cast("long").alias("cov"), F.col("max_error_count").cast("long").alias("__limit"))
    rows = profile
    if clamp:
        rows = rows.withColumn("__cov", F.col("cov")).withColumn("cov", F.least("cov", limits.agg(F.max("cov")).scalar()))
    rows = rows.join(limits, "cov", "left")
    if clamp:
        rows = rows.withColumn("cov", F.col("__cov")).drop("__cov")
    return rows.withColumns({b: F.when(F.col(b) >= F.col("__limit"), F.col(b)).otherwise(F.lit(0).cast("long")) for b in BASES}).drop("__limit")


#: Positions in a chunk. Loci of a chunk are joined, put in order and counted in one place; only the counts travel on.
CHUNK = 128
#: Blocks of second samples that loci are joined in.
BLOCKS = 4


def _chunked(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by scaffold, chunk and ``keys``. The number of partitions is stated, as the join makes many times the rows that it
    reads and the size of its input is no measure for joining partitions again."""
    spark = df.sparkSession
    n = max(shuffle_partitions(spark), 4 * spark.sparkContext.defaultParallelism)
    return df.withColumn("chunk", F.expr(f"cast(pos as bigint) div {CHUNK}")).repartition(n, *keys, "chrom", "chunk")


def shared_loci(left: DataFrame, right: DataFrame | None = None, method: str = "popani", pairs: DataFrame | None = None) -> DataFrame:
    """``sample_1, sample_2, scaffold, chunk, pos, gene, surr`` of positions that both samples of a pair cover; gene of the left.

    Without ``right`` the samples of ``left`` are compared with each other, every pair with sample_1 < sample_2 once; with it every
    sample of the one with every sample of the other. pairs: ``sample_1, sample_2``; only these, the rows of sample_1 being given
    their partners first, so that the join never makes more rows than the pairs need.

    Both sides are partitioned by scaffold, chunk and the second sample's block or name, so that the loci of a task are bounded
    whatever the number of samples. Where the session accepts joins partitioned by some of their keys (``build_session`` sets
    ``spark.sql.requireAllClusterKeysForCoPartition`` for that), the loci are never shuffled; the result is the same without.
    """
    other = left if right is None else right
    a = left.select(F.col("sample").alias("sample_1"), "chrom", "pos", "gene", *BASES)
    b = other.select(F.col("sample").alias("sample_2"), "chrom", "pos", *(F.col(x).alias(f"{x}_2") for x in BASES))
    if pairs is not None:
        a = a.join(pairs.select(*PAIR).distinct(), "sample_1")
        joined = _chunked(a, "sample_2").join(_chunked(b, "sample_2"), ["sample_2", "chrom", "chunk", "pos"])
    else:
        b = b.withColumn("block", F.pmod(F.xxhash64("sample_2"), F.lit(BLOCKS)).cast("int"))
        a = a.withColumn("block", F.explode(F.array(*map(F.lit, range(BLOCKS)))))
        joined = _chunked(a, "block").join(_chunked(b, "block"), ["block", "chrom", "chunk", "pos"])
        if right is None:
            joined = joined.where("sample_1 < sample_2")
    return joined.select(*PAIR, F.col("chrom").alias("scaffold"), "chunk", "pos", "gene", ani.of_columns(method).alias("surr"))


def compared(profile: DataFrame, method: str = "popani", pairs: DataFrame | None = None, every_block: bool = False) -> DataFrame:
    """What all statistics of pairs are made from: :func:`pairing.pieces` of the samples of ``profile``.

    Given pairs, and methods that exist as Column expressions only, go through the loci; the result is the same.
    """
    arrays = ani.array_method(method)
    if pairs is None and arrays is not None:
        return pairing.pieces(profile, arrays, every_block)
    return pieces_of(shared_loci(profile, None, method, pairs))


def _running_differences(*keys: str, first: str | None = None) -> Column:
    w = Window.partitionBy(*([first] if first else []), *PAIR, *keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.col("surr") == 0, 1).otherwise(0)).over(w)


def contiguity(loci: DataFrame) -> DataFrame:
    """Loci with ``group_id``: the number of differences up to and with the locus on its scaffold.

    A differing locus opens a block and belongs to it; uncovered positions do not end one.
    """
    return loci.withColumn("group_id", _running_differences("scaffold"))


def pieces_of(loci: DataFrame) -> DataFrame:
    """Loci counted within their chunk, in the form of :func:`pairing.pieces`; frames that have it already stay as they are."""
    if "surr" not in loci.columns:
        return loci
    # a number first, so that the sort rarely compares the names
    keyed = loci.withColumn("__key", F.xxhash64(*PAIR, "scaffold", "chunk"))
    numbered = keyed.withColumn("__local", _running_differences("scaffold", "chunk", first="__key"))
    sets = numbered.groupingSets([[*map(F.col, [*PAIR, "scaffold", "chunk", "gene"])], [*map(F.col, [*PAIR, "scaffold", "chunk", "__local"])]], *PAIR, "scaffold", "chunk", "gene", "__local")
    of_gene = F.grouping("__local") == 1
    fine = sets.agg(of_gene.alias("of_gene"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("surr") > 0).alias("s"), F.count_if(F.col("surr") == 0).alias("d"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    gene = F.when(F.col("of_gene"), F.coalesce("gene", F.lit(NO_NAME)))
    return fine.select(*PAIR, "scaffold", "chunk", gene.alias("gene"), F.when(~F.col("of_gene"), F.col("__local")).alias("local"), "n", "s", F.when(F.col("of_gene"), 0).otherwise(F.col("d")).alias("d"), "first_pos", "last_pos")


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with ``group_id``: the differences of earlier chunks added to the number of a block within its chunk, so that a block
    that runs over several chunks has one."""
    before = Window.partitionBy("__key", *PAIR, "scaffold").orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("__key", F.xxhash64(*PAIR, "scaffold"))  # a number first, so that the sort rarely compares the names
    return pieces.withColumn("group_id", F.col("local") + F.coalesce(F.sum("d").over(before), F.lit(0)))


def blocks(loci: DataFrame) -> DataFrame:
    """``sample_1, sample_2, scaffold, group_id, first_pos, last_pos, length`` of loci, or of pieces that have every block."""
    parts = _numbered(pieces_of(loci).where("gene is null")).groupBy(*PAIR, "scaffold", "group_id")
    return parts.agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n").alias("length"))


def _with_genome(df: DataFrame, stb: DataFrame) -> DataFrame:
    return df.join(stb.select("scaffold", "genome"), "scaffold", "left").withColumn("genome", F.coalesce("genome", F.lit(NO_NAME)))


def _percent(part: str, whole: str) -> Column:
    return F.col(part) / F.when(F.col(whole) != 0, F.col(whole)) * 100


def genome_similarity(loci: DataFrame, stb: DataFrame) -> DataFrame:
    """``sample_1, sample_2, genome, total_positions, share_allele_pos, genome_pop_ani``."""
    per_scaffold = pieces_of(loci).where("gene is not null").groupBy(*PAIR, "scaffold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = _with_genome(per_scaffold, stb).groupBy(*PAIR, "genome").agg(F.sum("n").alias("total_positions"), F.sum("s").alias("share_allele_pos"))
    return sums.withColumn("genome_pop_ani", _percent("share_allele_pos", "total_positions"))


def compare_genomes(loci: DataFrame, stb: DataFrame, min_gene_length: int = MIN_GENE_LENGTH) -> DataFrame:
    """All statistics per pair and genome, of loci or pieces. Gene columns are null where no gene is long enough.

    Blocks are numbered over the chunks of a scaffold; then follow one aggregation by gene or block and a last one by genome. What was
    compared is neither read nor counted a second time.
    """
    is_block = F.col("gene").isNull()
    named = _with_genome(_numbered(pieces_of(loci)), stb).withColumn("__s", F.when(is_block, F.col("scaffold")))
    parts = named.groupBy(*PAIR, "genome", "gene", "__s", "group_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    counted = ~is_block & (F.col("gene") != NO_NAME) & (F.col("n") >= min_gene_length)
    sums = parts.groupBy(*PAIR, "genome").agg(
        F.sum(F.when(~is_block, F.col("n"))).alias("total_positions"),
        F.sum(F.when(~is_block, F.col("s"))).alias("share_allele_pos"),
        F.max(F.when(is_block, F.col("n"))).alias("max_consecutive_length"),
        F.count_if(counted).alias("g"),
        F.count_if(counted & (F.col("n") == F.col("s"))).alias("i"),
    )
    some = F.col("g") > 0
    return sums.select(
        "genome", "total_positions", "share_allele_pos", _percent("share_allele_pos", "total_positions").alias("genome_pop_ani"), "max_consecutive_length",
        F.when(some, F.col("g")).alias("shared_genes_count"), F.when(some, F.col("i")).alias("identical_gene_count"), F.when(some, _percent("i", "g")).alias("perc_id_genes"), *PAIR,
    )


def longest_blocks(loci: DataFrame, stb: DataFrame) -> DataFrame:
    """``sample_1, sample_2, genome, max_consecutive_length``."""
    by_block = _numbered(pieces_of(loci).where("gene is null")).groupBy(*PAIR, "scaffold", "group_id").agg(F.sum("n").alias("n"))
    by_scaffold = by_block.groupBy(*PAIR, "scaffold").agg(F.max("n").alias("n"))
    return _with_genome(by_scaffold, stb).groupBy(*PAIR, "genome").agg(F.max("n").alias("max_consecutive_length"))


def _by_gene(loci: DataFrame, stb: DataFrame, min_gene_length: int) -> DataFrame:
    fine = _with_genome(pieces_of(loci).where("gene is not null"), stb)
    sums = fine.groupBy(*PAIR, "genome", "gene").agg(F.sum("n").alias("total_positions"), F.sum("s").alias("share_allele_pos"))
    return sums.where(F.col("total_positions") >= min_gene_length)


def gene_summary(loci: DataFrame, stb: DataFrame, min_gene_length: int = MIN_GENE_LENGTH) -> DataFrame:
    """``sample_1, sample_2, genome, shared_genes_count, identical_gene_count, perc_id_genes``; loci outside genes do not count."""
    genes = _by_gene(loci, stb, min_gene_length).where(F.col("gene") != NO_NAME)
    sums = genes.groupBy(*PAIR, "genome").agg(F.count(F.lit(1)).alias("shared_genes_count"), F.count_if(F.col("total_positions") == F.col("share_allele_pos")).alias("identical_gene_count"))
    return sums.withColumn("perc_id_genes", _percent("identical_gene_count", "shared_genes_count"))


def compare_genes(loci: DataFrame, stb: DataFrame, min_gene_length: int = MIN_GENE_LENGTH) -> DataFrame:
    """``sample_1, sample_2, genome, gene, total_positions, share_allele_pos, ani``; loci outside genes form the gene NA."""
    return _by_gene(loci, stb, min_gene_length).withColumn("ani", _percent("share_allele_pos", "total_positions"))


def scope_stb(stb: DataFrame, scope: str = "all") -> DataFrame:
    """The scaffolds of the genomes named in ``scope``, separated by commas; ``all`` keeps every one."""
    return stb if scope == "all" else stb.where(F.col("genome").isin([g.strip() for g in scope.split(",")]))


def in_scope(profile: DataFrame, stb: DataFrame) -> DataFrame:
    return profile.join(stb.select(F.col("scaffold").alias("chrom")).distinct(), "chrom", "left_semi")


def prepare(profile: DataFrame, min_cov: int = MIN_COVERAGE, model: DataFrame | None = None) -> DataFrame:
    """Coverage filter, then error filter if a model is given."""
    rows = coverage_filter(profile, min_cov)
    return rows if model is None else adjust_for_errors(rows, model)


def compare_pair(profile_1: DataFrame, profile_2: DataFrame, stb: DataFrame, model: DataFrame | None = None, *, min_cov: int = MIN_COVERAGE, min_gene_length: int = MIN_GENE_LENGTH, scope: str = "all", method: str = "popani", memory_mode: str = "heavy") -> DataFrame:
    """A row for every genome of ``stb``, zeros where nothing is shared. Profiles hold one sample each.

    ``memory_mode`` heavy or light are the same plan here, as partitions spill; other values raise ValueError.
    """
    if memory_mode not in ("heavy", "light"):
        raise ValueError("memory_mode must be heavy or light")
    wanted = scope_stb(stb, scope)
    p1, p2 = (in_scope(p, wanted) if scope != "all" else p for p in (profile_1, profile_2))
    names = [p.agg(F.max("sample")).scalar() for p in (profile_1, profile_2)]
    result = compare_genomes(shared_loci(prepare(p1, min_cov, model), prepare(p2, min_cov, model), method), wanted, min_gene_length)
    every = wanted.select("genome").where("genome is not null").distinct()
    full = result.drop(*PAIR).join(every, "genome", "full")
    return full.fillna(0).select(*result.columns[:8], names[0].alias("sample_1"), names[1].alias("sample_2"))


def scaffolds(profile: DataFrame) -> DataFrame:
    """Distinct scaffolds of a profile."""
    return profile.select(F.col("chrom").alias("scaffold")).where("scaffold is not null").distinct()
