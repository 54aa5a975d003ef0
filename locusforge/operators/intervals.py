"""Genes and segments: positions in ranges, ranges to positions, lengths to segments, FASTA headers and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from locusforge.session import cut_lineage

MAX_SEGMENT = 500_000
NO_NAME = "NA"
#: Positions in a bin of the range join; ranges are entered in every bin that they touch.
BIN = 10_000


def annotate_genes(positions: DataFrame, ranges: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Positions with the ``gene`` of the range, both ends included, that holds them; of several the greatest (start, gene).

    positions: ``chrom, pos`` and more; ranges: ``gene, scaffold, start, end``. Positions without a range get NA. Both sides
    meet on (scaffold, bin), so that a scaffold with very many ranges is spread over its bins.
    """
    r = ranges.where("gene is not null and start <= end").select(F.col("scaffold").alias("__s"), F.col("start").cast("long").alias("__a"), F.col("end").cast("long").alias("__e"), F.col("gene").alias("__g"))
    r = r.withColumn("__b", F.explode(F.sequence(F.expr(f"__a div {bin_size}"), F.expr(f"__e div {bin_size}"))))
    wanted = positions.select("chrom", "pos").where("chrom is not null and pos is not null").distinct().withColumn("__pb", F.expr(f"cast(pos as bigint) div {bin_size}"))
    hit = wanted.join(r, (F.col("chrom") == F.col("__s")) & (F.col("__pb") == F.col("__b")) & F.col("pos").between(F.col("__a"), F.col("__e")))
    best = hit.groupBy("chrom", "pos").agg(F.max(F.struct("__a", "__g")).alias("__best")).select("chrom", "pos", F.col("__best.__g").alias("__gene"))
    return positions.drop("gene").join(best, ["chrom", "pos"], "left").withColumn("gene", F.coalesce("__gene", F.lit(NO_NAME))).drop("__gene")


def explode_ranges(ranges: DataFrame, scaffolds: DataFrame | None = None) -> DataFrame:
    """``scaffold, gene, pos`` for every position of every range, of the given scaffolds only if there are any."""
    r = ranges.where("start <= end")
    if scaffolds is not None:
        r = r.join(scaffolds.select("scaffold").distinct(), "scaffold", "left_semi")
    return r.select("scaffold", "gene", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("pos"))


def segments(lengths: DataFrame, max_length: int = MAX_SEGMENT) -> DataFrame:
    """``scaffold, start, end``: half-open segments of at most ``max_length`` of scaffolds ``scaffold, length``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1, F.lit(max_length).cast("long")))
    s = lengths.where("length > 0").select("scaffold", "length", starts.alias("start"))
    return s.select("scaffold", "start", F.least(F.col("start") + max_length, F.col("length").cast("long")).alias("end"))


def gene_ranges(lines: DataFrame) -> DataFrame:
    """``gene, scaffold, start, end`` of headers ``>id # start # end # ...`` in ``value``; the scaffold is the id up to its last ``_``."""
    f = F.split(F.substring("value", 2, 2**30), r"\s*#\s*")
    gene = F.trim(f[0])
    return lines.where(F.col("value").startswith(">")).select(gene.alias("gene"), F.regexp_replace(gene, "_[^_]*$", "").alias("scaffold"), F.trim(F.get(f, F.lit(1))).try_cast("bigint").alias("start"), F.trim(F.get(f, F.lit(2))).try_cast("bigint").alias("end"))


def fasta_lengths(records: DataFrame) -> DataFrame:
    """``scaffold, length`` of FASTA records read with ``lineSep='>'``: id up to the first blank, sequence without line ends."""
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return records.where(F.length(F.trim("value")) > 0).select(F.regexp_extract(head, r"^(\S*)", 1).alias("scaffold"), F.length(body).cast("long").alias("length"))


def chunks(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Rows with ``chunk`` 0..n-1: contiguous slices in the given order, the last taking the remainder.

    The rows are put in order and written once; row numbers are their places in their partition and the counts of the partitions
    before, a small table that is joined. No task sees all rows, and nothing is collected.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered.withColumns({"__p": F.shiftright("__id", 33), "__r": F.expr("__id & 8589934591")}).drop("__id"))
    sizes = ordered.groupBy(F.col("__p").alias("__q")).agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("__q", before.alias("__before"), F.greatest(F.floor(F.sum("__n").over(Window.partitionBy()) / n), F.lit(1)).alias("__size"))
    rows = ordered.join(places, F.col("__p") == F.col("__q"))
    return rows.withColumn("chunk", F.least(F.expr("(__before + __r) div __size"), F.lit(n - 1)).cast("long")).select(*df.columns, "chunk")
