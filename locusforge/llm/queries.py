"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from locusforge.conventions import BASES, coverage, sample_name, scaffold_name
from locusforge.llm import components, leakage, packing, quantiles, reading, runs, sql, tokens
from locusforge.session import read_table, shuffle_partitions, spread


def _micros(c: str) -> Column:
    """A timestamp without time zone as microseconds since 1970."""
    return F.expr(f"datediff({c}, date'1970-01-01') * 86400000000L + hour({c}) * 3600000000L + minute({c}) * 60000000L + cast(extract(second from {c}) * 1000000 as bigint)")


def _number(micros: str) -> Column:
    """Microseconds since 1970 as the number yyyyMMddHHmmss."""
    day, second = f"({micros} div 86400000000L)", f"(({micros} div 1000000L) % 86400L)"
    return F.expr(f"cast(date_format(date_add(date'1970-01-01', cast({day} as int)), 'yyyyMMdd') as bigint) * 1000000L + ({second} div 3600) * 10000L + (({second} div 60) % 60) * 100L + {second} % 60")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Comparison rows with unified sample names in order; rows with a null genome or sample and self pairs left out."""
    c = read_table(spark, d, "comparison").withColumns({"__a": sample_name("sample_1"), "__b": sample_name("sample_2")})
    return c.where("genome is not null and __a is not null and __b is not null and __a <> __b").withColumns({"first_sample": F.least("__a", "__b"), "second_sample": F.greatest("__a", "__b")}).drop("__a", "__b")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    profile = read_table(spark, d, "profile").where("sample is not null and chrom is not null")
    of_profile = runs.repeated_runs(profile, F.concat_ws("|", "sample", scaffold_name("chrom")), F.col("pos"), [F.col(b) for b in BASES], max_gap=3, max_step=1, min_rows=5, chunk=4096, prefer=[F.col("loaded_at")])
    of_pairs = runs.repeated_runs(_pairs(spark, d), F.concat_ws("|", "first_sample", "second_sample", "genome"), _micros("compared_at"), [F.col("max_consecutive_length")], max_gap=None, max_step=5, min_rows=3, chunk=30 * 86_400_000_000)
    return (
        of_profile.select(F.lit("profile").alias("seq_table"), F.col("seq").alias("seq_key"), "run_start", "run_end", "n_rows")
        .unionByName(of_pairs.select(F.lit("comparison").alias("seq_table"), F.col("seq").alias("seq_key"), _number("run_start").alias("run_start"), _number("run_end").alias("run_end"), "n_rows"))
    )


#: Positions in a profiling batch of scaffolds, and of genomes.
SCAFFOLD_BATCH, GENOME_BATCH = 500_000, 10_000_000


def p2_scaffold_batches(spark: SparkSession, d: str) -> DataFrame:
    """Scaffolds by their distinct segments in batches; scaffolds of one genome come together first."""
    bed = read_table(spark, d, "genomes_bed_file").where("scaffold is not null and end_pos > start_pos").select(scaffold_name("scaffold").alias("item"), "start_pos", "end_pos").distinct()
    stb = read_table(spark, d, "stb").where("scaffold is not null and genome is not null").groupBy(scaffold_name("scaffold").alias("item")).agg(F.min("genome").alias("lead"))
    lengths = bed.groupBy("item").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("length"))
    items = lengths.join(stb, "item", "left").withColumn("terms", F.concat(packing.name_terms(F.col("item")), F.array_compact(F.array("lead"))))
    return packing.pack(items, SCAFFOLD_BATCH).withColumnRenamed("item", "scaffold")


def p2_genome_batches(spark: SparkSession, d: str) -> DataFrame:
    lengths = read_table(spark, d, "genome_lengths").groupBy(F.col("genome").alias("item")).agg(F.max("genome_length").alias("length"))
    items = lengths.withColumns({"lead": F.substring("item", 1, 7), "terms": packing.name_terms(F.col("item"))})
    return packing.pack(items, GENOME_BATCH).withColumnRenamed("item", "genome")


def _whole(placed: DataFrame, item: str, capacity: int) -> DataFrame:
    """What is placed of each item: its pieces, their length, whether they follow on one another, and whether all their batches hold."""
    totals = placed.groupBy("batch_id").agg(F.sum("piece_length").alias("held"))
    rows = placed.join(totals, "batch_id").groupBy(item)
    end = F.max(F.col("piece_start") + F.col("piece_length"))
    fits = F.every((F.col("held") == F.col("batch_length")) & (F.col("held") <= capacity))
    return rows.agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("piece_length").alias("length"), ((F.min("piece_start") == 0) & (end == F.sum("piece_length"))).alias("whole"), fits.alias("fits"))


def p2_scaffold_items(spark: SparkSession, d: str) -> DataFrame:
    """Every scaffold with what its batches hold of it."""
    return _whole(p2_scaffold_batches(spark, d), "scaffold", SCAFFOLD_BATCH)


def p2_genome_items(spark: SparkSession, d: str) -> DataFrame:
    """Every genome with what its batches hold of it."""
    return _whole(p2_genome_batches(spark, d), "genome", GENOME_BATCH)


PERCENTS = (25, 50, 75, 90, 99)


#: Names of the counted columns; digests carry their numbers, and months as yyyymm (0: none, ALL_MONTHS: all of them).
METRICS, ALL_MONTHS = (*BASES, "sum"), 999999


def _percentile_rows(scope: str, states: DataFrame) -> DataFrame:
    p = quantiles.percentiles(states, ["key", "month"], ALL_MONTHS, PERCENTS)
    month = F.when(F.col("month") == ALL_MONTHS, "all").when(F.col("month") == 0, "none").otherwise(F.format_string("%04d-%02d", F.expr("month div 100"), F.expr("month % 100")))
    metric = F.element_at(F.array(*map(F.lit, METRICS)), F.col("metric") + 1)
    return p.select(F.lit(scope).alias("scope"), "key", month.alias("month"), metric.alias("metric"), "n", *(f"p{x}" for x in PERCENTS), quantiles.rank_error("n").alias("rank_error"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of A, C, G, T and their sum per scaffold and genome, by month and (month ``all``) of all months merged
    from the monthly digests. Genomes are reached through the rows of stb that are not removed; their digests are those of
    their scaffolds added up. Each input partition shuffles one packed row per scaffold and month."""
    profile = read_table(spark, d, "profile").where("chrom is not null")
    month = F.coalesce(F.year("loaded_at") * 100 + F.month("loaded_at"), F.lit(0)).alias("month")
    counts = profile.select(scaffold_name("chrom").alias("key"), month, *BASES, coverage().alias("sum"))
    local = quantiles.gather_tree(quantiles.pack(counts, ["key", "month"], METRICS), ["key", "month"], profile.rdd.getNumPartitions())
    scaffolds = local.repartition("key")
    stb = read_table(spark, d, "stb").where("removed_at is null and genome is not null and scaffold is not null").select(scaffold_name("scaffold").alias("key"), "genome").distinct()
    of_genomes = quantiles.gather(scaffolds.join(stb, "key").select(F.col("genome").alias("key"), "month", "state"), ["key", "month"])
    genomes = quantiles.gather_tree(of_genomes, ["key", "month"], shuffle_partitions(spark)).repartition("key")
    return _percentile_rows("scaffold", scaffolds).unionByName(_percentile_rows("genome", genomes))


#: ANI in percent from which two samples carry the same strain, and positions that must be exceeded.
LINK_ANI, LINK_POSITIONS = 99.9, 10_000


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    latest = (
        _pairs(spark, d).where("genome_pop_ani is not null and compared_at is not null")
        .groupBy("genome", "first_sample", "second_sample")
        .agg(F.max(F.struct("compared_at", F.when(F.col("genome_pop_ani") <= 1, F.col("genome_pop_ani") * 100).otherwise(F.col("genome_pop_ani")).alias("ani"), "total_positions")).alias("r"))
    )
    links = latest.where((F.col("r.ani") >= LINK_ANI) & (F.col("r.total_positions") > LINK_POSITIONS))
    return components.connected_components(links, "genome", "first_sample", "second_sample").select(F.col("graph").alias("genome"), F.col("root").alias("group_sample"), F.col("node").alias("sample"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_documents(spark, d))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again; null texts come back empty."""
    return tokens.decode(p7_ids(spark, d))


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and characters covered per document, from the offsets."""
    o = tokens.offsets(_documents(spark, d))
    return o.select("doc_id", F.size("starts").alias("n_tokens"), F.coalesce(F.array_max("ends"), F.lit(0)).alias("last_char"))


def p7_covered(spark: SparkSession, d: str) -> DataFrame:
    """Characters that the tokens of each document cover."""
    return p7_offsets(spark, d).select("doc_id", "last_char")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_documents(spark, d), read_table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_documents(spark, d), read_table(spark, d, "reading_labels")).select("doc_id", "level")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p2_scaffold_batches, p2_genome_batches, p2_scaffold_items, p2_genome_items, p4_percentiles, p5_found, p7_ids, p7_decoded, p7_offsets, p7_covered, p8_found, p9_found)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
