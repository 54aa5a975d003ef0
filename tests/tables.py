"""Variants of the smallest test tables: empty, and with null rows, repeated rows and further columns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession, functions as F

SOURCE = Path("/root/testdata/sf0.001")
NAMES = "profile comparison stb genomes_bed_file genome_lengths profile_registry sample_population documents eval_items reading_labels".split()
CLASHING = "key node n seq at chunk item length lead terms graph root value metric month ids starts level_ batch_id salt shard x german cell edge t0 t1 n_rows is_key scope __chunk".split()


def make(spark: SparkSession, folder: Path, variant: str) -> str:
    for name in NAMES:
        df = spark.read.parquet(str(SOURCE / f"{name}.parquet"))
        if variant == "empty":
            df = df.limit(0)
        else:
            nulls = df.limit(3).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
            df = df.unionByName(df.limit(200)).unionByName(nulls)
            if name == "documents":  # ids stay unique, but for the null rows
                df = df.dropDuplicates(["doc_id"]).unionByName(nulls)
                long = df.where("doc_id = 1").select(*(F.lit(10**6).cast("long").alias(c) if c == "doc_id" else F.repeat("text", F.lit(200)).alias(c) if c == "text" else F.col(c) for c in df.columns))
                df = df.unionByName(long)
            df = df.withColumns({c: F.lit("clash") for c in CLASHING if c not in df.columns})
        df.coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)
