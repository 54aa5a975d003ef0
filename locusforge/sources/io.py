"""Sources and sinks: Parquet, headerless TSV, CSV, text, FASTA, JSON."""

from __future__ import annotations

import atexit
import json
import re
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from locusforge import schemas
from locusforge.operators import intervals


_SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]+:/")


def read_parquet(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    """One or several files or folders as one frame."""
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.parquet(*([path] if isinstance(path, str) else path))


def merge_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """All Parquet files of a folder; ValueError if there are none."""
    if not _holds_parquet(spark, folder):
        raise ValueError(f"no Parquet files in {folder}")
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(folder)


def _holds_parquet(spark: SparkSession, folder: str) -> bool:
    fs, P = _filesystem(spark, folder)
    if not fs.exists(P(folder)):
        return False
    files = fs.listFiles(P(folder), True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def read_tsv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Tab separated, without header."""
    return spark.read.csv(path, sep="\t", schema=schema, header=False)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Comma separated with a header, columns by name; ValueError if one is missing."""
    raw = spark.read.csv(path, header=True)
    schemas.require(raw.columns, schema)
    return raw.select(*(F.col(f.name).cast(f.dataType) for f in schema))


def read_stb(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.STB)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.BED)


def read_gene_ranges(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.GENE_RANGE)


def read_gene_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Gene ranges from the headers of a gene FASTA file."""
    return intervals.gene_ranges(spark.read.text(path))


def read_fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Scaffold lengths of a reference FASTA file; FileNotFoundError if it is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return intervals.fasta_lengths(spark.read.text(path, lineSep=">"))


def read_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, compression: str = "zstd") -> None:
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t", header=False)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def replace_parquet(df: DataFrame, path: str) -> DataFrame:
    """Overwrite a folder that ``df`` may itself be read from: write beside it, then swap, then read again.

    A failed write leaves the old folder as it was and nothing beside it; a failed swap puts the old folder back. File systems have no
    exchange of folders, so that a reader that lists the folder between the two renames finds none and must try again.
    """
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    spark = df.sparkSession
    fs, P = _filesystem(spark, path)
    try:
        write_parquet(df, new)
        if fs.exists(P(path)) and not fs.rename(P(path), P(old)):
            raise OSError(f"can't move {path}")
        if not fs.rename(P(new), P(path)):
            fs.rename(P(old), P(path))
            raise OSError(f"can't move {new}")
    except BaseException:
        fs.delete(P(new), True)
        raise
    fs.delete(P(old), True)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    P = spark._jvm.org.apache.hadoop.fs.Path
    return P(path).getFileSystem(spark._jsc.hadoopConfiguration()), P


def exists(spark: SparkSession, path: str) -> bool:
    fs, P = _filesystem(spark, path)
    return fs.exists(P(path))


def missing(spark: SparkSession, paths: Iterable[str | None]) -> list[str | None]:
    """Those of the paths that do not exist, in order; null never exists. Each folder that holds any is listed once, many at a time."""
    folders: dict[str, set[str]] = {}
    lost = []
    for p in paths:
        if p is None or not p.strip("/"):
            lost.append(p)
        else:
            folder, _, name = p.rstrip("/").rpartition("/")
            folders.setdefault(folder or ("/" if p.startswith("/") else "."), set()).add(name)

    def check(item: tuple[str, set[str]]) -> list[str]:
        fs, P = _filesystem(spark, item[0])
        there = {x.getPath().getName() for x in fs.listStatus(P(item[0]))} if fs.exists(P(item[0])) else set()
        return [f"{item[0].rstrip('/')}/{n}" for n in item[1] - there]

    with ThreadPoolExecutor(16) as pool:
        for some in pool.map(check, folders.items()):
            lost += some
    return sorted(lost, key=lambda p: (p is not None, p or ""))


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names files in ``input_file_name``."""
    fs, P = _filesystem(spark, path)
    return fs.makeQualified(P(path)).toUri().toString()


def by_file(rows: DataFrame, names: Iterable[tuple[str, str]], column: str) -> DataFrame:
    """Rows read from several files or folders of files, with the names that ``names`` (path, name) gives their file or its folder.

    One read serves all of them; the names are joined. Rows of other files are left out, those of a file with several names come
    once for each.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(qualified(spark, p), n) for p, n in names], f"__path string, `{column}` string")
    place = F.regexp_replace(F.input_file_name(), "^file:/+", "file:/")
    found = rows.withColumn("__file", place).withColumn("__folder", F.regexp_replace("__file", "/[^/]*$", ""))
    table = table.withColumn("__path", F.regexp_replace("__path", "^file:/+", "file:/"))
    return found.withColumn("__path", F.explode(F.array("__file", "__folder"))).join(table, "__path").drop("__path", "__file", "__folder")


def scratch(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted as the program ends, if the session still runs then."""

    def remove() -> None:
        if SparkSession.getActiveSession() is not None or not spark._jsc.sc().isStopped():
            try:
                fs, P = _filesystem(spark, path)
                fs.delete(P(path), True)
            except Exception:  # noqa: BLE001 - the session is gone
                pass

    atexit.register(remove)
    return path


def write_json(value: object, path: str) -> None:
    """A JSON file; a path with a scheme goes to that file system through the active session, others are local."""
    text = json.dumps(value, indent=1, sort_keys=True)
    if not _SCHEME.match(path):
        Path(path).write_text(text, encoding="utf-8")
        return
    fs, P = _filesystem(SparkSession.active(), path)
    out = fs.create(P(path), True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_json(path: str) -> object:
    if not _SCHEME.match(path):
        return json.loads(Path(path).read_text(encoding="utf-8"))
    return json.loads(SparkSession.active().read.text(path, wholetext=True).first()[0])
