"""Registry of profiles and table of finished comparisons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from locusforge import schemas
from locusforge.operators.blocks import combined
from locusforge.sources import io


def remaining_pairs(names: DataFrame, done: DataFrame) -> DataFrame:
    """``profile_1, profile_2`` (profile_1 < profile_2) of the distinct ``profile_name`` that ``done`` (``sample_1, sample_2``, in
    either order) lacks, in no order. The pairs are the result itself; they are made by pairs of blocks of names."""
    n = names.select("profile_name").where("profile_name is not null").distinct()
    pairs = combined(n.select(F.col("profile_name").alias("profile_1")), n.select(F.col("profile_name").alias("profile_2"))).where("profile_1 < profile_2")
    finished = done.where("sample_1 is not null and sample_2 is not null").select(F.least("sample_1", "sample_2").alias("profile_1"), F.greatest("sample_1", "sample_2").alias("profile_2")).distinct()
    return pairs.join(finished, ["profile_1", "profile_2"], "left_anti")


def completion_table(pairs: DataFrame, registry: DataFrame) -> DataFrame:
    """``sample_name_1/2, profile_location_1/2, scaffold_location_1/2`` of pairs."""
    out = pairs.select(F.col("profile_1").alias("sample_name_1"), F.col("profile_2").alias("sample_name_2"))
    for k in ("1", "2"):
        side = registry.select(F.col("profile_name").alias(f"sample_name_{k}"), F.col("profile_location").alias(f"profile_location_{k}"), F.col("scaffold_location").alias(f"scaffold_location_{k}"))
        out = out.join(side, f"sample_name_{k}", "left")
    return out.select(*(f"{c}_{k}" for c in ("sample_name", "profile_location", "scaffold_location") for k in "12"))


def merged_distinct(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second).distinct()


def profile_names(comps: DataFrame) -> DataFrame:
    """Distinct samples of both sides of a comparison table."""
    return comps.select(F.col("sample_1").alias("profile_name")).union(comps.select("sample_2")).where("profile_name is not null").distinct()


@dataclass(frozen=True)
class ProfileItem:
    """A profile: its files must exist, and its database ids must not be empty where they are given."""

    profile_name: str
    profile_location: str
    scaffold_location: str
    reference_db_id: str | None = None
    gene_db_id: str | None = None

    @classmethod
    def checked(cls, exists: Callable[[str], bool], **values: str) -> ProfileItem:
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        try:
            item = cls(**values)
        except TypeError as e:
            raise ValueError(str(e)) from e
        for name in ("profile_location", "scaffold_location"):
            if not exists(getattr(item, name)):
                raise ValueError(f"{name} {getattr(item, name)!r} does not exist")
        if "" in (item.reference_db_id, item.gene_db_id):
            raise ValueError("a database id is empty")
        return item


class ProfileDatabase:
    """Profiles as a Parquet folder; new, it is empty."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark, self.location = spark, location
        self.df = spark.createDataFrame([], schemas.REGISTRY) if location is None or not io.exists(spark, location) else io.read_parquet(spark, location)
        self._validate(self.df)

    def _exists(self, path: str) -> bool:
        return path is not None and io.exists(self.spark, path)

    def _validate(self, df: DataFrame) -> None:
        schemas.require(df.columns, schemas.REGISTRY)
        places = df.select(F.explode(F.array("profile_location", "scaffold_location")).alias("p")).distinct()
        if lost := io.missing(self.spark, (r[0] for r in places.toLocalIterator())):  # a row per file
            raise ValueError(f"{len(lost)} profile or scaffold files of the registry do not exist, such as {lost[0]!r}")

    def add_profile(self, **values: str) -> None:
        try:
            item = ProfileItem.checked(self._exists, **values)
        except ValueError as e:
            raise ValueError(f"The profile data provided is not valid: {e}") from e
        row = self.spark.createDataFrame([tuple(asdict(item)[n] or "" for n in schemas.REGISTRY.names)], schemas.REGISTRY)
        self.df = merged_distinct(self.df.select(*schemas.REGISTRY.names), row)

    def add_database(self, other: ProfileDatabase) -> None:
        self._validate(other.df)
        self.df = merged_distinct(self.df.select(*schemas.REGISTRY.names), other.df.select(*schemas.REGISTRY.names))

    def save_as_new_database(self, location: str) -> None:
        if location == self.location:
            raise ValueError("the output is the database itself; update it instead")
        io.write_parquet(self.df, location)
        self.location = location

    def update_database(self) -> None:
        if self.location is None:
            raise ValueError("the database has no location yet")
        self.df = io.replace_parquet(self.df, self.location)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> ProfileDatabase:
        out = cls(spark)
        out.df = io.read_csv(spark, path, schemas.REGISTRY)
        out._validate(out.df)
        return out

    def to_csv(self, path: str) -> None:
        io.write_csv(self.df, path)


@dataclass(frozen=True)
class ComparisonConfig:
    """What two comparison tables must share to be merged. ``scope`` is ``all`` or genomes separated by commas."""

    gene_db_id: str
    reference_id: str
    scope: str = "all"
    min_cov: int = 5
    min_gene_compare_len: int = 100
    null_model_p_value: float = 0.05
    stb_file_loc: str = ""
    null_model_loc: str = ""

    @classmethod
    def from_dict(cls, values: dict) -> ComparisonConfig:
        if unknown := set(values) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        try:
            out = cls(**values)
        except TypeError as e:
            raise ValueError(str(e)) from e
        if not out.gene_db_id or not out.reference_id or not out.scope or out.min_cov < 0 or out.min_gene_compare_len < 0:
            raise ValueError("ids and scope must not be empty, limits not negative")
        return out

    to_dict = asdict

    def to_json(self, path: str) -> None:
        io.write_json(asdict(self), path)  # a path with a scheme goes through the file system that Spark knows

    @classmethod
    def from_json(cls, path: str) -> ComparisonConfig:
        return cls.from_dict(io.read_json(path))

    def genomes(self) -> set[str]:
        return {g.strip() for g in self.scope.split(",")}

    def is_compatible(self, other: ComparisonConfig) -> bool:
        """All but the scope equal, and the scopes overlapping."""
        return replace(self, scope="") == replace(other, scope="") and ("all" in (self.scope, other.scope) or bool(self.genomes() & other.genomes()))

    def common_scope(self, other: ComparisonConfig) -> ComparisonConfig:
        """The narrower of both scopes."""
        if not self.is_compatible(other):
            raise ValueError("the configurations are not compatible")
        if self.scope == "all":
            return replace(self, scope=other.scope)
        return self if other.scope == "all" else replace(self, scope=",".join(sorted(self.genomes() & other.genomes())))


class ComparisonDatabase:
    """Finished comparisons of the profiles of a registry under one configuration."""

    def __init__(self, profiles: ProfileDatabase, config: ComparisonConfig, location: str | None = None):
        self.spark, self.profiles, self.config, self.location = profiles.spark, profiles, config, location
        self.df = self.spark.createDataFrame([], schemas.COMPARISON) if location is None or not io.exists(self.spark, location) else io.read_parquet(self.spark, location)
        self._validate()

    def _validate(self) -> None:
        schemas.require(self.df.columns, schemas.COMPARISON, exact=True)
        if not profile_names(self.df).join(self.profiles.df, "profile_name", "left_anti").isEmpty():
            raise ValueError("samples were compared that are not in the registry")

    def all_profile_names(self) -> set[str]:
        return {r[0] for r in profile_names(self.df).toLocalIterator()}

    def remaining_pairs(self) -> DataFrame:
        """The pairs that are missing, sorted."""
        return remaining_pairs(self.profiles.df, self.df).orderBy("profile_1", "profile_2")

    def is_complete(self) -> bool:
        return self.remaining_pairs().isEmpty()

    def add_comp_database(self, other: ComparisonDatabase) -> None:
        other._validate()
        self.config = self.config.common_scope(other.config)
        self.df = merged_distinct(self.df, other.df)

    def save_new_compare_database(self, location: str) -> None:
        if location == self.location:
            raise ValueError("the output is the database itself; update it instead")
        io.write_parquet(self.df, location)
        self.location = location

    def update_compare_database(self) -> None:
        if self.location is None:
            raise ValueError("the database has no location yet")
        self.df = io.replace_parquet(self.df, self.location)

    def dump(self, path: str) -> None:
        """Paths and configuration as JSON; both databases must have been saved."""
        if None in (self.location, self.profiles.location):
            raise ValueError("save both databases first")
        io.write_json({"profile_db": self.profiles.location, "comp_db": self.location, "config": asdict(self.config)}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ComparisonDatabase:
        o = io.read_json(path)
        return cls(ProfileDatabase(spark, o["profile_db"]), ComparisonConfig.from_dict(o["config"]), o["comp_db"])

    def to_complete_input_table(self) -> DataFrame:
        return completion_table(self.remaining_pairs(), self.profiles.df)
