from pyspark.sql import functions as F

from locusforge import session


def test_spread_only_where_there_are_few_partitions(spark):
    df = spark.range(1000).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(df, "id").rdd.getNumPartitions() == 3 * cores
    for many in (spark.range(0, 1000, 1, 64), spark.range(0, 1000, 1, cores), spark.range(0, 1000, 1, cores).where("id < 100")):
        assert session.spread(many, "id").rdd.getNumPartitions() == many.rdd.getNumPartitions()
    assert session.spread(spark.range(0, 1000, 1, cores), "id", cores + 1).rdd.getNumPartitions() == 3 * cores and session.spread(df, "id", 1).rdd.getNumPartitions() == 1
    assert session.spread(spark.range(0), "id").count() == 0 and session.spread(df, "id").agg(F.sum("id")).first()[0] == 499500


def test_cut_lineage_uses_the_folder_of_the_context(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    assert session.cut_lineage(spark.range(5)).count() == 5
    assert session.ensure_checkpoint_dir(spark).startswith(f"file:{tmp_path}/shared") and any((tmp_path / "shared").rglob("part-*"))
