from paperloom.plans.layout import fill_cores


def test_few_files_are_spread_and_many_are_not(spark, tmp_path, plan):
    cores = spark.sparkContext.defaultParallelism
    for files in (1, cores, 5 * cores):
        path = str(tmp_path / str(files))
        spark.range(1000).repartition(files).write.parquet(path)
        # A file per split, as large files would have.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        try:
            filled = fill_cores(spark.read.parquet(path))
            assert ("RoundRobinPartitioning" in plan(filled)) == (files < cores)
            assert filled.count() == 1000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
