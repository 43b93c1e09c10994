"""How training rows are dealt to tasks."""

from pyspark.sql import functions as F

from tabloom.operators import models
from tabloom.session import training_tasks


def test_training_rows_of_one_partition_are_dealt_to_tasks(spark):
    rows = spark.range(0, 100_000, numPartitions=1).withColumn("label", F.lit(1.0))
    out = models.packed(rows)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 1.1 * models.ROWS_PER_TASK
    assert models.packed(rows.limit(10)).rdd.getNumPartitions() == 1


def test_saved_model_joins_its_customers_once(spark):
    from tabloom.plans import source_plans

    path, table = source_plans._saved(spark, "/root/testdata/sf0.001")
    assert path and table.storageLevel.useMemory
    table.unpersist()


def test_tasks_grow_before_their_number_does(spark):
    rows = spark.range(0, 1_000_000, numPartitions=4).withColumn("label", F.lit(1.0))
    out = models.packed(rows)
    assert out.rdd.getNumPartitions() == 24  # three for each of eight cores
    out.unpersist()
    assert training_tasks(spark, 10**9, models.ROWS_PER_TASK, models.MOST_ROWS) == 5000
