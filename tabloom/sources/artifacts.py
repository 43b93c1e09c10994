"""Saving and loading a fitted pipeline with its schemas."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_model(model: PipelineModel, path: str, schema: DataFrame | None = None, metadata: dict | None = None) -> None:
    """Write the pipeline, one row of metadata and the feature schema table below `path`."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    meta = spark.range(1).select(F.lit(json.dumps(metadata or {})).alias("value"))
    meta.write.mode("overwrite").text(f"{path}/metadata")
    if schema is not None:
        schema.write.mode("overwrite").parquet(f"{path}/schema")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict, DataFrame | None]:
    model = PipelineModel.load(f"{path}/model")
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    try:
        schema = spark.read.parquet(f"{path}/schema")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a model saved without a schema has no such folder
            raise
        schema = None
    return model, metadata, schema
