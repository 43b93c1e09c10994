"""Listings, images in class folders, and detection label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.profile import class_from_path


def list_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(name, size, modified) of all files below the path; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select(F.col("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(F.contains("name", F.lit(prefix))) if prefix else out


def largest_matching_file(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """(name, size): the largest file of the first suffix that any file has."""
    rank = F.lit(None)
    for i, s in enumerate(suffixes):
        rank = F.when(F.lower("name").endswith(s), i) if i == 0 else rank.when(F.lower("name").endswith(s), i)
    ranked = files.withColumn("__r", rank).where(F.col("__r").isNotNull())
    best = F.struct((-F.col("__r")).alias("r"), "size", "name")
    return ranked.agg(F.max(best).alias("b")).where(F.col("b").isNotNull()).select("b.name", "b.size")


def scan_image_folder(spark: SparkSession, path: str) -> DataFrame:
    """(class, origin, height, width, channels, data) of the readable images; data is in BGR order."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    inner = F.regexp_replace(F.col("image.origin"), "^.*/([^/]+/[^/]+)$", "$1")
    return images.select(class_from_path(inner).alias("class"), "image.origin", "image.height", "image.width",
                         F.col("image.nChannels").alias("channels"), "image.data").where(F.col("class").isNotNull())


def parse_box_line(line: str = "value") -> dict:
    """Fields of a `class cx cy w h` line; NULL class for a malformed line."""
    parts = F.split(F.trim(line), r"\s+")
    get = lambda i, t: F.try_element_at(parts, F.lit(i)).try_cast(t)
    good = (F.size(parts) >= 5) & F.element_at(parts, 1).rlike(r"^[-+]?\d+$")
    return {"class_id": F.when(good, get(1, "int")), "cx": get(2, "double"), "cy": get(3, "double"), "w": get(4, "double"), "h": get(5, "double")}


def scan_detection_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, class_id, cx, cy, w, h) of the well-formed lines of label text files; the class list is skipped."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"))
    lines = text.where(~F.lower("file").endswith("/classes.txt"))
    return lines.withColumns(parse_box_line()).where(F.col("class_id").isNotNull()).drop("value")


def detection_classes(labels: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(class_id, name): given names, else `Class_0` up to the largest id, else one `Object`."""
    if names:
        listed = F.array(*[F.lit(n) for n in names])
        return labels.sparkSession.range(1).select(F.posexplode(listed).alias("class_id", "name"))
    top = labels.agg(F.coalesce(F.max("class_id"), F.lit(-1)).alias("top"))
    ids = F.when(F.col("top") >= 0, F.sequence(F.lit(0), F.col("top"))).otherwise(F.array(F.lit(0)))
    return top.select("top", F.explode(ids).alias("class_id")).select(
        "class_id", F.when(F.col("top") >= 0, F.concat(F.lit("Class_"), F.col("class_id"))).otherwise("Object").alias("name"))
