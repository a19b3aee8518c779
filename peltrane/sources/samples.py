"""Sources and sinks: the split, sample files, reports and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark's binary source gives for each file.
FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, family, length, content) of files kept as folder/family/sha256. Length filters prune before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return located(files)


def located(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -1).alias("sha256"), F.element_at(parts, -2).alias("family"), "length", "content")


def spread(frame: DataFrame) -> DataFrame:
    """Rows of fewer files than the session has cores are dealt to all cores; of more files, they stay as read.

    A table of many files (any large one) is never shuffled by this. Row numbers are to be given before.
    """
    cores, files = frame.sparkSession.sparkContext.defaultParallelism, len(frame._jdf.inputFiles())
    return frame.repartition(cores) if 0 < files < cores else frame


def join_labels(features: DataFrame, labels: DataFrame, key: str = "sha256") -> DataFrame:
    """Inner: samples without a label go; repeated keys multiply."""
    return features.join(labels, key, "inner")


def load_split(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, family, ..., split) of a folder with X_train, y_train, X_test and y_test in Parquet."""
    part = lambda s: join_labels(spark.read.parquet(f"{folder}/X_{s}"), spark.read.parquet(f"{folder}/y_{s}")).withColumn("split", F.lit(s))
    return part("train").unionByName(part("test"), allowMissingColumns=True)


def union_then_join(parts: list[DataFrame], labels: list[DataFrame], key: str) -> DataFrame:
    xs, ys = parts[0], labels[0]
    for x in parts[1:]:
        xs = xs.unionByName(x)
    for y in labels[1:]:
        ys = ys.unionByName(y)
    return join_labels(xs, ys, key)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, family, first_submission) of report lines in JSON; the label columns are read only if present."""
    raw = spark.read.schema("sha256 STRING, family STRING, first_submission_date BIGINT").json(path)
    return raw.select("sha256", "family", F.timestamp_seconds("first_submission_date").alias("first_submission"))


def read_section_schema(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(feature, kind) lines of a tab-separated schema file, in order (hundreds)."""
    return [(r["value"].split("\t")[0], r["value"].split("\t")[1]) for r in spark.read.text(path).collect() if "\t" in r["value"]]


def write_table(frame: DataFrame, path: str, *partition: str) -> None:
    (frame.write.mode("overwrite").partitionBy(*partition) if partition else frame.write.mode("overwrite")).parquet(path)
