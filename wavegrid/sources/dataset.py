"""Datasets on disk: images by pattern, with their settings and environment."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import Config

#: Written last: a dataset without it is not whole.
SEAL = "whole"


def save_dataset(images: DataFrame, dataset_dir: str, prefix: str, cfg: Config, environment: dict[str, str] | None = None) -> str:
    """Writes images (partitioned by pattern), settings and environment; returns the dataset's path.

    The seal, with the number of images by pattern as they were written, comes last. A write that fails leaves a
    folder without it, which ``load_dataset`` and ``datasets`` take for none. Datasets of one second get names of their own.
    """
    spark = images.sparkSession
    now = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    path = f"{dataset_dir}/{prefix}_{now}_{uuid.uuid4().hex[:8]}"
    images.write.partitionBy("pattern").parquet(f"{path}/images")
    facts = {"generated_at": now, "spark_version": pyspark.__version__, "parallelism": str(spark.sparkContext.defaultParallelism)} | (environment or {})
    spark.createDataFrame([(json.dumps(cfg.settings()),)], "settings string").write.parquet(f"{path}/settings")
    spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} string" for k in facts)).write.parquet(f"{path}/environment")
    written = spark.read.schema(images.schema).parquet(f"{path}/images")
    written.groupBy("pattern").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/{SEAL}")
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def datasets(spark: SparkSession, dataset_dir: str, prefix: str = "") -> list[str]:
    """Paths of the whole datasets in a folder, by name."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(dataset_dir)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    paths = [f"{dataset_dir}/{n}" for n in sorted(names) if n.startswith(prefix)]
    return [p for p in paths if _exists(spark, f"{p}/{SEAL}/_SUCCESS")]


def load_dataset(spark: SparkSession, path: str, patterns: Sequence[str | int] | None = None) -> tuple[DataFrame, dict, dict]:
    """Images, settings and environment of a whole dataset; of the given patterns only their partitions are read.

    A dataset without its seal and a pattern that it doesn't hold raise an error.
    """
    if not _exists(spark, f"{path}/{SEAL}/_SUCCESS"):
        raise ValueError(f"there is no whole dataset at {path}")
    sealed = {r["pattern"]: r["n"] for r in spark.read.parquet(f"{path}/{SEAL}").collect()}
    images = spark.read.parquet(f"{path}/images") if sealed else spark.read.schema("idx long, image array<array<float>>, pattern string").parquet(f"{path}/images")
    if patterns is not None:
        if lost := sorted(set(map(str, patterns)) - set(map(str, sealed))):
            raise ValueError(f"the dataset has no pattern {', '.join(lost)}")
        images = images.where(F.col("pattern").isin(list(patterns)))
    settings = json.loads(spark.read.parquet(f"{path}/settings").first()[0])
    return images, settings, spark.read.parquet(f"{path}/environment").first().asDict()


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, n): how many images a whole dataset was written with."""
    return spark.read.parquet(f"{path}/{SEAL}")
