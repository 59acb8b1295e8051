"""Lambdas over a stream of nonzeros."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import shared_folder


def lambda_updates(nonzeros: DataFrame, line: str, part: str) -> DataFrame:
    """``line, lam`` of a streaming (or static) table of nonzeros: the state is one row per distinct (line, part)."""
    return nonzeros.select(line, part).dropDuplicates([line, part]).groupBy(line).agg(F.count("*").cast("int").alias("lam"))


def lambda_stream(spark: SparkSession, path: str, line: str, part: str) -> DataFrame:
    """``i, lam`` after a stream over the Parquet files under ``path`` has been read to its end."""
    name = f"lambda_{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, file = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if file.endswith(".parquet") and _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)
    distinct = source.select(line, part).dropDuplicates([line, part])
    out = f"{shared_folder(spark)}/{name}"
    query = distinct.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return lambda_updates(spark.read.schema(source.select(line, part).schema).parquet(f"{out}/rows"), line, part).withColumnRenamed(line, "i")


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
