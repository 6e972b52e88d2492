"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of the driver's test data.
NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """Parquet tables of one folder, read lazily: ``tables.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000, **options) -> DataFrame:
    """A Parquet folder as a stream; a backlog is worked off in batches of so many files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options)
    return reader.parquet(folder)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Any format Spark reads; text formats need a schema, so that nothing is scanned to guess one."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"give a schema to read {fmt}")
    reader = spark.read.format(fmt).options(**options)
    return (reader if schema is None else reader.schema(schema)).load(path)
