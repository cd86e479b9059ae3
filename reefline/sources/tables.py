"""Table scans and writes with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reefline.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TABLES[name]).format(fmt).load(f"{root}/{name}")


def read_jdbc(spark: SparkSession, url: str, name: str, *, bounds: tuple[int, int],
              partitions: int, column: str = "id", **options: str) -> DataFrame:
    """The same table from a database, read in parallel ranges of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    for key, value in {"partitionColumn": column, "lowerBound": bounds[0],
                       "upperBound": bounds[1], "numPartitions": partitions, **options}.items():
        reader = reader.option(key, value)
    return reader.load()


def write_table(df: DataFrame, root: str, name: str, mode: str = "append",
                partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{name}")
