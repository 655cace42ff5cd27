"""Stored tables in layers, as Parquet folders below one root."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora import schemas

BATCH = "load_batch"


class TableStore:
    """Tables named ``layer.table``, each load in a folder of its own.

    Writing a load again replaces that load only, so a job that is run a second time after a failure
    adds no row twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        layer, name = table.split(".")
        return f"{self.root}/{layer}/{name}"

    def create_empty(self, tables: Iterable[str] = tuple(schemas.TABLES)) -> None:
        """Create or replace tables by their fixed schemas."""
        for table in tables:
            empty = self.spark.createDataFrame([], schemas.TABLES[table])
            self.replace(table, empty)

    def replace(self, table: str, rows: DataFrame) -> None:
        """``rows`` must not read the table itself."""
        rows.withColumn(BATCH, F.lit("base")).write.mode("overwrite").partitionBy(BATCH).parquet(
            self.path(table)
        )

    def append(self, table: str, rows: DataFrame, batch: str) -> DataFrame:
        """Add one load under its own name; its rows come back as they were written."""
        path = f"{self.path(table)}/{BATCH}={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def read(self, table: str) -> DataFrame:
        reader = self.spark.read.option("basePath", self.path(table))
        if table in schemas.TABLES:
            reader = reader.schema(f"{schemas.TABLES[table]}, {BATCH} string")
        return reader.parquet(self.path(table)).drop(BATCH)

    def read_but(self, table: str, batch: str) -> DataFrame:
        """The table without one load, for a job that writes that load."""
        reader = self.spark.read.option("basePath", self.path(table)).schema(f"{schemas.TABLES[table]}, {BATCH} string")
        return reader.parquet(self.path(table)).where(F.col(BATCH) != batch).drop(BATCH)

    def register_views(self, tables: Iterable[str]) -> None:
        """Make tables known to SQL as ``layer_table``; ``spark.catalog.listTables`` lists them."""
        for table in tables:
            self.read(table).createOrReplaceTempView(table.replace(".", "_"))


def meal_mention_rows(rows: DataFrame) -> DataFrame:
    """The six stored columns; rows without a meal are left out, '' is kept."""
    return rows.where(F.col("meal_name").isNotNull()).select(
        "business_name", "rating", "meal_name", "sentiment", "cluster", "cluster_label"
    )


def dated(rows: DataFrame, create_date: str | None = None) -> DataFrame:
    """Stamp rows with the given day, or today."""
    day = F.lit(create_date).cast("date") if create_date else F.current_date()
    return rows.withColumn("create_date", day)
