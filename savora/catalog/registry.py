"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.catalog import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables and views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = views.duckdb_sql(oracle)
        return build

    return add


def rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Both engines add floats in their own order, so they are compared rounded."""
    return rows.withColumns({c: F.round(F.col(c), digits) for c in columns})


def joined_text(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
