"""Reading landed dumps and writing exports."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def upper_names(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[c.upper() for c in rows.columns])


def read_json_lines(
    spark: SparkSession, path: str, schema: str, partitions: int | None = None
) -> DataFrame:
    """One object per line, gzipped or not. A gzip file is one task, so spread it when it is large."""
    rows = spark.read.schema(schema).json(path)
    return rows.repartition(partitions) if partitions else rows


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files, each one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_documents(rows: DataFrame, path: str) -> None:
    """One JSON document, an array of objects, per partition."""

    def wrap(frames):
        import pandas as pd

        start = "["
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"value": [start + ",\n".join(frame["value"])]})
                start = ","
        yield pd.DataFrame({"value": ["[]" if start == "[" else "]"]})

    text = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    text.mapInPandas(wrap, "value string").write.text(path)


def write_json_lines(rows: DataFrame, path: str, compression: str | None = None) -> None:
    writer = rows.write
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted text may run over several lines."""
    return spark.read.schema(schema).options(**_CSV).option("multiLine", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Null and '' are both written as blanks and read back as null."""
    rows.write.options(**_CSV).option("emptyValue", "").csv(path)


def with_json(rows: DataFrame, column: str, schema: str, into: str = "payload") -> DataFrame:
    """Parse a text column that holds one payload per row."""
    return rows.withColumn(into, F.from_json(column, schema))
