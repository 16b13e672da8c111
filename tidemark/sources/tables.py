"""Read and write tables by path."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.rows import require_schema

# Formats whose own overwrite is atomic, when their connector is on the class path.
ATOMIC_FORMATS = frozenset({"delta"})

_PUBLISHED = "_published"
_VERSIONS = "_versions"
_PUBLISHED_SCHEMA = "version string, published_at timestamp"


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = False, **options
) -> DataFrame:
    """A CSV file or folder with header lines.

    Without ``schema`` every column is text under its name in the header, which reads one
    line of one file up front; ``infer`` adds a pass over all data to guess the types. In
    each case every file's header is checked against the column names, so a file with
    other or reordered columns stops the job instead of filling the wrong ones.
    """
    reader = spark.read.option("header", True).options(**options)
    if schema is None:
        schema = reader.option("inferSchema", infer).csv(path).schema
    return reader.option("inferSchema", False).schema(schema).option("enforceSchema", False).csv(path)


def write_overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Replace a whole table and return the path written.

    Spark's overwrite of plain files deletes the old ones first, so readers may see nothing
    or half a table, and a job cannot read what it replaces. Plain files therefore go to a
    new version folder, and one appended line then makes that version the current one. A
    run that dies before that line leaves the old table in place. Formats with their own
    transaction log overwrite directly. One writer at a time is assumed.
    """
    if fmt in ATOMIC_FORMATS:
        df.write.format(fmt).mode("overwrite").save(path)
        return path
    spark = df.sparkSession
    before = _current_version(spark, path)
    # Numbered, so that a clock that is behind cannot hide a newer version.
    number = 1 if before is None else int(before.split("-")[0]) + 1
    version = f"{number:010d}-{uuid.uuid4().hex[:8]}"
    location = f"{path}/{_VERSIONS}/{version}"
    df.write.format(fmt).mode("errorifexists").save(location)
    line = spark.range(1, numPartitions=1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("published_at")
    )
    line.write.mode("append").json(f"{path}/{_PUBLISHED}")
    return location


def _current_version(spark: SparkSession, path: str) -> str | None:
    try:
        published = spark.read.schema(_PUBLISHED_SCHEMA).json(f"{path}/{_PUBLISHED}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return published.agg(F.max("version").alias("version")).first()["version"]


def current_location(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None where the path is not a versioned table."""
    version = _current_version(spark, path)
    return None if version is None else f"{path}/{_VERSIONS}/{version}"


def scan_table(
    spark: SparkSession, path: str, fmt: str = "parquet", contract: T.StructType | None = None
) -> DataFrame:
    """A stored table by path, with its column names and types checked against ``contract``."""
    location = path if fmt in ATOMIC_FORMATS else current_location(spark, path) or path
    df = spark.read.format(fmt).load(location)
    return df if contract is None else require_schema(df, contract, path)


def inspect_schema(df: DataFrame) -> DataFrame:
    """A stage report: ``(position, column_name, data_type, row_count)``, from one count."""
    lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("row_count").alias("row_count"),
        )
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(F.array(*lines)))
