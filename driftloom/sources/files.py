"""Readers and writers of feature tables, with fallback between places."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".parquet": ("parquet", {}), ".csv": ("csv", {"header": True}), ".tsv": ("csv", {"header": True, "sep": "\t"})}


def format_of(path: str) -> tuple[str, dict]:
    for suffix, found in FORMATS.items():
        if path.rstrip("/").endswith(suffix):
            return found
    raise ValueError(f"{path} is neither Parquet nor CSV nor TSV")


def anonymous(path: str) -> dict[str, str]:
    """Options of a reader that uses no credentials for the bucket of an ``s3a://`` path; none for other paths."""
    if not path.startswith("s3a://"):
        return {}
    return {f"fs.s3a.bucket.{path.split('/')[2]}.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table by its path's suffix: Parquet, CSV or TSV. Text tables take a schema or have it inferred; only ``columns`` are read.

    ``s3a://`` paths are read without credentials, as public buckets are; that holds for this reader alone.
    """
    kind, options = format_of(path)
    reader = spark.read.options(**options, **anonymous(path))
    if schema is not None:
        reader = reader.schema(schema)
    elif kind == "csv":
        reader = reader.option("inferSchema", True)
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def read_first(spark: SparkSession, places: Iterable[str | None], **options) -> DataFrame:
    """The table at the first place that can be read; the last failure is raised if none can.

    A place counts as read once a row could be fetched (or the table is empty), so that broken files and stores that
    fail late, whatever they raise, lead to the next place.
    """
    failure: Exception = ValueError("no place is given")
    for place in places:
        if place is None:
            continue
        try:
            df = read_table(spark, place, **options)
            df.take(1)
            return df
        except Exception as e:  # any failure of any store
            failure = e
    raise failure


def gather(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All files below a folder that match a pattern, as one table with ``frame_number`` from the last /T<number> or /T=<number> of the path."""
    kind, options = format_of(pattern)
    reader = spark.read.options(**options, recursiveFileLookup=True, pathGlobFilter=pattern)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).format(kind).load(folder)
    return df.withColumn("frame_number", F.regexp_extract(F.col("_metadata.file_path"), "^.*/T=?([0-9]+)", 1).cast("int"))


def write_table(df: DataFrame, path: str, by: list[str] = (), parameters: dict[str, str] | None = None, comments: dict[str, str] | None = None) -> DataFrame:
    """Write by the path's suffix, split by columns; parameters and column comments go along in a catalog row, which is returned."""
    kind, options = format_of(path)
    writer = df.write.mode("overwrite").options(**options).format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)
    return catalog_row(df.sparkSession, path, df.columns, parameters or {}, comments or {})


def check_written(spark: SparkSession, path: str, df: DataFrame, expected: int | None = None) -> None:
    """ValueError unless the table at a path has the columns and as many rows as ``df``, which is counted where ``expected`` does not tell them."""
    rows, columns = written_differences(spark, path, df, expected)
    if columns:
        raise ValueError(f"{path} has other columns: {sorted(columns)}")
    if rows:
        raise ValueError(f"{path} has another number of rows, by {rows}")


def written_differences(spark: SparkSession, path: str, df: DataFrame, expected: int | None = None) -> tuple[int, set[str]]:
    """How many rows the table at a path has more than ``df``, and the columns that only one of them has."""
    again = read_table(spark, path)
    return again.count() - (df.count() if expected is None else expected), set(again.columns) ^ set(df.columns)


def catalog_row(spark: SparkSession, path: str, columns: list[str], parameters: dict[str, str], comments: dict[str, str]) -> DataFrame:
    schema = "path string, columns array<string>, parameters map<string,string>, comments map<string,string>"
    return spark.createDataFrame([(path, columns, parameters, comments)], schema)


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Column descriptions as metadata of the schema."""
    return df.select(*(F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns))
