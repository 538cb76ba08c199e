"""Readers and writers for the entity files: CSV with or without header, Parquet and JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas of the entities' files.
REVIEWS = "item_id long, user_id long, item_name string, user_name string, ts timestamp, rating double, title string, body string"
ITEMS_RAW = "item_id long, site_name string, name string, year string, description string, type string, extra string"
USERS = "user_name string, user_id long"
LEMMAS = "review_id long, token string, lemma string, pos_tag string"
METRICS = "test_rmse double, test_mae double, fit_time double, test_time double, k int, mean_rmse double, mean_mae double"
PHRASES = "item_id long, user_id long, index long, phrase string, length int, embedding array<float>"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True, distinct: bool = False) -> DataFrame:
    """CSV with quoted line breaks; malformed numbers become null. distinct drops repeated rows, as header-less files hold them."""
    out = spark.read.schema(schema).csv(path, header=header, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    return out.dropDuplicates() if distinct else out


def read_indexed_csv(spark: SparkSession, path: str, schema: str, index: str = "row_id") -> DataFrame:
    """CSV whose first column is the row index; it is kept as an explicit key."""
    return read_csv(spark, path, f"{index} long, {schema}")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON array of records, or JSON lines."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in UTF-8, nulls included."""
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_matrix(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A matrix as rows (id, values: array<double>), which is read back column by column or row by row without loading it whole."""
    df.select(F.col(df.columns[0]).alias("id"), F.col(df.columns[1]).cast("array<double>").alias("values")).write.mode(mode).parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, values array<double>").parquet(path)


def rating_triples(df: DataFrame, user: str, item: str, rating: str, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """(user_id, item_id, rating) within the rating scale; rows out of it or without a rating are left out."""
    r = F.col(rating).cast("double")
    return df.select(F.col(user).alias("user_id"), F.col(item).alias("item_id"), r.alias("rating")).where(F.col("rating").between(low, high))
