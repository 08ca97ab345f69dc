"""Result files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.evaluate import union_results


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with a header, united by column name; what is missing is null.
    All values stay text, numbers are read where they are needed."""
    return union_results([spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p) for p in paths])


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    """json: one object for each row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def split_failures(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows that went well, rows with an error) for a quarantine table."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())
