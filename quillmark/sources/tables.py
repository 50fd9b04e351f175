"""CSV tables of the evaluation, and parallel text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import read_lines


def read_plain_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table without a header: method and summary are its first two columns."""
    rows = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=False)
    return rows.select(F.col("_c0").alias("method"), F.col("_c1").alias("summary"))


def read_headed_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    rows = spark.read.option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path, header=True)
    return rows.select("comment", "comment1")


def write_csv(df: DataFrame, path: str, header: bool, encoding: str = "UTF-8") -> None:
    """Writes to a path of its own; a path that is being read cannot be overwritten."""
    df.write.mode("overwrite").option("encoding", encoding).option("escape", '"').csv(path, header=header)


def read_parallel_text(spark: SparkSession, hypothesis: str, reference: str) -> DataFrame:
    """Lines of two files that belong together by number: line_no, hypothesis, reference."""
    left = read_lines(spark, hypothesis).withColumnRenamed("value", "hypothesis")
    right = read_lines(spark, reference).withColumnRenamed("value", "reference")
    return left.join(right, "line_no")
