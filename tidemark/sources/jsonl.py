"""Strict JSON-lines reading: a line that is not an object stops the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.functions import guards
from tidemark.functions.exprs import blank


def line_problem(line: Column) -> Column:
    """Why a line cannot be a record: blank, undecodable, or not an object."""
    parsed = F.try_parse_json(line)
    return (
        F.when(blank(line), "blank")
        .when(parsed.isNull(), "undecodable")
        .when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "not_an_object")
    )


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines with a problem.  ``lines``: a text column ``value``."""
    return lines.withColumn("problem", line_problem(F.col("value"))).where("problem is not null")


def parse_strict(lines: DataFrame, schema: StructType) -> DataFrame:
    """Typed records of every line, or an error naming one that is unreadable.

    A line that lacks a field of the schema is refused like one that is no object; a field of
    another type stops the job when it is read.
    """
    names = F.array(*[F.lit(n) for n in schema.names]).cast("array<string>")
    lacking = F.size(F.array_except(names, F.coalesce(F.json_object_keys("value"), F.array()))) > 0
    problem = F.coalesce(line_problem(F.col("value")), F.when(lacking, "missing_field"))
    told = lines.withColumn("problem", problem)
    guards.refuse(told, F.col("problem").isNotNull(), guards.IntegrityError, "unreadable line", ["value", "problem"])
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(record.alias("_r")).select("_r.*")


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON-lines file or folder; one that does not exist is empty.

    The text source keeps blank lines, which the JSON source would drop without a word.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return parse_strict(spark.read.text(path), schema)
