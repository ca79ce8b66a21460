"""Two small tables that the examples read."""

from pyspark.sql import DataFrame, SparkSession


def people(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "ada"), (2, "ben"), (3, "cleo"), (None, "dan")], "person int, name string")


def visits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "museum"), (1, "harbour"), (3, "tower"), (9, "castle")], "visitor int, place string")
