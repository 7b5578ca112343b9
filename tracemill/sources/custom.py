"""Data sets given by a class of a Python file, as data sources of Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import datasource

from tracemill.sources import store


#: Names that a file may use without importing them.
BASES = ("DataSource", "DataSourceReader", "InputPartition")


def load_names(spark: SparkSession, path: str) -> dict:
    """The names that a Python file at any path that Spark reads defines; the file is trusted code of the user."""
    names = {"__name__": "loaded", **{k: getattr(datasource, k) for k in BASES}}
    exec(compile(store.get_text(spark, path), path, "exec"), names)  # noqa: S102 - a plug-in by path is the feature
    return names


def register_source(spark: SparkSession, path: str, name: str) -> None:
    """Registers the class `name` of the file, a DataSource, under its own format name."""
    found = load_names(spark, path)[name]
    if not issubclass(found, datasource.DataSource):
        raise TypeError(f"{name} is no DataSource")
    spark.dataSource.register(found)
