"""Files of any Hadoop file system: existence, folders, copies, a cache by name, small texts, and metrics."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _path(spark, path)
    return fs.exists(place)


def make_dirs(spark: SparkSession, path: str) -> None:
    place, fs = _path(spark, path)
    fs.mkdirs(place)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder, between file systems too."""
    (a, fs_a), (b, fs_b) = _path(spark, source), _path(spark, target)
    fs_b.mkdirs(b.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs_a, a, fs_b, b, False, True, spark._jsc.hadoopConfiguration())


def cached(spark: SparkSession, source: str, folder: str) -> str:
    """A copy of source below folder, under the MD5 of its path; made only once."""
    target = f"{folder}/{hashlib.md5(source.encode()).hexdigest()}/{source.rstrip('/').rsplit('/', 1)[-1]}"
    if not exists(spark, target):
        copy(spark, source, target)
    return target


def put_text(spark: SparkSession, path: str, text: str) -> None:
    place, fs = _path(spark, path)
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def log_metrics(spark: SparkSession, metrics: dict[str, float], step: int, path: str | None = None) -> None:
    """Numbers of one step as rows (step, name, value) appended to JSON, or printed without a path."""
    rows = [(int(step), name, float(value)) for name, value in sorted(metrics.items())]
    if path is None:
        print(f"step {step}: " + ", ".join(f"{n} {v:.6g}" for _, n, v in rows))
        return
    spark.createDataFrame(rows, "step long, name string, value double").coalesce(1).write.mode("append").json(path)
