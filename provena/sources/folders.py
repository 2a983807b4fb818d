"""Folders of written parts, seen through the cluster's file system."""

from __future__ import annotations

from pyspark.errors.exceptions.captured import UnknownException
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _at(spark, path)
    return system.exists(place)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if there is no folder."""
    place, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def names(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of ``key`` for which a whole part ``key=value`` lies below the folder."""
    found = [n.removeprefix(f"{key}=") for n in listed(spark, path) if n.startswith(f"{key}=")]
    return [v for v in found if exists(spark, f"{path}/{key}={v}/_SUCCESS")]


def numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    return sorted(map(int, names(spark, path, key)))


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place, system = _at(spark, path)
        system.delete(place, True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one; only one of several writers succeeds."""
    place, system = _at(spark, path)
    try:
        out = system.create(place, False)
    except (Py4JJavaError, UnknownException):
        if system.exists(place):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
