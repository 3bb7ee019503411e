"""What the corpus operators share: reading tables, words, bound lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often the body's lambdas refer to it."""
    return F.transform(F.array(value), body)[0]


def whole(text: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def unit(*parts: Column | str) -> Column:
    """A repeatable number in [0, 1) from the values of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))
