"""What several corpus operators need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut

__all__ = ["WORD_BREAK", "cut", "hex_digest", "table"]

#: Words everywhere: runs of anything but ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex_digest(text: Column) -> Column:
    """Column: lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)
