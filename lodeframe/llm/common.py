"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans.skew import HOT_SHARE, lookup_join, weighed_join
from lodeframe.session import checkpoint, ship, written

__all__ = ["HOT_SHARE", "WORD_BYTES", "ascii_lower", "byte_words", "checkpoint", "columns_of", "lookup_join", "ship", "table", "unused", "weighed_join", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with as many marks as it takes to be no column of the frames."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a frame by their names as they are: dots in them are no paths."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, as the contracts ask."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of UTF-8 text: A-Z lower-cased, all other ASCII but 0-9 and a-z to a space.
#: What lies between spaces is a match of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []
