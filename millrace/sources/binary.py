"""Fixed-width binary event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .units import SPLIT_BYTES, read_units

RECORD_BYTES = 78


def read_fixed_width(spark: SparkSession, path: str, type_first: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Decode files of 78-byte records; files are split at record bounds, and a part of a record at their end is left out."""
    return decode_fixed_width(read_units(spark, path, RECORD_BYTES, split_bytes), type_first=type_first)


def fixed_width_problem(value: str = "value") -> Column:
    """Why a record cannot be decoded, or null when it can."""
    return F.when(F.col(value).isNull(), "no value").when(F.octet_length(value) != RECORD_BYTES, "wrong length")


def _little_endian(digits: Column, start: int, size: int) -> Column:
    """The hexadecimal digits of a little-endian number, highest first."""
    return F.concat(*(F.substring(digits, 2 * (start + i) + 1, 2) for i in reversed(range(size))))


def decode_fixed_width(records: DataFrame, value: str = "value", type_first: bool = False) -> DataFrame:
    """Decode a column of 78-byte little-endian records; others are left to ``rejected_fixed_width``.

    Layout: three 16-byte ids (two 8-byte halves each), two 9-byte texts, a 64-bit time and a
    32-bit address. The texts are ad type, event type, or the other way round with ``type_first``.
    """
    digits = F.lower(F.hex(value))

    def uuid(start: int) -> Column:
        whole = F.concat(_little_endian(digits, start, 8), _little_endian(digits, start + 8, 8))
        return F.concat_ws("-", *(F.substring(whole, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))

    def text(start: int) -> Column:
        decoded = F.decode(F.substring(value, start + 1, 9), "ISO-8859-1")
        return F.replace(F.replace(decoded, F.lit("\0"), F.lit("")), F.lit(" "), F.lit(""))

    first, second = (text(57), text(48)) if type_first else (text(48), text(57))
    return records.filter(fixed_width_problem(value).isNull()).select(
        uuid(0).alias("user_id"),
        uuid(16).alias("page_id"),
        uuid(32).alias("campaign_id"),
        first.alias("ad_type"),
        second.alias("event_type"),
        F.conv(_little_endian(digits, 66, 8), 16, -10).cast("long").alias("current_ms"),
        F.conv(_little_endian(digits, 74, 4), 16, 10).cast("long").alias("ip"),
    )


def rejected_fixed_width(records: DataFrame, value: str = "value") -> DataFrame:
    """The records that cannot be decoded, unchanged, with the reason."""
    return records.withColumn("problem", fixed_width_problem(value)).filter(F.col("problem").isNotNull())
