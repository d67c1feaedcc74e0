"""Framed binary messages: one 8192-byte frame holds a header and many records."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frame and header length in bytes.
FRAME_BYTES = 8192
HEADER_BYTES = 16


@dataclass(frozen=True)
class Layout:
    """The record of a kind of frame: numpy field types (big-endian) and the Spark schema."""

    magic: int
    fields: tuple[tuple[str, str], ...]
    schema: str

    @property
    def record(self) -> np.dtype:
        return np.dtype(list(self.fields))

    @property
    def capacity(self) -> int:
        return (FRAME_BYTES - HEADER_BYTES) // self.record.itemsize


# Magic numbers and record layouts of the three kinds of frames.
_CAMPAIGN_FIELDS = (
    "user_id", "page_id", "campaign_id", "ad_type", "event_type", "current_ms", "ip", "d1", "d2", "d3", "d4",
)
CAMPAIGN = Layout(
    0xDEEDF000,
    tuple((name, ">i8") for name in _CAMPAIGN_FIELDS),
    ", ".join(f"{name} BIGINT" for name in _CAMPAIGN_FIELDS),
)
AUCTION = Layout(
    0x30061992,
    (
        ("auction_id", ">i8"), ("person_id", ">i8"), ("flag", ">i1"), ("item_id", ">i4"), ("start", ">i8"),
        ("end", ">i8"), ("price", ">i4"), ("name", "S20"), ("description", "S200"), ("ts", ">i8"),
    ),
    "auction_id BIGINT, person_id BIGINT, flag TINYINT, item_id INT, start BIGINT, end BIGINT, price INT, "
    "name STRING, description STRING, ts BIGINT",
)
BID = Layout(
    0xDEEDBEAF,
    (("bidder_id", ">i8"), ("auction_id", ">i8"), ("price", ">f8"), ("ts", ">i8")),
    "bidder_id BIGINT, auction_id BIGINT, price DOUBLE, ts BIGINT",
)


def frame_problem(layout: Layout, value: str = "value") -> Column:
    """Why a frame cannot be decoded, or null when it can."""
    magic = F.hex(F.substring(value, 1, 4))
    items = F.conv(F.hex(F.substring(value, 5, 4)), 16, 10).cast("long")
    return (
        F.when(F.col(value).isNull(), "no value")
        .when(F.octet_length(value) != FRAME_BYTES, "wrong length")
        .when(magic != f"{layout.magic:08X}", "wrong magic")
        .when(items > layout.capacity, "count over capacity")
    )


def decode_frames(frames: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """The records of all good frames. Works on tables and on streams."""
    record, texts = layout.record, [n for n, t in layout.fields if t.startswith("S")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for frame in map(bytes, batch[value]):
                items = int.from_bytes(frame[4:8], "big")
                parts.append(np.frombuffer(frame, record, items, HEADER_BYTES))
            rows = np.concatenate(parts) if parts else np.empty(0, record)
            out = {n: rows[n].astype(rows[n].dtype.newbyteorder("=")) for n in record.names if n not in texts}
            for n in texts:
                out[n] = [t.rstrip(b"\0 ").decode("utf-8", "replace") for t in rows[n]]
            yield pd.DataFrame(out, columns=list(record.names))

    return frames.filter(frame_problem(layout, value).isNull()).select(value).mapInPandas(decode, layout.schema)


def encode_frames(rows: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """Rows packed into frames for a topic sink, column ``value``. Works on tables and on streams.

    Every task fills frames of its own, so only its last frame may be short. Nulls are written as zero or as empty text, as
    a record has no place for them; a text longer than its field is cut after its last whole character.
    """
    record, size = layout.record, layout.capacity * layout.record.itemsize
    texts = {n: record[n].itemsize for n, t in layout.fields if t.startswith("S")}

    def packed(batch: pd.DataFrame) -> bytes:
        out = np.zeros(len(batch), record)
        for name in record.names:
            if name in texts:
                cut = (t.encode()[: texts[name]].decode("utf-8", "ignore") for t in batch[name].fillna(""))
                out[name] = [t.encode() for t in cut]
            else:
                out[name] = batch[name]
        return out.tobytes()

    def frame(body: bytes) -> bytes:
        head = layout.magic.to_bytes(4, "big") + (len(body) // record.itemsize).to_bytes(4, "big")
        return (head.ljust(HEADER_BYTES, b"\0") + body).ljust(FRAME_BYTES, b"\0")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = b""
        for batch in batches:
            held += packed(batch)
            full = len(held) // size * size
            yield pd.DataFrame({value: [frame(held[i : i + size]) for i in range(0, full, size)]})
            held = held[full:]
        if len(held):
            yield pd.DataFrame({value: [frame(held)]})

    # whole numbers with nulls would reach pandas as doubles and lose digits
    fields = [c.split() for c in layout.schema.split(", ")]
    filled = [
        F.col(n) if t == "STRING" else F.coalesce(F.col(n).cast(t), F.lit(0).cast(t)).alias(n) for n, t in fields
    ]
    return rows.select(*filled).mapInPandas(encode, f"{value} BINARY")


def rejected_frames(frames: DataFrame, layout: Layout, value: str = "value") -> DataFrame:
    """The frames that cannot be decoded, unchanged, with the reason."""
    return frames.withColumn("problem", frame_problem(layout, value)).filter(F.col("problem").isNotNull())
