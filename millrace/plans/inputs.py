"""Sources and decoders, fed with text lines and binary messages that Spark writes from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import frames, text
from ..sources.binary import RECORD_BYTES, decode_fixed_width, read_fixed_width, rejected_fixed_width
from ..sources.sinks import append_result
from ..sources.units import stream_units, write_units
from ..streaming.runner import run_to_table
from .registry import ORACLES, query
from .views import EVENTS, View, table


def _lines(spark: SparkSession, df: DataFrame, sep: str) -> str:
    """Write the columns as text lines; returns the path."""
    path = shared_path(spark, "lines")
    df.select(F.concat_ws(sep, *(F.col(c).cast("string") for c in df.columns))).write.text(path)
    return path


_CLUSTER_TEXT = View(
    "events",
    {
        "ts": "CAST(floor(event_id / 10) AS BIGINT)",
        "job_id": "user_id",
        "task_id": "event_id",
        "machine_id": "event_id % 11",
        "event_type": "CAST(event_id % 5 AS INT)",
        "user_id": "CAST(user_id AS INT)",
        "category": "CAST(user_id % 7 AS INT)",
        "priority": "CAST(event_id % 4 AS INT)",
        "cpu": "CAST(value AS DECIMAL(18,2))",
        "ram": "CAST(value * 2 AS DECIMAL(18,2))",
        "disk": "CAST(value * 3 AS DECIMAL(18,2))",
        "constraints": "CAST(event_id % 2 AS INT)",
    },
)


@query(
    "src_delimited",
    "SELECT ts, job_id, task_id, machine_id, event_type, user_id, category, priority, cpu::FLOAT::DOUBLE AS cpu, "
    f"ram::FLOAT::DOUBLE AS ram, disk::FLOAT::DOUBLE AS disk, constraints FROM {_CLUSTER_TEXT.sql}",
)
def src_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _lines(spark, _CLUSTER_TEXT.frame(spark, sf_dir), " ")
    rows = text.read_delimited(spark, path, text.CLUSTER)
    return rows.withColumns({c: F.col(c).cast("double") for c in ("cpu", "ram", "disk")})


_GRID_TEXT = View(
    "events",
    {
        "ts": "event_id * 3 + 1377986401",
        "value": "CAST(value AS DECIMAL(18,2))",
        "property": "CAST(event_id % 2 AS INT)",
        "plug": "CAST(event_id % 4 AS INT)",
        "household": "CAST(event_id % 5 AS INT)",
        "house": "CAST(user_id % 10 AS INT)",
    },
)


@query(
    "src_normalise_ts",
    f"WITH g AS {_GRID_TEXT.sql} SELECT ts - (SELECT min(ts) FROM g) AS ts, value::FLOAT::DOUBLE AS value, property, "
    "plug, household, house FROM g",
)
def src_normalise_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.read_delimited(spark, _lines(spark, _GRID_TEXT.frame(spark, sf_dir), " "), text.GRID)
    return text.normalise_time(rows).withColumn("value", F.col("value").cast("double"))


@query(
    "src_iso_seconds",
    "SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS ts, event_id AS message_index, "
    "(user_id % 50)::INT AS mf01, (user_id % 51)::INT AS mf02, (user_id % 52)::INT AS mf03, (event_id % 2)::INT AS bm05 "
    "FROM events",
)
def src_iso_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    zeros = [f"0 AS {c}" for c in ("pc13", "pc14", "pc15", "pc25", "pc26", "pc27", "res")]
    lines = events.selectExpr(
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") AS iso_time",
        "event_id AS message_index",
        *(f"user_id % {50 + i} AS mf0{i + 1}" for i in range(3)),
        *zeros,
        "event_id % 2 AS bm05",
        "1 AS bm06",
    )
    rows = text.read_equipment(spark, _lines(spark, lines, "\t"), "2024-01-01T00:00:00")
    return rows.select("ts", "message_index", "mf01", "mf02", "mf03", "bm05")


_ROAD_TEXT = View(
    "events",
    {
        "type": "CAST(CASE event_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 0 ELSE 0 END AS INT)",
        "time": "CAST(event_id % 10800 AS INT)",
        "vid": "CAST(user_id AS INT)",
        "speed": "CAST(event_id % 101 AS INT)",
        "xway": "CAST(user_id % 3 AS INT)",
        "seg": "CAST(event_id % 100 AS INT)",
        "pos": "CAST(event_id % 528000 AS INT)",
    },
)


@query("src_road_reports", f"SELECT time, vid, speed, xway, seg, pos FROM {_ROAD_TEXT.sql} WHERE type = 0")
def src_road_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ROAD_TEXT.frame(spark, sf_dir).selectExpr(
        "type", "time", "vid", "speed", "xway", "1 AS lane", "0 AS dir", "seg", "pos", *(f"-1 AS x{i}" for i in range(6))
    )
    return text.read_road_reports(spark, _lines(spark, rows, ","))


# binary records


def _little_endian(hexes: str, size: int) -> str:
    """Hex text of a number turned from the first byte last to the first byte first."""
    return "concat(" + ", ".join(f"substr({hexes}, {2 * i + 1}, 2)" for i in reversed(range(size))) + ")"


def _id_hex(text_expr: str) -> str:
    digest = f"md5({text_expr})"
    return f"concat({_little_endian(digest, 8)}, {_little_endian(f'substr({digest}, 17)', 8)})"


def _text_hex(expr: str) -> str:
    return f"rpad(hex({expr}), 18, '0')"


_FIELDS = {
    "user_id": "concat('u', CAST(user_id AS STRING))",
    "page_id": "concat('p', CAST(event_id % 100 AS STRING))",
    "campaign_id": "concat('c', CAST(event_id % 50 AS STRING))",
}


def _uuid_sql(expr: str) -> str:
    digest = f"md5({expr.replace('STRING', 'VARCHAR')})"
    parts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({digest}, {start}, {length})" for start, length in parts)


@query(
    "src_fixed_width",
    "SELECT "
    + ", ".join(f"{_uuid_sql(expr)} AS {name}" for name, expr in _FIELDS.items())
    + ", 'banner' || (event_id % 3)::VARCHAR AS ad_type, event_type, epoch_us(ts) // 1000 AS current_ms, event_id % 4294967296 AS "
    "ip FROM events",
)
def src_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_fixed_width(fixed_records(EVENTS.frame(spark, sf_dir)).select("value"))


@query("src_fixed_width_file", ORACLES["src_fixed_width"])
def src_fixed_width_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records from files that several tasks read."""
    path = shared_path(spark, "records")
    write_units(fixed_records(EVENTS.frame(spark, sf_dir)).repartition(3), path)
    return read_fixed_width(spark, path, split_bytes=RECORD_BYTES * 1000)


@query(
    "src_fixed_width_rejects",
    "SELECT event_id, CASE event_id % 10 WHEN 3 THEN 'no value' ELSE 'wrong length' END AS problem FROM events "
    "WHERE event_id % 10 IN (3, 4, 5)",
)
def src_fixed_width_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some are missing, a byte too short or a byte too long."""
    records = fixed_records(EVENTS.frame(spark, sf_dir)).withColumn(
        "value",
        F.expr("CASE event_id % 10 WHEN 3 THEN NULL WHEN 4 THEN substring(value, 1, 77) WHEN 5 THEN concat(value, X'00') "
               "ELSE value END"),
    )
    return rejected_fixed_width(records).select("event_id", "problem")


def fixed_records(events: DataFrame) -> DataFrame:
    """Events as 78-byte records beside their ids."""
    parts = [_id_hex(expr) for expr in _FIELDS.values()]
    parts += [_text_hex("concat('banner', CAST(event_id % 3 AS STRING))"), _text_hex("event_type")]
    parts += [_little_endian("lpad(hex(unix_millis(ts)), 16, '0')", 8), _little_endian("lpad(hex(event_id), 8, '0')", 4)]
    return events.selectExpr("event_id", f"unhex(concat({', '.join(parts)})) AS value")


_FRAME_FIELDS = {
    "user_id": "user_id",
    "page_id": "event_id % 100",
    "campaign_id": "event_id % 50",
    "ad_type": "event_id % 5",
    "event_type": "event_id % 3",
    "current_ms": "unix_millis(ts)",
    "ip": "event_id",
    "d1": "0",
    "d2": "-1",
    "d3": "1",
    "d4": "2",
}
ITEMS_PER_FRAME = 92


def campaign_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of up to 92 consecutive events; some are made bad, by the number of the frame."""
    record = "concat(" + ", ".join(f"lpad(hex(CAST({e} AS BIGINT)), 16, '0')" for e in _FRAME_FIELDS.values()) + ")"
    numbered = EVENTS.frame(spark, sf_dir).selectExpr(
        f"CAST(floor(event_id / {ITEMS_PER_FRAME}) AS BIGINT) AS frame", "event_id", f"{record} AS body"
    )
    packed = numbered.groupBy("frame").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "body"))).alias("items")
    )
    return packed.selectExpr(
        "frame",
        "unhex(concat(CASE WHEN frame % 10 = 3 THEN 'deedf001' ELSE 'deedf000' END, "
        "lpad(hex(CASE WHEN frame % 10 = 4 THEN 93 ELSE size(items) END), 8, '0'), repeat('0', 16), "
        "rpad(array_join(transform(items, i -> i.body), ''), "
        f"CASE WHEN frame % 10 = 5 THEN 0 ELSE {2 * (frames.FRAME_BYTES - frames.HEADER_BYTES)} END, '0'))) AS value",
    )


@query(
    "src_frames",
    "SELECT "
    + ", ".join(
        f"CAST({e.replace('unix_millis(ts)', 'epoch_us(ts) // 1000')} AS BIGINT) AS {name}" for name, e in _FRAME_FIELDS.items()
    )
    + f" FROM events WHERE event_id // {ITEMS_PER_FRAME} % 10 NOT IN (3, 4, 5)",
)
def src_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.decode_frames(campaign_frames(spark, sf_dir), frames.CAMPAIGN)


@query("stream_frame_files", ORACLES["src_frames"])
def stream_frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from files that come in three deliveries; the stream starts again from its checkpoint after each."""
    sent, inbox = campaign_frames(spark, sf_dir), shared_path(spark, "inbox")
    out, checkpoint = shared_path(spark, "results"), shared_path(spark, "checkpoint")
    for delivery in range(3):
        # a file holds whole frames; those with a wrong magic or count are among them
        whole = sent.filter(F.col("frame") % 3 == delivery).filter(F.octet_length("value") == frames.FRAME_BYTES)
        write_units(whole, inbox)
        stream = stream_units(spark, inbox, frames.FRAME_BYTES, split_bytes=frames.FRAME_BYTES * 10)
        rows = run_to_table(frames.decode_frames(stream.select("value"), frames.CAMPAIGN), out, checkpoint)
    return rows


@query(
    "src_frames_rejects",
    "SELECT DISTINCT event_id // 92 AS frame, CASE event_id // 92 % 10 WHEN 3 THEN 'wrong magic' WHEN 4 THEN "
    "'count over capacity' ELSE 'wrong length' END AS problem FROM events WHERE event_id // 92 % 10 IN (3, 4, 5)",
)
def src_frames_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.rejected_frames(campaign_frames(spark, sf_dir), frames.CAMPAIGN).select("frame", "problem")


_AUCTION_FIELDS = {
    "auction_id": "event_id",
    "person_id": "user_id",
    "flag": "CAST(event_id % 2 AS TINYINT)",
    "item_id": "CAST(event_id % 1000 AS INT)",
    "start": "unix_millis(ts)",
    "end": "unix_millis(ts) + 3600000",
    "price": "CAST(user_id % 500 AS INT)",
    "name": "event_type",
    "description": "concat(event_type, ' by user ', CAST(user_id AS STRING))",
    "ts": "unix_millis(ts)",
}
_BID_FIELDS = {
    "bidder_id": "user_id",
    "auction_id": "event_id % 100",
    "price": "CAST(value AS DOUBLE)",
    "ts": "unix_millis(ts)",
}


def _round_trip(spark: SparkSession, sf_dir: str, fields: dict[str, str], layout: frames.Layout) -> DataFrame:
    """Events as records of a layout, packed into frames, written and decoded again."""
    records = EVENTS.frame(spark, sf_dir).selectExpr(*(f"{e} AS `{n}`" for n, e in fields.items()))
    path = shared_path(spark, "frames")
    frames.encode_frames(records, layout).write.parquet(path)
    return frames.decode_frames(spark.read.schema("value BINARY").parquet(path), layout)


def _fields_sql(fields: dict[str, str]) -> str:
    def duck(expr: str) -> str:
        return expr.replace("unix_millis(ts)", "epoch_us(ts) // 1000").replace("STRING", "VARCHAR")

    return "SELECT " + ", ".join(f'{duck(e)} AS "{n}"' for n, e in fields.items()) + f" FROM {EVENTS.sql}"


@query("src_frames_auction", _fields_sql(_AUCTION_FIELDS))
def src_frames_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, _AUCTION_FIELDS, frames.AUCTION)


@query("src_frames_bid", _fields_sql(_BID_FIELDS))
def src_frames_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, _BID_FIELDS, frames.BID)


_ROAD_ROWS = View(
    "events",
    {
        "ts": "event_id * 2",
        "vehicle": "CAST(user_id AS INT)",
        "speed": "CAST(value AS DECIMAL(18,2))",
        "highway": "CAST(user_id % 3 AS INT)",
        "lane": "CAST(event_id % 4 AS INT)",
        "direction": "CAST(event_id % 2 AS INT)",
        "position": "CAST(event_id % 528000 AS INT)",
    },
)


@query(
    "src_road_text",
    "SELECT ts, vehicle, speed::FLOAT::DOUBLE AS speed, highway, lane, direction, position "
    f"FROM {_ROAD_ROWS.sql}",
)
def src_road_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The space-separated road layout."""
    rows = text.read_delimited(spark, _lines(spark, _ROAD_ROWS.frame(spark, sf_dir), " "), text.ROAD)
    return rows.withColumn("speed", F.col("speed").cast("double"))


@query("sink_append", f"SELECT event_id, user_id, event_type FROM {EVENTS.sql}")
def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results appended to one set of files and read back."""
    path = shared_path(spark, "appended")
    events = EVENTS.frame(spark, sf_dir).select("event_id", "user_id", "event_type")
    append_result(events.filter("event_type = 'view'"), path)
    append_result(events.filter("event_type <> 'view'"), path)
    return text.read_delimited(spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING", sep=",")
