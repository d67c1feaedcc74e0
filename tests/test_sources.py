import struct
import uuid

import pytest
from conftest import seconds

from millrace.sources import frames, text, topics
from millrace.sources.binary import RECORD_BYTES, decode_fixed_width, read_fixed_width
from millrace.sources.sinks import append_result, drop_result
from millrace.streaming.runner import run_to_table


def record(i, type_first=False):
    halves = [struct.pack("<QQ", i << 8, (i + n) * 7) for n in range(3)]
    ad, event = b"banner78\0", b"view\0\0\0\0 "
    texts = event + ad if type_first else ad + event
    return b"".join(halves) + texts + struct.pack("<qI", 1_700_000_000_000 + i, 2**32 - 1 - i)


@pytest.mark.parametrize("type_first", [False, True])
def test_fixed_width_files(spark, tmp_path, type_first):
    for part in range(2):
        (tmp_path / f"{part}.bin").write_bytes(b"".join(record(part * 50 + i, type_first) for i in range(50)))
    assert len(record(0)) == RECORD_BYTES
    got = sorted(read_fixed_width(spark, str(tmp_path), type_first).collect(), key=lambda r: r.current_ms)
    assert len(got) == 100
    assert got[3].user_id == str(uuid.UUID(int=((3 << 8) << 64) | 21))
    assert (got[3].ad_type, got[3].event_type, got[3].ip) == ("banner78", "view", 2**32 - 4)


def test_fixed_width_of_no_rows(spark):
    assert decode_fixed_width(spark.createDataFrame([], "value BINARY")).count() == 0


def frame(magic, items, body):
    return (struct.pack(">IIq", magic, items, 0) + body).ljust(frames.FRAME_BYTES, b"\0")


def table(spark, values):
    return spark.createDataFrame([(bytearray(v),) for v in values], "value BINARY")


def test_frame_capacities():
    assert [layout.capacity for layout in (frames.CAMPAIGN, frames.AUCTION, frames.BID)] == [92, 30, 255]


def test_campaign_frames_and_rejects(spark):
    rows = [tuple(range(i, i + 11)) for i in range(5)]
    body = b"".join(struct.pack(">11q", *r) for r in rows)
    good, none = frame(0xDEEDF000, 5, body), frame(0xDEEDF000, 0, b"")
    bad = [frame(0xDEEDBEAF, 5, body), frame(0xDEEDF000, 93, body), good[:100], b""]
    df = table(spark, [good, none, *bad])
    assert sorted(map(tuple, frames.decode_frames(df, frames.CAMPAIGN).collect())) == rows
    problems = sorted(r.problem for r in frames.rejected_frames(df, frames.CAMPAIGN).collect())
    assert problems == ["count over capacity", "wrong length", "wrong length", "wrong magic"]


def test_auction_and_bid_frames(spark):
    auction = struct.pack(">qqbiqqi20s200sq", 1, -2, -3, 4, 5, 6, 7, b"chair", b"old chair".ljust(200), 8)
    got = frames.decode_frames(table(spark, [frame(0x30061992, 1, auction)]), frames.AUCTION).collect()
    assert [tuple(r) for r in got] == [(1, -2, -3, 4, 5, 6, 7, "chair", "old chair", 8)]
    bids = b"".join(struct.pack(">qqdq", i, 10 + i, 0.5 * i, 99) for i in range(255))
    got = frames.decode_frames(table(spark, [frame(0xDEEDBEAF, 255, bids)]), frames.BID).collect()
    assert len(got) == 255 and tuple(got[254]) == (254, 264, 127.0, 99)


def test_frames_decode_in_a_stream(spark, tmp_path):
    body = struct.pack(">qqdq", 1, 2, 3.0, 4)
    table(spark, [frame(0xDEEDBEAF, 1, body)] * 3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("value BINARY").parquet(str(tmp_path / "in"))
    out = run_to_table(frames.decode_frames(stream, frames.BID), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [tuple(r) for r in out.collect()] == [(1, 2, 3.0, 4)] * 3


def test_delimited_and_normalised(spark, tmp_path):
    (tmp_path / "grid.txt").write_text("100 1.5 0 1 2 3\n107 2.5 1 1 2 4\n")
    rows = text.read_delimited(spark, str(tmp_path), text.GRID)
    assert [tuple(r) for r in text.normalise_time(rows).collect()] == [(0, 1.5, 0, 1, 2, 3), (7, 2.5, 1, 1, 2, 4)]
    assert [r.ts for r in text.normalise_time(rows, origin=90).collect()] == [10, 17]
    stream = text.read_delimited(spark, str(tmp_path), text.GRID, streaming=True)
    with pytest.raises(ValueError):
        text.normalise_time(stream)


def test_equipment_seconds(spark, tmp_path):
    lines = ["2012-02-22T16:46:28.967084", "2012-02-22T16:46:30.000000"]
    (tmp_path / "e.txt").write_text("\n".join(t + "\t" + "\t".join(map(str, range(13))) for t in lines))
    got = text.read_equipment(spark, str(tmp_path), "2012-02-22T16:46:00").collect()
    assert [(r.ts, r.message_index, r.bm06) for r in got] == [(28, 0, 12), (30, 0, 12)]


def test_road_input_keeps_position_reports(spark, tmp_path):
    (tmp_path / "r.csv").write_text("0,10,1,50,2,1,0,7,37000,-1,-1,-1,-1,-1,-1\n2,11,1,0,0,0,0,0,0,5,0,0,0,0,0\n")
    assert [tuple(r) for r in text.read_road_reports(spark, str(tmp_path)).collect()] == [(10, 1, 50, 2, 7, 37000)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (1, 2):
        append_result(spark.range(n), path)
    assert seconds(spark.read.schema("id LONG").csv(path)) == [(0,), (0,), (1,)]
    drop_result(spark.range(3))


def test_fixed_width_length_checks_and_files(spark, tmp_path):
    from millrace.sources.binary import decode_fixed_width, read_fixed_width, rejected_fixed_width

    good = bytes(range(48)) + b"mail\0\0\0\0\0" + b"view     " + (-5).to_bytes(8, "little", signed=True) + b"\xff" * 4
    rows = [(good,), (good[:77],), (good + b"x",), (None,)]
    records = spark.createDataFrame(rows, "value binary")
    (row,) = decode_fixed_width(records).collect()
    assert row.user_id == "07060504-0302-0100-0f0e-0d0c0b0a0908"
    assert (row.ad_type, row.event_type, row.current_ms, row.ip) == ("mail", "view", -5, 2**32 - 1)
    assert decode_fixed_width(records, type_first=True).first().ad_type == "view"
    found = sorted(r.problem for r in rejected_fixed_width(records).collect())
    assert found == ["no value", "wrong length", "wrong length"]
    (tmp_path / "records").write_bytes(good * 3)
    assert read_fixed_width(spark, str(tmp_path / "records")).collect() == [row] * 3


def test_null_frames_are_rejected(spark):
    from millrace.sources import frames

    table = spark.createDataFrame([(None,), (b"x",)], "value binary")
    assert frames.decode_frames(table, frames.CAMPAIGN).count() == 0
    assert {r.problem for r in frames.rejected_frames(table, frames.CAMPAIGN).collect()} == {"no value", "wrong length"}


def test_streams_read_partitioned_folders(spark, tmp_path):
    from millrace.streaming.runner import run_to_table, stream_table

    spark.range(10).selectExpr("id", "id % 2 AS day").write.partitionBy("day").parquet(str(tmp_path / "in"))
    for k, path in enumerate((f"{tmp_path}/in", f"{tmp_path}/in/")):
        read = run_to_table(stream_table(spark, path), f"{tmp_path}/out{k}", f"{tmp_path}/check{k}")
        assert sorted((r.id, r.day) for r in read.collect()) == [(i, i % 2) for i in range(10)]


def test_encoded_frames_decode_to_the_same_rows(spark):
    rows = spark.range(0, 700, 1, 3).selectExpr(
        "id + (1L << 60) AS bidder_id", "IF(id % 7 = 0, NULL, -id) AS auction_id", "id / 3 AS price", "id AS ts"
    )
    packed = frames.encode_frames(rows, frames.BID)
    assert packed.count() == 3  # 255 records fit, a task has 233 or 234
    back = frames.decode_frames(packed, frames.BID)
    assert seconds(back) == seconds(rows.fillna(0))
    assert frames.decode_frames(frames.encode_frames(rows.coalesce(1), frames.BID), frames.BID).count() == 700
    assert frames.encode_frames(rows.filter("id < 0"), frames.BID).count() == 0
    sent = topics.messages(rows, frames.BID)
    assert sent.columns == ["value"] and frames.decode_frames(sent, frames.BID).count() == 700
    assert topics.messages(rows).dtypes == [("value", "string")]


def test_encoded_texts_keep_whole_characters(spark):
    row = (1, 2, 1, 3, 4, 5, 6, "a" + "\u00e9" * 10, None, 7)
    (back,) = frames.decode_frames(
        frames.encode_frames(spark.createDataFrame([row], frames.AUCTION.schema), frames.AUCTION), frames.AUCTION
    ).collect()
    assert (back.name, back.description) == ("a" + "\u00e9" * 9, "")


def test_files_of_units_are_read_by_several_tasks(spark, tmp_path):
    """Splits lie at whole units; the rest of a file is a unit of its own that decoders reject; hidden files are left out."""
    from millrace.sources.binary import rejected_fixed_width
    from millrace.sources.units import read_units

    whole = b"".join(record(i) for i in range(1000))
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(whole)
    (tmp_path / "sub" / "b.bin").write_bytes(whole[: 78 * 10 + 40])
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(whole)
    units = read_units(spark, str(tmp_path), RECORD_BYTES, split_bytes=100 * 78 + 5)
    assert units.rdd.getNumPartitions() == 11
    rows = units.collect()
    assert sorted((r.path.rpartition("/")[2], r.offset, bytes(r.value)) for r in rows) == sorted(
        [("a.bin", 78 * i, record(i)) for i in range(1000)] + [("b.bin", 78 * i, record(i)) for i in range(10)]
        + [("b.bin", 780, whole[780:820])]
    )
    (rejected,) = rejected_fixed_width(units).collect()
    assert (rejected.problem, rejected.offset) == ("wrong length", 780)
    assert read_fixed_width(spark, str(tmp_path)).count() == 1010
    assert read_fixed_width(spark, str(tmp_path / "a.bin")).count() == 1000


def test_a_stream_of_files_repeats_nothing(spark, tmp_path):
    """Files grow and are added between runs; a unit that is not whole yet waits for the next run."""
    from millrace.sources.units import stream_units

    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "checkpoint"))
    (tmp_path / "inbox").mkdir()
    first, second = tmp_path / "inbox" / "a.bin", tmp_path / "inbox" / "b.bin"
    seen = []
    for step in range(3):
        with open(first, "ab") as file:  # two records and a half each time
            file.write(b"".join(record(i) for i in range(8))[step * 195 : (step + 1) * 195])
        if step == 1:
            second.write_bytes(record(100))
        units = stream_units(spark, inbox, RECORD_BYTES, split_bytes=RECORD_BYTES)
        rows = run_to_table(units, out, checkpoint).collect()
        seen.append(sorted(bytes(r.value) for r in rows))
    assert seen[0] == sorted(record(i) for i in range(2))
    assert seen[1] == sorted([record(i) for i in range(5)] + [record(100)])
    assert seen[2] == sorted([record(i) for i in range(7)] + [record(100)])


def test_writing_units_leaves_no_parts(spark, tmp_path):
    from millrace.sources.units import read_units, write_units

    rows = spark.range(50).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(lpad(string(id), 6, '0') AS BINARY) END AS value")
    assert write_units(rows.repartition(4), str(tmp_path / "u")) == 45
    assert all(n.name.endswith(".bin") for n in (tmp_path / "u").iterdir())
    assert sorted(bytes(r.value).decode() for r in read_units(spark, str(tmp_path / "u"), 6).collect()) == [f"{i:06d}" for i in range(50) if i % 10]
