import pytest
from conftest import seconds

from millrace.operators.road import accidents, segment_averages, stopped_vehicles, tolls
from millrace.operators.windows import WindowSpec

SCHEMA = "ts LONG, report_id LONG, vehicle LONG, speed LONG, highway LONG, position LONG, segment LONG"


def drive(vehicle, start, speeds, position=100):
    return [
        (start + 30 * i, vehicle * 1000 + start + i, vehicle, speed, 1, position, position // 100)
        for i, speed in enumerate(speeds)
    ]


TRIPS = (
    drive(1, 0, [50, 0, 0, 0, 0, 0, 60])  # stops with its fifth report, clears with its seventh
    + drive(2, 0, [0, 0, 0, 60, 0])  # three standing reports are not a stop
    + drive(3, 0, [0, 0, 0, 0, 10, 0, 0, 0, 0])  # stops, moves, stops again and stays
    + drive(4, 60, [0, 0, 0, 0, 0, 70])  # stands where vehicle 1 stands
    + drive(5, 0, [0, 0], 100) + drive(5, 60, [0, 0, 0], 200)  # a new place starts the count again
)


@pytest.mark.parametrize("chunk_rows", [100_000, 5])
def test_stops(at, chunk_rows):
    got = seconds(stopped_vehicles(at(TRIPS, SCHEMA), chunk_rows), "vehicle", "first_ts", "stopped_at", "cleared_at")
    assert got == [
        (1, 30.0, 120.0, 180.0),
        (3, 0.0, 90.0, 120.0),
        (3, 150.0, 240.0, None),
        (4, 60.0, 150.0, 210.0),
    ]


def test_accident_ends_when_one_of_two_moves(at):
    rows = drive(1, 0, [50, 0, 0, 0, 0, 0, 60]) + drive(4, 60, [0, 0, 0, 0, 0, 70])
    stops = stopped_vehicles(at(rows, SCHEMA))
    assert seconds(accidents(stops), "highway", "position", "started_at", "ended_at") == [(1, 100, 150.0, 180.0)]


def test_one_vehicle_alone_is_no_accident(at):
    assert accidents(stopped_vehicles(at(drive(1, 0, [0] * 9), SCHEMA))).count() == 0


def test_cumulative_average_and_toll(at):
    rows = drive(7, 0, [60, 80], 300) + drive(7, 300, [40], 300) + drive(8, 600, [10], 300)
    every = WindowSpec.tumbling(300)
    averages = segment_averages(at(rows, SCHEMA), every)
    assert seconds(averages, "window_start", "segment", "reports", "avg_speed") == [
        (0.0, 3, 2, 70.0),
        (300.0, 3, 3, 60.0),
        (600.0, 3, 4, 47.5),
    ]
    got = tolls(at(rows, SCHEMA), every, threshold=50.0)
    assert seconds(got, "window_start", "segment", "toll") == [(0.0, 3, 16.0), (300.0, 3, 36.0)]


def test_no_toll_in_a_segment_with_an_accident(at):
    rows = drive(1, 0, [0] * 6 + [90] * 9) + drive(2, 0, [0] * 6 + [90] * 9) + drive(9, 0, [300] * 4) + drive(9, 600, [90])
    got = tolls(at(rows, SCHEMA), WindowSpec.tumbling(300))
    assert seconds(got, "window_start", "segment", "toll") == [
        (0.0, 1, 0.0),
        (300.0, 1, (2 * 34) ** 2.0),
        (600.0, 1, (2 * 35) ** 2.0),
    ]
