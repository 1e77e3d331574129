"""Gridded files: bytes made by hand, files that this library wrote, and weather at places."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from gustline.sources import grids

HOUR = datetime.timedelta(hours=1)
START = datetime.datetime(2024, 1, 1)


def name(text):
    return struct.pack(">i", len(text)) + text.encode().ljust(len(text) + -len(text) % 4, b"\0")


def wide_name(text):
    return struct.pack(">q", len(text)) + text.encode().ljust(len(text) + -len(text) % 4, b"\0")


def by_hand():
    """Version 1, no records: expver (1, 5) x time (2) x lat (1) x lon (2) as floats, with the version first; times in days from 2024-01-01 00:30."""
    units = "days since 2024-01-01 00:30:00"
    attribute = struct.pack(">ii", 12, 1) + name("units") + struct.pack(">ii", 2, len(units)) + units.encode().ljust(len(units) + -len(units) % 4, b"\0")
    fill = struct.pack(">ii", 12, 1) + name("_FillValue") + struct.pack(">iif", 5, 1, -9.0)
    none = struct.pack(">ii", 0, 0)
    u = [10.0, 11.0, -9.0, -9.0, 90.0, 91.0, 20.0, -9.0]
    variables = [("time", [1], attribute, 6, struct.pack(">dd", 0.0, 0.5)), ("lat", [2], none, 5, struct.pack(">f", -5.0)), ("lon", [3], none, 5, struct.pack(">ff", -36.0, -35.75)), ("expver", [0], none, 4, struct.pack(">ii", 5, 1)), ("u100", [0, 1, 2, 3], fill, 5, struct.pack(">8f", *u[4:], *u[:4]))]

    def head(begins):
        out = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 4) + b"".join(name(n) + struct.pack(">i", k) for n, k in (("expver", 2), ("time", 2), ("lat", 1), ("lon", 2))) + none + struct.pack(">ii", 11, len(variables))
        for (n, dims, attributes, kind, data), begin in zip(variables, begins):
            out += name(n) + struct.pack(f">{len(dims) + 1}i", len(dims), *dims) + attributes + struct.pack(">iii", kind, len(data), begin)
        return out

    begins, at = [], len(head([0] * len(variables)))
    for *_, data in variables:
        begins.append(at)
        at += len(data)
    return head(begins) + b"".join(v[-1] for v in variables)


def wide():
    """Version 5 with an open number of records: three times as 64-bit seconds, a lone pressure of two bytes a record at one cell."""
    units = "seconds since 1970-01-01"
    attribute = struct.pack(">iq", 12, 1) + wide_name("units") + struct.pack(">iq", 2, len(units)) + units.encode()
    none = struct.pack(">iq", 0, 0)
    variables = [("time", [0], attribute, 10), ("latitude", [1], none, 6), ("longitude", [1], none, 6), ("sp", [0, 1, 1], none, 3)]
    fixed = struct.pack(">dd", -5.0, 324.0)

    def head(begins):
        out = b"CDF\x05" + b"\xff" * 8 + struct.pack(">iq", 10, 2) + wide_name("time") + struct.pack(">q", 0) + wide_name("place") + struct.pack(">q", 1) + none + struct.pack(">iq", 11, 4)
        for (n, dims, attributes, kind), begin in zip(variables, begins):
            out += wide_name(n) + struct.pack(f">{len(dims) + 1}q", len(dims), *dims) + attributes + struct.pack(">iqq", kind, 8, begin)
        return out

    at = len(head([0] * 4))
    return head([at + 16, at, at + 8, at + 24]) + fixed + b"".join(struct.pack(">qhh", 3600 * k, 100 + k, 0) for k in range(3))


def test_bytes_made_by_hand(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(by_hand())
    rows = grids.read_grids(spark, f"file://{tmp_path}", {"u": ["missing", "u100"]}).orderBy("t", "longitude").collect()
    half = START + HOUR / 2
    assert [(r["t"], r["latitude"], r["longitude"], r["u"], r["version"]) for r in rows] == [
        (half, -5.0, -36.0, 10.0, 1), (half, -5.0, -35.75, 11.0, 1), (half + 12 * HOUR, -5.0, -36.0, 20.0, 5), (half + 12 * HOUR, -5.0, -35.75, None, None),
    ]
    axes = {(r["axis"], r["point"]) for r in grids.read_axes(spark, str(tmp_path)).collect()}
    assert axes == {("latitude", -5.0), ("longitude", -36.0), ("longitude", -35.75)}


def test_wide_offsets_and_an_open_number_of_records(spark, tmp_path):
    path = tmp_path / "wide.nc"
    path.write_bytes(wide())
    rows = grids.header(open(path, "rb"))
    assert rows["time"].shape == [3] and rows["sp"].stride == 12
    with open(path, "rb") as stream:
        found = grids.header(stream)
        assert grids.values(stream, found["sp"], "time", 1, 3).reshape(-1).tolist() == [101, 102]
        assert grids.instants(found["time"], grids.values(stream, found["time"])).tolist() == [0, 3_600_000_000, 7_200_000_000]


def cells(spark, hours=50):
    rows = [(START + t * HOUR, v, -5.0 - 0.25 * a, 324.0 + 0.25 * o, float(t * 10 + a + o / 2) if v == 5 or t < 30 else None, 280.5) for t in range(hours) for v in (1, 5) for a in range(2) for o in range(3) if (t + a + o) % 4]
    return spark.createDataFrame(rows, "t timestamp_ntz, version int, latitude double, longitude double, u100 double, t2m double")


@pytest.mark.parametrize("most", [1, 1 << 18])
def test_round_trip_in_ranges_of_any_size(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(grids, "RANGE_CELLS", most)
    rows = cells(spark).withColumn("month", F.when(F.col("t") < "2024-01-02", "a").otherwise("b"))
    done = grids.write_grids(rows, f"file://{tmp_path}/out", "month", ["u100", "t2m"], {"t2m": (0.5, 1000.0)}).collect()
    assert sorted(r["times"] for r in done) == [24, 26] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.nc", "b.nc"]
    got = grids.read_grids(spark, f"{tmp_path}/out", {"u": ["u100"], "k": ["t2m"]}).collect()
    assert len(got) == 50 * 6
    want = {(r["t"], r["latitude"], r["longitude"]): (r["u100"], r["t2m"]) for r in rows.where("version = 5").collect()}
    assert {(r["t"], r["latitude"], r["longitude"]): (r["u"], r["k"]) for r in got if r["u"] is not None} == want
    assert {r["version"] for r in got if r["u"] is not None and r["t"] < START + 30 * HOUR} == {1} and {r["version"] for r in got if r["t"] >= START + 30 * HOUR} == {5, None}


def test_faults_end_the_job(spark, tmp_path):
    for k, content in enumerate((b"\x89HDF\r\n", b"CDF\x01\0\0", by_hand()[:-4])):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / "x.nc").write_bytes(content)
        with pytest.raises(Exception, match="HDF5|ends within|not a classic"):
            grids.read_grids(spark, str(folder), {"u": ["u100"]}).collect()
    (tmp_path / "good.nc").write_bytes(by_hand())
    with pytest.raises(Exception, match="none of"):
        grids.read_grids(spark, str(tmp_path / "good.nc"), {"u": ["u10"]}).collect()
    with pytest.raises(ValueError):
        grids.read_grids(spark, str(tmp_path), {"t": ["u100"]})
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.nc").touch()
    assert grids.read_grids(spark, str(tmp_path / "empty"), {"u": ["u100"]}).collect() == []


def test_weather_at_members_of_a_group(spark, tmp_path):
    grid = spark.createDataFrame([(1, START, -5.0, 324.0, 4.0), (1, START, -5.0, 324.25, 8.0), (5, START + HOUR, -5.0, 324.0, 6.0), (None, START + HOUR, -5.0, 324.25, None)], "version int, t timestamp_ntz, latitude double, longitude double, u double")
    axes = spark.createDataFrame([("latitude", -5.0), ("longitude", 324.0), ("longitude", 324.25)], "axis string, point double")
    later = START + 24 * HOUR
    places = [("g", "a", -5.02, -36.02, 25.0, None, None), ("g", "b", -5.0, -35.75, 75.0, None, None), ("g", "b", -5.0, -35.75, 75.0, None, None), ("late", "c", -5.0, -36.0, None, later, None), ("day", "d", -5.0, -36.0, 0.0, None, START), (None, "e", -5.0, -36.0, 1.0, None, None), ("no", "f", None, -36.0, 1.0, None, None)]
    table = spark.createDataFrame(places, "plant string, place string, latitude double, longitude double, capacity double, start timestamp_ntz, end timestamp_ntz")
    got = {(r["plant"], r["t"]): r for r in grids.weather_at(grid, axes, table, ["u"], 0.25).collect()}
    assert {k[0] for k in got} == {"g", "day"}
    assert got["g", START]["u"] == pytest.approx(7.0) and got["g", START]["places"] == 2 and got["g", START]["grid_longitude"] == pytest.approx(-35.8125)
    assert got["g", START + HOUR]["u"] == pytest.approx(6.0) and got["g", START + HOUR]["version"] == 5
    assert got["day", START]["u"] == 4.0 and got["day", START]["km"] == 0.0
