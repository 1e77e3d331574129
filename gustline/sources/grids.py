"""Gridded files in the classic NetCDF format (versions 1, 2 and 5): long rows, a task for each range of times, only the variables that are asked for read."""

from __future__ import annotations

import datetime
import math
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.operators import joins, metrics
from gustline.operators.checks import ContractError, few
from gustline.shared import shared_dir
from gustline.sources import files

#: Names that coordinates go by (fixed values).
COORDINATES = {"version": ("expver",), "t": ("valid_time", "time"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon")}
#: Types of the format by their number (fixed values).
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
#: Versions in the order in which they are preferred (fixed values); others follow.
PREFERRED = (1, 5)
UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
#: Cells that a task decodes at a time; a range has at least one time.
RANGE_CELLS = 1 << 18


@dataclass
class Variable:
    dims: list[str]
    shape: list[int]
    attributes: dict
    dtype: np.dtype
    begin: int
    stride: int  # bytes from one record to the next, 0 where the variable has no records

    @property
    def record_bytes(self) -> int:
        return math.prod(self.shape[1:] if self.stride else self.shape) * self.dtype.itemsize


def header(stream) -> dict[str, Variable]:
    """The variables of a file, by name; only its header is read."""
    magic = stream.read(4)
    if magic[:3] != b"CDF" or magic[3:] not in (b"\x01", b"\x02", b"\x05"):
        raise ContractError("not a classic NetCDF file" + (" but an HDF5 one: convert it first" if magic == b"\x89HDF" else ""))
    version = magic[3]
    size, place = (8 if version == 5 else 4), (4 if version == 1 else 8)

    def exactly(n: int) -> bytes:
        got = stream.read(n)
        if len(got) < n:
            raise ContractError("the file ends within its header")
        return got

    def number(width: int = size) -> int:
        return int.from_bytes(exactly(width), "big")

    def padded(n: int) -> bytes:
        return exactly(n + -n % 4)[:n]

    def name() -> str:
        return padded(number()).decode()

    def items(read: Callable) -> list:
        number(4)  # the list's tag, which is zero for an empty list
        return [read() for _ in range(number())]

    def attribute():
        key, kind, n = name(), TYPES[number(4)], number()
        raw = padded(n * np.dtype(kind).itemsize)
        return key, raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else np.frombuffer(raw, kind)

    records = number()
    dims = items(lambda: (name(), number()))

    def variable():
        key, ids = name(), [number() for _ in range(number())]
        attributes, kind, _, begin = dict(items(attribute)), TYPES[number(4)], number(), number(place)
        return key, ids, attributes, np.dtype(kind), begin

    items(attribute)
    found = items(variable)
    over = [v for v in found if v[1] and dims[v[1][0]][1] == 0]
    flat = {v[0]: math.prod(dims[d][1] for d in v[1][1:]) * v[3].itemsize for v in over}
    stride = sum(flat.values()) if len(flat) == 1 else sum(n + -n % 4 for n in flat.values())  # one variable alone is not padded
    if records == (1 << 8 * size) - 1:  # the writer left the number of records open
        end = stream.seek(0, 2)
        records = max(0, (end - min(v[4] for v in over)) // stride) if over and stride else 0
    return {k: Variable([dims[d][0] for d in ids], [dims[d][1] or records for d in ids], a, t, b, stride if k in flat else 0) for k, ids, a, t, b in found}


def _bytes(stream, at: int, n: int) -> bytes:
    stream.seek(at)
    got = stream.read(n)
    if len(got) < n:
        raise ContractError("the file ends within its data")
    return got


def _fixed(stream, at: int, shape: list[int], dtype: np.dtype, axis: int, first: int, last: int) -> np.ndarray:
    """Places first to last (not included) of an axis, from values that lie in one piece."""
    outer, inner = math.prod(shape[:axis]), math.prod(shape[axis + 1 :])
    n = (last - first) * inner * dtype.itemsize
    raw = b"".join(_bytes(stream, at + (k * shape[axis] + first) * inner * dtype.itemsize, n) for k in range(outer))
    return np.frombuffer(raw, dtype).reshape([*shape[:axis], last - first, *shape[axis + 1 :]])


def values(stream, v: Variable, dim: str | None = None, first: int = 0, last: int = 0) -> np.ndarray:
    """A variable's stored values, all of them or those at places of one dimension; nothing else of the file is read."""
    if dim is None or dim not in v.dims:
        axis, first, last = 0, 0, v.shape[0] if v.shape else 1
    else:
        axis = v.dims.index(dim)
    if not v.stride:
        return _fixed(stream, v.begin, v.shape or [1], v.dtype, axis, first, last).reshape([*v.shape[:axis], last - first, *v.shape[axis + 1 :]] if v.shape else [])
    if not axis:
        parts = [np.frombuffer(_bytes(stream, v.begin + r * v.stride, v.record_bytes), v.dtype).reshape(v.shape[1:]) for r in range(first, last)]
    else:
        parts = [_fixed(stream, v.begin + r * v.stride, v.shape[1:], v.dtype, axis - 1, first, last) for r in range(v.shape[0])]
    return np.stack(parts) if parts else np.empty([0, *v.shape[1:]], v.dtype)


def _number(v: Variable, key: str, default):
    return v.attributes[key][0] if key in v.attributes else default


def decoded(v: Variable, raw: np.ndarray) -> np.ndarray:
    """Doubles: missing values as NaN, then scaled and moved as the attributes say."""
    out = raw.astype("f8")
    for key in ("_FillValue", "missing_value"):
        if key in v.attributes:
            out[np.isin(raw, v.attributes[key])] = np.nan
    return out * float(_number(v, "scale_factor", 1.0)) + float(_number(v, "add_offset", 0.0))


def instants(v: Variable, raw: np.ndarray) -> np.ndarray:
    """Microseconds since 1970 of a time axis (``hours since 1900-01-01``), of the calendar that everybody uses."""
    said = re.fullmatch(r"\s*(second|minute|hour|day)s?\s+since\s+(\S+)(?:[ T]+(\d\S*))?(?:\s+(?:UTC|Z))?\s*", str(v.attributes.get("units", "")), re.IGNORECASE)
    calendar = str(v.attributes.get("calendar", "standard")).lower()
    if not said or calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ContractError(f"unknown times: {v.attributes.get('units')}, {calendar}")
    year, month, day = map(int, said[2].split("-"))
    clock = [float(x) for x in (said[3] or "0").rstrip("Zz").split(":")]
    seconds = sum(x * 60 ** (2 - k) for k, x in enumerate(clock))
    start = (datetime.date(year, month, day) - datetime.date(1970, 1, 1)).days * UNITS["day"] + round(seconds * 1_000_000)
    unit = UNITS[said[1].lower()]
    return start + (raw.astype("i8") * unit if raw.dtype.kind in "iu" else np.rint(raw.astype("f8") * unit).astype("i8"))


def _pick(have: dict[str, Variable], names) -> str:
    for n in names:
        if n in have:
            return n
    raise ContractError(f"none of {list(names)} in {sorted(have)}")


def _axes(have: dict[str, Variable]) -> dict[str, str]:
    """The file's name of each coordinate; that of versions may be absent."""
    return {k: _pick(have, names) for k, names in COORDINATES.items() if k != "version" or any(n in have for n in names)}


def _as_grid(v: Variable, raw: np.ndarray, order: list[str]) -> np.ndarray:
    """The values with dimensions in the given order (of length one where the variable lacks it); other dimensions must have one place."""
    keep = [d for d in v.dims if d in order]
    if any(n != 1 for d, n in zip(v.dims, raw.shape) if d not in order):
        raise ContractError(f"more dimensions than the coordinates: {v.dims}")
    raw = raw.reshape([n for d, n in zip(v.dims, raw.shape) if d in order]).transpose([keep.index(d) for d in order if d in keep])
    return raw.reshape([raw.shape[[d for d in order if d in keep].index(d)] if d in keep else 1 for d in order])


def _preferred(grid: np.ndarray, versions: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Values by version, time and place -> those of the first version that has one, and which that is (0: none)."""
    out, which = np.full(grid.shape[1:], np.nan), np.zeros(grid.shape[1:], "i4")
    for version in [*(x for x in PREFERRED if x in versions), *(x for x in versions if x not in PREFERRED)]:
        mine = grid[versions.index(version)]
        fill = np.isnan(out) & ~np.isnan(mine)
        out[fill], which[fill] = mine[fill], version
    return out, which


def _open(path: str):
    store, inside = files.located(path)
    return store.open_input_file(inside)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _open(path) as stream:
                have = header(stream)
                t = have[_axes(have)["t"]]
                cells = math.prod(have[a].shape[0] if have[a].shape else 1 for k, a in _axes(have).items() if k != "t")
            step, n = max(1, RANGE_CELLS // max(1, cells)), t.shape[0] if t.shape else 1
            starts = list(range(0, n, step))
            yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(starts), "string"), "first": pa.array(starts, "int64"), "last": pa.array([min(n, s + step) for s in starts], "int64")})


def _rows_of(stream, path: str, first: int, last: int, variables: dict[str, list[str]]) -> pa.RecordBatch:
    have = header(stream)
    axes = _axes(have)
    order = [axes[k] for k in ("version", "t", "latitude", "longitude") if k in axes]
    t = instants(have[axes["t"]], values(stream, have[axes["t"]], axes["t"], first, last).reshape(-1))
    lat, lon = (np.asarray(values(stream, have[axes[k]]), "f8").reshape(-1) for k in ("latitude", "longitude"))
    shape, columns, version = (len(t), len(lat), len(lon)), {}, None
    for name, aliases in variables.items():
        v = have[_pick(have, aliases)]
        grid = _as_grid(v, decoded(v, values(stream, v, axes["t"], first, last)), order)
        if "version" in axes and axes["version"] in v.dims:
            names = [int(x) for x in values(stream, have[axes["version"]]).reshape(-1)]
            grid, which = _preferred(grid, names)
            version = which if version is None else version
        columns[name] = np.broadcast_to(grid.reshape(grid.shape[-3:]), shape).reshape(-1)
    place = {"latitude": np.tile(np.repeat(lat, len(lon)), len(t)), "longitude": np.tile(lon, len(t) * len(lat))}
    rows = len(t) * len(lat) * len(lon)
    known = None if version is None else np.broadcast_to(version, shape).reshape(-1)
    return pa.RecordBatch.from_pydict(
        {
            "file": pa.array([path], "string").take(pa.array(np.zeros(rows, "i4"))),
            "version": pa.nulls(rows, "int32") if known is None else pa.array(known, mask=known == 0),
            "t": pa.array(np.repeat(t, len(lat) * len(lon)), pa.timestamp("us")),
            **{k: pa.array(x) for k, x in place.items()},
            **{k: pa.array(np.ascontiguousarray(x), mask=np.isnan(x)) for k, x in columns.items()},
        }
    )


def read_grids(spark: SparkSession, path: str, variables: dict[str, list[str]], pattern: str = "*.nc") -> DataFrame:
    """Long rows (file, version, t, latitude, longitude, a double for each variable): one for each time and cell of each file.

    variables: the names that each one may go by. Where a file holds versions, a cell takes the first that has a value, final before provisional; ``version`` is that of
    the first variable (null: no version has a value, or the file has none). Missing values are null. Longitudes are as they lie in the file.
    A file is listed by Spark, its header read by a task, and each range of its times by another, which reads only the variables named. Files that are damaged, in another format
    or lack a name end the job; files without a byte are passed over, as Spark doesn't list them.
    """
    if clash := sorted({"file", "version", "t", "latitude", "longitude"} & set(variables)):
        raise ContractError(f"names of coordinates: {clash}")
    ranges = files.dealt(files.dealt(files.listed(spark, path, pattern).select("path")).mapInArrow(_ranges, "path string, first long, last long"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _open(r["path"]) as stream:
                    yield _rows_of(stream, r["path"], r["first"], r["last"], variables)

    return ranges.mapInArrow(rows, "file string, version int, t timestamp_ntz, latitude double, longitude double, " + ", ".join(f"`{v}` double" for v in variables))


def read_axes(spark: SparkSession, path: str, pattern: str = "*.nc") -> DataFrame:
    """(axis, point), distinct, of latitudes and longitudes: of all files only headers and coordinates are read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as stream:
                    have = header(stream)
                    for axis in ("latitude", "longitude"):
                        points = np.asarray(values(stream, have[_axes(have)[axis]]), "f8").reshape(-1)
                        yield pa.RecordBatch.from_pydict({"axis": pa.array([axis] * len(points), "string"), "point": pa.array(points)})

    return files.dealt(files.listed(spark, path, pattern).select("path")).mapInArrow(rows, "axis string, point double").distinct()


def weather_at(grid: DataFrame, axes: DataFrame, places: DataFrame, values: list[str], step: float) -> DataFrame:
    """(plant, t, values..., grid_latitude, grid_longitude, km, version, places) from the cell nearest to each place, by plant and time.

    places: plant, place, latitude, longitude (-180 to 180), capacity, start, end (open where null; the end is a whole day). Means are weighted by capacity, or by 1 where that is not a positive finite
    number; a place that has several relations at a time counts once, by the one that began last. step: an upper bound of the distance between neighbours on an axis. Places
    meet cells in a join on both coordinates; they are broadcast where a count shows that there are few.
    """
    shared_dir(grid.sparkSession)
    axes = axes.checkpoint()  # both axes are asked more than once
    east = axes.where("axis = 'longitude'").select("point")
    turned = not east.where("point > 180").isEmpty()
    x = W.longitude_360(F.col("longitude")) if turned else F.col("longitude")
    known = places.where("plant IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("_x", x)
    near = joins.nearest_on_axis(joins.nearest_on_axis(known, "latitude", axes.where("axis = 'latitude'").select("point"), "point", step), "_x", east, "point", step)
    cell_lon = W.longitude_180(F.col("nearest__x"))
    weight = F.when((F.col("capacity") > 0) & (F.col("capacity") < float("inf")), F.col("capacity").cast("double")).otherwise(F.lit(1.0))
    cells = near.select("plant", "place", F.col("nearest_latitude").alias("_lat"), F.col("nearest__x").alias("_lon"), cell_lon.alias("grid_longitude"), W.haversine_km(F.col("latitude"), F.col("longitude"), F.col("nearest_latitude"), cell_lon).alias("km"), weight.alias("_w"), "start", "end").checkpoint()  # counted, then joined
    met = grid.join(few(cells, 100_000), (F.col("latitude") == F.col("_lat")) & (F.col("longitude") == F.col("_lon")))
    active = (F.col("start").isNull() | (F.col("t") >= F.col("start"))) & (F.col("end").isNull() | (F.col("t") < F.col("end") + F.make_dt_interval(F.lit(1))))
    held = ["version", *values, "_lat", "grid_longitude", "km", "_w"]
    once = met.where(active).groupBy("plant", "place", "t").agg(F.max_by(F.struct(*held), F.struct("start", "_w")).alias("_r")).select("plant", "place", "t", "_r.*")
    mean = lambda c: metrics.weighted_mean(F.col(c), F.col("_w"))
    return once.groupBy("plant", "t").agg(*(mean(v).alias(v) for v in values), mean("_lat").alias("grid_latitude"), mean("grid_longitude").alias("grid_longitude"), mean("km").alias("km"), F.max("version").alias("version"), F.count("*").alias("places"))


def _named(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(found: dict) -> bytes:
    out = struct.pack(">ii", 12 if found else 0, len(found))
    for key, value in found.items():
        out += _named(key) + (struct.pack(">i", 2) + _named(value) if isinstance(value, str) else struct.pack(">ii", 3 if isinstance(value, np.int16) else 6, 1) + np.asarray(value).astype(">i2" if isinstance(value, np.int16) else ">f8").tobytes().ljust(4, b"\0"))
    return out


def encoded(axes: dict[str, np.ndarray], grids: dict[str, np.ndarray], packing: dict[str, tuple[float, float]]) -> bytes:
    """A file of version 2 with the times as its records. axes: t (microseconds), version (may be absent), latitude, longitude; grids: doubles by these, NaN where missing;
    packing: scale and offset of variables that are kept as two bytes, others are doubles."""
    names = {"t": "time", "version": "expver", "latitude": "latitude", "longitude": "longitude"}
    dims, n = [k for k in names if k in axes], len(axes["t"])
    plan = {names[k]: ([d], {"units": "hours since 1900-01-01 00:00:00.0"} if d == 0 else {}, ">i4" if k in ("t", "version") else ">f4") for d, k in enumerate(dims)}
    data = {names[k]: axes[k] for k in dims}
    epoch = (datetime.datetime(1970, 1, 1) - datetime.datetime(1900, 1, 1)) // datetime.timedelta(hours=1)
    data["time"] = axes["t"] // UNITS["hour"] + epoch
    for name, grid in grids.items():
        if name in packing:
            scale, offset = packing[name]
            stored = np.where(np.isnan(grid), -32768, np.rint((np.nan_to_num(grid) - offset) / scale))
            if np.abs(stored).max(initial=0) > 32768:
                raise ContractError(f"{name} doesn't fit its packing")
            plan[name], data[name] = (list(range(len(dims))), {"scale_factor": scale, "add_offset": offset, "_FillValue": np.int16(-32768)}, ">i2"), stored
        else:
            plan[name], data[name] = (list(range(len(dims))), {}, ">f8"), grid
    raw = {k: np.ascontiguousarray(data[k]).astype(kind) for k, (_, _, kind) in plan.items()}
    one = lambda k: raw[k].nbytes // max(1, n) if plan[k][0][0] == 0 else raw[k].nbytes
    whole = lambda k: one(k) + -one(k) % 4
    number = {v[1:]: k for k, v in TYPES.items() if v.startswith(">")}

    def head(begin: dict[str, int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">i", n) + struct.pack(">ii", 10, len(dims))
        out += b"".join(_named(names[k]) + struct.pack(">i", 0 if k == "t" else len(axes[k])) for k in dims)
        out += struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, len(plan))
        for k, (ids, attributes, kind) in plan.items():
            out += _named(k) + struct.pack(f">{len(ids) + 1}i", len(ids), *ids) + _attributes(attributes) + struct.pack(">iiq", number[kind[1:]], whole(k), begin[k])
        return out

    at, begin = len(head(dict.fromkeys(plan, 0))), {}
    for k in sorted(plan, key=lambda k: plan[k][0][0] == 0):  # what has no records comes first
        begin[k] = at
        at += whole(k)
    fixed = b"".join(raw[k].tobytes().ljust(whole(k), b"\0") for k in plan if plan[k][0][0] != 0)
    over = [k for k in plan if plan[k][0][0] == 0]
    return head(begin) + fixed + b"".join(raw[k][r : r + 1].tobytes().ljust(whole(k), b"\0") for r in range(n) for k in over)


def write_grids(cells: DataFrame, folder: str, name: str, values: list[str], packing: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Writes one file for each value of ``name`` from long rows (version, if there is one, t, latitude, longitude, values) and gives (path, bytes, times).

    A file's axes are the values that its rows have; cells without a row are missing, and of two rows of a cell one stays. Times must be whole hours. A file is one group, so choose a name that bounds
    it (a month, a region).
    """
    axes = [k for k in ("t", "version", "latitude", "longitude") if k in cells.columns]

    def write(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        points, places = {}, []
        for k in axes:
            column = group.column(k).cast(pa.timestamp("us")).cast("int64") if k == "t" else group.column(k)
            points[k], at = np.unique(column.to_numpy(), return_inverse=True)
            places.append(at)
        if (points["t"] % UNITS["hour"]).any():
            raise ContractError("times that are not whole hours")
        shape = [len(points[k]) for k in axes]
        grids = {}
        for v in values:
            grids[v] = np.full(shape, np.nan)
            grids[v][tuple(places)] = group.column(v).to_numpy()
        path = f"{folder}/{key[0].as_py()}.nc"
        content = encoded(points, grids, packing or {})
        files.publish(path, content)
        return pa.table({"path": [path], "bytes": pa.array([len(content)], "int64"), "times": pa.array([shape[0]], "int64")})

    return cells.select(name, *axes, *(F.col(v).cast("double").alias(v) for v in values)).groupBy(name).applyInArrow(write, "path string, bytes long, times long")
