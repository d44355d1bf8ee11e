"""Population rasters as a batch source: uncompressed single-band TIFF, read by bands of rows.

`spark.read.format("population_raster").option("path", ...)`; options lat_min, lat_max, lon_min, lon_max cut a window
and `rows` is the number of rows per task. Georeference comes from the file's tags. Cells that aren't above zero are left
out. Register with `register(spark)`.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# TIFF tags and the sizes of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, ROWS_PER_STRIP, SAMPLE_FORMAT, PIXEL_SCALE, TIEPOINT = 256, 257, 258, 259, 273, 278, 339, 33550, 33922
_SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


class Header:
    """Size, sample type, strips and georeference of a TIFF file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.read(8)
            if head[:2] not in (b"II", b"MM"):
                raise ValueError(f"{path} is no TIFF file")
            self.order = "<" if head[:2] == b"II" else ">"
            (at,) = struct.unpack(self.order + "I", head[4:])
            f.seek(at)
            (n,) = struct.unpack(self.order + "H", f.read(2))
            entries = [struct.unpack(self.order + "HHI4s", f.read(12)) for _ in range(n)]
            self.tags = {}
            for tag, kind, count, raw in entries:
                if kind not in _SIZES:
                    continue
                code, size = _SIZES[kind]
                if size * count > 4:
                    f.seek(struct.unpack(self.order + "I", raw)[0])
                    raw = f.read(size * count)
                self.tags[tag] = struct.unpack(f"{self.order}{count}{code}", raw[: size * count])
        one = lambda tag, default=None: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.offsets = one(WIDTH), one(HEIGHT), self.tags[OFFSETS]
        self.per_strip = one(ROWS_PER_STRIP, self.height)
        if one(COMPRESSION, 1) != 1:
            raise ValueError(f"{path} is compressed; only plain rasters are read")
        kind = {1: "u", 2: "i", 3: "f"}[one(SAMPLE_FORMAT, 1)]
        self.dtype = np.dtype(f"{self.order}{kind}{one(BITS, 8) // 8}")
        sx, sy, _ = self.tags[PIXEL_SCALE]
        i, j, _, x, y, _ = self.tags[TIEPOINT][:6]
        self.step_x, self.step_y, self.west, self.north = sx, sy, x - i * sx, y + j * sy


class Band(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:")
        self.rows = int(options.get("rows", 512))
        self.box = [float(options.get(k, v)) for k, v in (("lat_min", -91), ("lat_max", 91), ("lon_min", -361), ("lon_max", 361))]

    def _window(self, h: Header) -> tuple[int, int, int, int]:
        lat_min, lat_max, lon_min, lon_max = self.box
        clip = lambda x, most: max(0, min(most, x))
        return (
            clip(math.floor((h.north - lat_max) / h.step_y), h.height), clip(math.ceil((h.north - lat_min) / h.step_y), h.height),
            clip(math.floor((lon_min - h.west) / h.step_x), h.width), clip(math.ceil((lon_max - h.west) / h.step_x), h.width),
        )

    def partitions(self) -> list[Band]:
        r0, r1, _, _ = self._window(Header(self.path))
        return [Band(r, min(r + self.rows, r1)) for r in range(r0, r1, self.rows)]

    def read(self, partition: Band) -> Iterator[tuple]:
        h = Header(self.path)
        _, _, c0, c1 = self._window(h)
        with open(self.path, "rb") as f:
            for row in range(partition.first, partition.last):
                strip, within = divmod(row, h.per_strip)
                f.seek(h.offsets[strip] + (within * h.width + c0) * h.dtype.itemsize)
                values = np.frombuffer(f.read((c1 - c0) * h.dtype.itemsize), dtype=h.dtype)
                lat = h.north - (row + 0.5) * h.step_y
                for col in np.nonzero(values > 0)[0]:
                    yield (float(lat), float(h.west + (c0 + int(col) + 0.5) * h.step_x), float(values[col]))


class PopulationRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "population_raster"

    def schema(self) -> str:
        return "lat double, lon double, pop double"

    def reader(self, schema) -> RasterReader:
        return RasterReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PopulationRaster)


def write_raster(path: str, values: np.ndarray, west: float, north: float, step: float) -> None:
    """A plain float32 raster with one strip per row, for round trips."""
    values = np.ascontiguousarray(values, dtype="<f4")
    height, width = values.shape
    entries, extra, at = [], b"", 8 + 2 + 12 * 9 + 4

    def add(tag: int, kind: int, items: tuple) -> None:
        nonlocal extra
        code, size = _SIZES[kind]
        raw = struct.pack(f"<{len(items)}{code}", *items)
        if len(raw) > 4:
            entries.append(struct.pack("<HHII", tag, kind, len(items), at + len(extra)))
            extra += raw
        else:
            entries.append(struct.pack("<HHI", tag, kind, len(items)) + raw.ljust(4, b"\0"))

    body = at + 4 * height * (height > 1) + 24 + 48
    for tag, kind, items in ((WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (32,)), (COMPRESSION, 3, (1,)), (OFFSETS, 4, tuple(body + 4 * width * r for r in range(height))), (ROWS_PER_STRIP, 4, (1,)), (SAMPLE_FORMAT, 3, (3,)), (PIXEL_SCALE, 12, (step, step, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, west, north, 0.0))):
        add(tag, kind, items)
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0) + extra + values.tobytes())
