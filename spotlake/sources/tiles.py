"""Image tiles as rows: a Spark data source over .npy and strip or tile TIFF files that reads only the bytes of its band,
and over PNG and BMP files, which are decoded whole and therefore limited in size.

``spark.dataSource.register(TileSource)`` and ``spark.read.format("tiles").option("paths", "a.npy,b.tif").load()``.
One partition is a band of tiles of one file; headers are read on the driver, pixels in the tasks.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spotlake.sources.rasters import Bmp, Png, Raster

SCHEMA = (
    "image_id string, tile_id int, x0 int, y0 int, w int, h int, core_x int, core_y int, core_w int, core_h int, "
    "image_w int, image_h int, dtype string, px binary, inverted boolean"
)
MAX_SEGMENT = 64 << 20


class Npy:
    """A 2-D array file, mapped."""

    whole = False

    def __init__(self, path: str):
        self.array = np.load(path, mmap_mode="r")
        if self.array.ndim != 2:
            raise ValueError(f"{path}: one channel is needed")
        self.shape, self.dtype = self.array.shape, self.array.dtype

    def rows(self, y0: int, y1: int) -> np.ndarray:
        return np.array(self.array[y0:y1])


class Tiff:
    """A one-channel TIFF or BigTIFF of strips or tiles, uncompressed or deflated; a segment beyond 64 MiB is refused."""

    whole = False
    _SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(16)
            self.order = {b"II": "<", b"MM": ">"}[head[:2]]
            big = struct.unpack(self.order + "H", head[2:4])[0] == 43
            at = struct.unpack(self.order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
            f.seek(at)
            n = struct.unpack(self.order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
            entries = [f.read(20 if big else 12) for _ in range(n)]
            tags = {}
            for e in entries:
                tag, kind = struct.unpack(self.order + "HH", e[:4])
                count = struct.unpack(self.order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
                size, raw = self._SIZES.get(kind, 1) * count, e[12 if big else 8 :]
                if size > len(raw):
                    f.seek(struct.unpack(self.order + ("Q" if big else "I"), raw)[0])
                    raw = f.read(size)
                code = {1: "B", 3: "H", 4: "I", 16: "Q"}.get(kind)
                if code:
                    tags[tag] = struct.unpack(f"{self.order}{count}{code}", raw[:size])
        self.shape = (tags[257][0], tags[256][0])
        if tags.get(277, (1,))[0] != 1:
            raise ValueError(f"{path}: one channel is needed")
        self.compression = tags.get(259, (1,))[0]
        if self.compression not in (1, 8, 32946) or tags.get(317, (1,))[0] != 1:
            raise ValueError(f"{path}: compression {self.compression} is not read")
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        self.dtype = np.dtype(f"{self.order}{kind}{tags[258][0] // 8}")
        self.inverted = tags.get(262, (1,))[0] == 0
        tiled = 324 in tags
        self.seg_h = tags[323][0] if tiled else min(tags.get(278, (self.shape[0],))[0], self.shape[0])
        self.seg_w = tags[322][0] if tiled else self.shape[1]
        self.across = -(-self.shape[1] // self.seg_w)
        self.tiled = tiled
        self.offsets, self.lengths = tags[324 if tiled else 273], tags[325 if tiled else 279]

    def rows(self, y0: int, y1: int) -> np.ndarray:
        out = np.zeros((y1 - y0, self.shape[1]), self.dtype)
        line = self.seg_w * self.dtype.itemsize
        with open(self.path, "rb") as f:
            for band in range(y0 // self.seg_h, -(-y1 // self.seg_h)):
                top = band * self.seg_h
                height = self.seg_h if self.tiled else min(self.seg_h, self.shape[0] - top)
                a, b = max(y0, top), min(y1, top + height)
                for i in range(self.across):
                    k = band * self.across + i
                    if self.compression == 1:
                        f.seek(self.offsets[k] + (a - top) * line)
                        part = np.frombuffer(f.read((b - a) * line), self.dtype).reshape(b - a, self.seg_w)
                    else:
                        if height * line > MAX_SEGMENT:
                            raise ValueError(f"{self.path}: a segment of {height * line} bytes is too large")
                        f.seek(self.offsets[k])
                        raw = zlib.decompress(f.read(self.lengths[k]))
                        part = np.frombuffer(raw, self.dtype)[: height * self.seg_w].reshape(height, self.seg_w)[a - top : b - top]
                    x = i * self.seg_w
                    width = min(self.seg_w, self.shape[1] - x)
                    out[a - y0 : b - y0, x : x + width] = part[:, :width]
        return out


def opened(path: str) -> Npy | Tiff | Raster:
    kinds = {".npy": Npy, ".png": Png, ".bmp": Bmp, ".tif": Tiff, ".tiff": Tiff}
    kind = kinds.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ValueError(f"{path}: files of this kind are not read")
    return kind(path)


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


class Band(InputPartition):
    def __init__(self, path: str, y: int, end: int):
        self.path, self.y, self.end = path, y, end


class TileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split(",") if p]
        self.tile, self.halo = int(options.get("tile", 1024)), int(options.get("halo", 128))
        if not 0 <= self.halo < self.tile:
            raise ValueError("the halo must be smaller than the tile")
        # An image is named by its file; where several paths have a file of that name, by the whole path.
        stems = Counter(_stem(p) for p in set(self.paths))
        self.names = {p: _stem(p) if stems[_stem(p)] == 1 else os.path.splitext(p)[0] for p in self.paths}

    def partitions(self) -> list[Band]:
        out = []
        for p in self.paths:
            source = opened(p)
            height = source.shape[0]
            out += [Band(p, y, y + 1) for y in range(0, height, self.tile)] if not source.whole else [Band(p, 0, height)]
        return out

    def read(self, band: Band) -> Iterator[tuple]:
        source = opened(band.path)
        for y in range(band.y, band.end, self.tile):
            yield from self._row(source, band.path, y)

    def _row(self, source: Npy | Tiff | Raster, path: str, y: int) -> Iterator[tuple]:
        height, width = source.shape
        y0, y1 = max(0, y - self.halo), min(height, y + self.tile + self.halo)
        rows = source.rows(y0, y1)
        rows = rows.astype(rows.dtype.newbyteorder("<"))
        across = -(-width // self.tile)
        for i in range(across):
            x = i * self.tile
            x0, x1 = max(0, x - self.halo), min(width, x + self.tile + self.halo)
            core_w, core_h = min(self.tile, width - x), min(self.tile, height - y)
            name = self.names[path]
            number = y // self.tile * across + i
            yield (name, number, x0, y0, x1 - x0, y1 - y0, x, y, core_w, core_h, width, height, rows.dtype.str, np.ascontiguousarray(rows[:, x0:x1]).tobytes(), getattr(source, "inverted", False))


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def read_tiles(spark: SparkSession, paths: list[str], tile: int = 1024, halo: int = 128) -> DataFrame:
    spark.dataSource.register(TileSource)
    return spark.read.format("tiles").option("paths", ",".join(paths)).option("tile", tile).option("halo", halo).load()


def tile_grid(images: DataFrame, tile: int = 1024, halo: int = 128) -> DataFrame:
    """The halo tiles and unique cores of images (image_id, image_w, image_h), without pixels."""
    if not 0 <= halo < tile:
        raise ValueError("the halo must be smaller than the tile")
    ys = images.where("image_w > 0 and image_h > 0").withColumn("core_y", F.explode(F.sequence(F.lit(0), F.col("image_h") - 1, F.lit(tile))))
    at = ys.withColumn("core_x", F.explode(F.sequence(F.lit(0), F.col("image_w") - 1, F.lit(tile))))
    low = lambda c: F.greatest(F.lit(0), F.col(c) - halo)
    return at.select(
        "image_id", "core_x", "core_y", F.least(F.lit(tile), F.col("image_w") - F.col("core_x")).alias("core_w"), F.least(F.lit(tile), F.col("image_h") - F.col("core_y")).alias("core_h"),
        low("core_x").alias("x0"), low("core_y").alias("y0"), (F.least(F.col("image_w"), F.col("core_x") + tile + halo) - low("core_x")).alias("w"),
        (F.least(F.col("image_h"), F.col("core_y") + tile + halo) - low("core_y")).alias("h"),
    )
