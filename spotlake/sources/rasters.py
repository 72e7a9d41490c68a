"""PNG and BMP files as one-channel arrays, decoded without image libraries."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from spotlake.kernels.image import gray

MAX_RASTER = 64 << 20


def one_channel(a: np.ndarray) -> np.ndarray:
    """Colours by Rec. 709, rounded back to the type of the file; alpha is dropped."""
    return a if a.ndim == 2 else np.rint(gray(a)).astype(a.dtype)


class Raster:
    """A file that is decoded as a whole (one partition); beyond 64 MiB of pixels it is refused."""

    whole = True

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            head = f.read(64)
        height, width, size = self.header(head)
        if not width > 0 < height or height * width * size > MAX_RASTER:
            raise ValueError(f"{path}: {width} x {height} pixels are not read")
        self.shape, self._array = (height, width), None

    def header(self, head: bytes) -> tuple[int, int, int]:
        raise NotImplementedError

    def decode(self) -> np.ndarray:
        raise NotImplementedError

    def rows(self, y0: int, y1: int) -> np.ndarray:
        if self._array is None:
            self._array = one_channel(self.decode())
        return self._array[y0:y1]


def unfiltered(raw: bytes, height: int, line: int, step: int) -> np.ndarray:
    """Undo the five row filters of PNG; ``step`` is the bytes of a pixel."""
    data = np.frombuffer(raw, np.uint8).reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    before = np.zeros(line, np.uint8)
    for y in range(height):
        kind, row = int(data[y, 0]), data[y, 1:]
        if kind == 0:
            now = row
        elif kind == 1:
            now = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            now = row + before
        elif kind in (3, 4):
            now = _sequential(row.tolist(), before.tolist(), step, kind == 4)
        else:
            raise ValueError(f"unknown row filter {kind}")
        out[y] = before = now
    return out


def _sequential(row: list[int], up: list[int], step: int, paeth: bool) -> np.ndarray:
    """The two filters in which a byte depends on the one just restored."""
    now = [0] * step + row
    up = [0] * step + up
    for i in range(step, len(now)):
        a, b, c = now[i - step], up[i], up[i - step]
        if paeth:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        else:
            guess = (a + b) // 2
        now[i] = (now[i] + guess) & 255
    return np.array(now[step:], np.uint8)


class Png(Raster):
    """8 or 16 bits a channel, gray, colour, palette or with alpha; interlaced files are refused."""

    # Channels of each colour type.
    CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}

    def header(self, head: bytes) -> tuple[int, int, int]:
        if head[:8] != b"\x89PNG\r\n\x1a\n":
            raise ValueError(f"{self.path}: no PNG")
        width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head[16:29])
        if bits not in (8, 16) or colour not in self.CHANNELS or interlaced:
            raise ValueError(f"{self.path}: {bits} bits, colour type {colour}, interlacing {interlaced} is not read")
        self.dtype, self.channels, self.palette = np.dtype(f"u{bits // 8}"), self.CHANNELS[colour], colour == 3
        return height, width, self.channels * self.dtype.itemsize

    def decode(self) -> np.ndarray:
        parts, colours = [], None
        with open(self.path, "rb") as f:
            f.seek(8)
            while len(head := f.read(8)) == 8:
                size, kind = struct.unpack(">I4s", head)
                body = f.read(size + 4)[:size]
                if kind == b"IDAT":
                    parts.append(body)
                elif kind == b"PLTE":
                    colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
                elif kind == b"IEND":
                    break
        height, width = self.shape
        step = self.channels * self.dtype.itemsize
        flat = unfiltered(zlib.decompressobj().decompress(b"".join(parts), height * (width * step + 1)), height, width * step, step)
        a = flat.view(self.dtype.newbyteorder(">")).astype(self.dtype).reshape(height, width, self.channels)
        return colours[a[..., 0]] if self.palette else a[..., 0] if self.channels == 1 else a


class Bmp(Raster):
    """Uncompressed 8-bit (palette), 24-bit and 32-bit bitmaps, stored from the bottom or the top."""

    dtype = np.dtype("u1")

    def header(self, head: bytes) -> tuple[int, int, int]:
        if head[:2] != b"BM":
            raise ValueError(f"{self.path}: no BMP")
        self.start, self.size, width, height, _, bits, packed = struct.unpack("<IIiiHHI", head[10:34])
        if bits not in (8, 24, 32) or packed not in (0, 3):
            raise ValueError(f"{self.path}: {bits} bits, compression {packed} is not read")
        self.bytes, self.bottom_up = bits // 8, height > 0
        return abs(height), width, self.bytes

    def decode(self) -> np.ndarray:
        height, width = self.shape
        line = -(-width * self.bytes // 4) * 4
        with open(self.path, "rb") as f:
            f.seek(14 + self.size)
            colours = np.frombuffer(f.read(max(0, self.start - 14 - self.size)), np.uint8)
            f.seek(self.start)
            flat = np.frombuffer(f.read(line * height), np.uint8).reshape(height, line)
        a = flat[:, : width * self.bytes].reshape(height, width, self.bytes)
        a = a[::-1] if self.bottom_up else a
        if self.bytes > 1:
            return a[..., 2::-1]
        table = colours[: len(colours) // 4 * 4].reshape(-1, 4)[:, 2::-1]
        return table[a[..., 0]] if len(table) else a[..., 0]
