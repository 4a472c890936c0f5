"""Images as tiles of RGBA bytes: PNG in and out, palette, thumbnail, patches, differences and checks.

An image is a row of (``image``, ``width``, ``height``, ``rgba`` binary) or, cut, rows of (``image``, ``tx``, ``ty``, ``w``, ``h``,
``rgba``), 64 pixels wide and high save at the right and lower edges.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64
PALETTE = 8
THUMB = 128
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
PIXELS = "image string, width int, height int, rgba binary"
TILES = "image string, tx int, ty int, w int, h int, rgba binary"


class ImageError(ValueError):
    """Bytes that are no image of a kind that is read here."""


def paeth(left: int, up: int, corner: int) -> int:
    """The neighbour nearest to left + up - corner; of equals left, then up."""
    guess = left + up - corner
    return min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))[2]


def filter_paeth(pixels: np.ndarray) -> np.ndarray:
    """Differences from the Paeth guess, of an array (rows, columns, channels) of bytes."""
    x = pixels.astype(np.int16)
    left, up, corner = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:], corner[1:, 1:] = x[:, :-1], x[:-1], x[:-1, :-1]
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    return (x - np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))).astype(np.uint8)


def unfilter_paeth(residue: np.ndarray) -> np.ndarray:
    """The pixels again; each needs those left of and above it, so columns go one by one, all channels at once."""
    rows, columns, channels = residue.shape
    out = np.zeros((rows + 1, columns + 1, channels), dtype=np.int16)
    for y in range(rows):
        for x in range(columns):
            left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
            guess = left + up - corner
            a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
            out[y + 1, x + 1] = (residue[y, x] + np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))) & 255
    return out[1:, 1:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes of an 8-bit gray, gray-alpha, RGB or RGBA image without interlacing."""
    if data[:3] == b"\xff\xd8\xff":
        raise ImageError("JPEG loses what it stores and is not read; convert the image to PNG first")
    if not data.startswith(_SIGNATURE):
        raise ImageError("not a PNG image")
    at, packed, head = len(_SIGNATURE), b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ImageError("a PNG chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ImageError("only 8-bit gray, gray-alpha, RGB and RGBA images without interlacing are read")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height, width * n), dtype=np.uint8)
    above = np.zeros(width * n, dtype=np.int16)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int16)
        if kind == 0:
            now = line
        elif kind == 2:
            now = (line + above) & 255
        elif kind == 1:
            now = (np.cumsum(line.reshape(width, n), axis=0) & 255).reshape(-1)
        else:
            now = np.zeros(width * n, dtype=np.int16)
            for x in range(width * n):
                left, corner = (now[x - n], above[x - n]) if x >= n else (0, 0)
                now[x] = (line[x] + ((left + above[x]) // 2 if kind == 3 else paeth(int(left), int(above[x]), int(corner)))) & 255
        rows[y], above = now, now
    pixels = rows.reshape(height, width, n)
    gray = n < 3
    colour = np.repeat(pixels[:, :, :1], 3, axis=2) if gray else pixels[:, :, :3]
    alpha = pixels[:, :, -1:] if n in (2, 4) else np.full((height, width, 1), 255, dtype=np.uint8)
    return np.concatenate([colour, alpha], axis=2)


def encode_png(rgba: np.ndarray) -> bytes:
    """RGBA, or RGB if no pixel is transparent."""
    height, width, _ = rgba.shape
    opaque = bool((rgba[:, :, 3] == 255).all())
    pixels = rgba[:, :, :3] if opaque else rgba
    lines = filter_paeth(pixels).reshape(height, -1)
    raw = np.concatenate([np.full((height, 1), 4, dtype=np.uint8), lines], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if opaque else 6, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def _mapped(df: DataFrame, shape: str, of) -> DataFrame:
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in shape.split(", ")]
        for frame in frames:
            yield pd.DataFrame([r for row in frame.itertuples(index=False) for r in of(row)], columns=names)

    return df.mapInPandas(batches, shape)


def _array(rgba: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(rgba, dtype=np.uint8).reshape(height, width, 4)


def from_png(files: DataFrame) -> DataFrame:
    """Decoded images of rows ``image``, ``content``."""

    def of(row):
        pixels = decode_png(bytes(row.content))
        yield row.image, pixels.shape[1], pixels.shape[0], pixels.tobytes()

    return _mapped(files.select("image", "content"), PIXELS, of)


def to_png(images: DataFrame) -> DataFrame:
    return _mapped(images.select("image", "width", "height", "rgba"), "image string, content binary", lambda r: [(r.image, encode_png(_array(r.rgba, r.height, r.width)))])


def cut(images: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of every image."""

    def of(r):
        pixels = _array(r.rgba, r.height, r.width)
        for ty in range(-(-r.height // size)):
            for tx in range(-(-r.width // size)):
                part = pixels[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size]
                yield r.image, tx, ty, part.shape[1], part.shape[0], part.tobytes()

    return _mapped(images.select("image", "width", "height", "rgba"), TILES, of)


def join_tiles(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """Whole images again: the tiles of one image come together."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        width = int((rows["tx"] * size + rows["w"]).max())
        height = int((rows["ty"] * size + rows["h"]).max())
        out = np.zeros((height, width, 4), dtype=np.uint8)
        for r in rows.itertuples():
            out[r.ty * size : r.ty * size + r.h, r.tx * size : r.tx * size + r.w] = _array(r.rgba, r.h, r.w)
        return pd.DataFrame([(rows["image"].iloc[0], width, height, out.tobytes())], columns=["image", "width", "height", "rgba"])

    return tiles.groupBy("image").applyInPandas(of, PIXELS)


def store(tiles: DataFrame) -> DataFrame:
    """Tiles compressed, each raw or Paeth-filtered, whichever is smaller: ``filtered`` and ``stored``."""

    def of(r):
        pixels = _array(r.rgba, r.h, r.w)
        pack = zstandard.ZstdCompressor(level=12).compress
        plain, lean = pack(pixels.tobytes()), pack(filter_paeth(pixels).tobytes())
        yield r.image, r.tx, r.ty, r.w, r.h, len(lean) < len(plain), min(plain, lean, key=len)

    return _mapped(tiles.select("image", "tx", "ty", "w", "h", "rgba"), "image string, tx int, ty int, w int, h int, filtered boolean, stored binary", of)


def load(stored: DataFrame) -> DataFrame:
    def of(r):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r.stored)), dtype=np.uint8).reshape(r.h, r.w, 4)
        yield r.image, r.tx, r.ty, r.w, r.h, (unfilter_paeth(raw) if r.filtered else raw).tobytes()

    return _mapped(stored.select("image", "tx", "ty", "w", "h", "filtered", "stored"), TILES, of)


def pixels(images: DataFrame) -> DataFrame:
    """One row per pixel: ``image``, ``x``, ``y``, ``r``, ``g``, ``b``, ``a``; native."""
    i = F.posexplode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i", "_")
    channel = lambda k: F.conv(F.hex(F.substring("rgba", F.col("i") * 4 + 1 + k, F.lit(1))), 16, 10).cast("int")
    return images.select("image", "width", "rgba", i).select("image", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *(channel(k).alias(c) for k, c in enumerate("rgba")))


def palette(pixels: DataFrame, n: int = PALETTE, key: str = "image") -> DataFrame:
    """The ``n`` most frequent colours of four bits a channel with their share in percent, ties by colour. Counts are
    combined before the shuffle."""
    from pyspark.sql import Window

    quantised = [F.col(c).bitwiseAND(0xF0).alias(c) for c in "rgba"]
    counted = pixels.select(key, *quantised).groupBy(key, *"rgba").agg(F.count("*").alias("pixels"))
    total = F.sum("pixels").over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("pixels"), *"rgba"))
    return counted.withColumn("percent", F.round(F.col("pixels") * 100.0 / total, 1)).withColumn("rank", rank).where(F.col("rank") <= n)


def thumb_edge(longest: int) -> int:
    """A third of the image, 128 pixels at most; images below 48 stay as they are."""
    third = longest // 3
    return longest if third < 16 else min(THUMB, third)


_LINEAR = np.where(np.arange(256) / 255 <= 0.04045, np.arange(256) / 255 / 12.92, ((np.arange(256) / 255 + 0.055) / 1.055) ** 2.4)


def shrink(rgba: np.ndarray, edge: int) -> np.ndarray:
    """At most ``edge`` pixels long; colours are averaged in linear light and weighted by their opacity."""
    height, width, _ = rgba.shape
    longest = max(height, width)
    if not edge or longest <= edge:
        return rgba
    w, h = max(1, width * edge // longest), max(1, height * edge // longest)
    alpha = rgba[:, :, 3:] / 255.0
    light = np.concatenate([_LINEAR[rgba[:, :, :3]] * alpha, alpha, np.ones_like(alpha)], axis=2)

    def sums(x: np.ndarray, n_out: int, n_in: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        low = np.arange(n_out) * n_in // n_out
        high = np.maximum((np.arange(n_out) + 1) * n_in // n_out, low + 1)
        return total[high] - total[low]

    cells = sums(sums(light, h, height).transpose(1, 0, 2), w, width).transpose(1, 0, 2)
    weight = cells[:, :, 3:4]
    mean = np.divide(cells[:, :, :3], weight, out=np.zeros_like(cells[:, :, :3]), where=weight > 1e-12)
    srgb = np.where(mean <= 0.0031308, mean * 12.92, 1.055 * np.clip(mean, 0, 1) ** (1 / 2.4) - 0.055)
    level = np.floor(np.concatenate([srgb, weight / cells[:, :, 4:]], axis=2) * 255 + 0.5)
    level[np.repeat(weight <= 1e-12, 4, axis=2)] = 0
    return level.clip(0, 255).astype(np.uint8)


def thumbnails(images: DataFrame, edge: int | None = None) -> DataFrame:
    def of(r):
        small = shrink(_array(r.rgba, r.height, r.width), thumb_edge(max(r.width, r.height)) if edge is None else edge)
        yield r.image, small.shape[1], small.shape[0], small.tobytes()

    return _mapped(images.select("image", "width", "height", "rgba"), PIXELS, of)


def summarise(images: DataFrame, size: int = TILE) -> DataFrame:
    """Size, megapixels, tiles and whether every pixel is opaque."""
    opaque = ~F.lower(F.hex("rgba")).rlike("^(.{8})*.{6}(?!ff)..")
    n = (F.ceil(F.col("width") / size) * F.ceil(F.col("height") / size)).cast("int")
    return images.select("image", "width", "height", F.round(F.col("width") * F.col("height") / 1e6, 1).alias("megapixels"), n.alias("tiles"), opaque.alias("opaque"))


def patch(tiles: DataFrame, x: int, y: int, width: int, height: int, rgba: bytes, image: str, size: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Tiles with a rectangle rewritten, and those that truly changed. Only tiles that the rectangle meets are touched."""
    meets = (F.col("image") == image) & (F.col("tx") * size < x + width) & (F.col("tx") * size + F.col("w") > x) & (F.col("ty") * size < y + height) & (F.col("ty") * size + F.col("h") > y)
    new = _array(rgba, height, width)

    def of(r):
        own = _array(r.rgba, r.h, r.w).copy()
        left, top = r.tx * size, r.ty * size
        x0, x1, y0, y1 = max(x, left), min(x + width, left + r.w), max(y, top), min(y + height, top + r.h)
        own[y0 - top : y1 - top, x0 - left : x1 - left] = new[y0 - y : y1 - y, x0 - x : x1 - x]
        yield r.image, r.tx, r.ty, r.w, r.h, own.tobytes()

    changed = _mapped(tiles.where(meets).select("image", "tx", "ty", "w", "h", "rgba"), TILES, of)
    touched = changed.join(tiles.select("image", "tx", "ty", F.col("rgba").alias("old")), ["image", "tx", "ty"]).where("rgba <> old").drop("old")
    return tiles.where(~meets).unionByName(changed), touched


def diff(a: DataFrame, b: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles whose pixels differ, with their rectangle, by row and column; one equi-join."""
    on = ["image", "tx", "ty"]
    joined = b.select(*on, "w", "h", F.sha2("rgba", 256).alias("new")).join(a.select(*on, F.sha2("rgba", 256).alias("old")), on, "left")
    return joined.where(~F.col("new").eqNullSafe(F.col("old"))).select(*on, (F.col("tx") * size).alias("x"), (F.col("ty") * size).alias("y"), "w", "h").orderBy("image", "ty", "tx")


def grid_faults(images: DataFrame, tiles: DataFrame, size: int = TILE) -> DataFrame:
    """``image``, ``tx``, ``ty``, ``message``: tiles missing from the grid, outside it or there twice."""
    on = ["image", "tx", "ty"]
    columns = F.explode(F.sequence(F.lit(0), F.ceil(F.col("width") / size).cast("int") - 1)).alias("tx")
    rows = F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / size).cast("int") - 1)).alias("ty")
    grid = images.select("image", "height", columns).select("image", "tx", rows)
    held = tiles.groupBy(*on).agg(F.count("*").alias("n"))
    named = lambda df, m: df.select(*on, F.lit(m).alias("message"))
    return named(grid.join(held, on, "left_anti"), "the tile is missing").unionByName(named(held.join(grid, on, "left_anti"), "the tile lies outside the image")).unionByName(named(held.where("n > 1"), "the tile is there more than once"))


def opaque_faults(declared: DataFrame, pixels: DataFrame) -> DataFrame:
    """Images declared opaque (``image``, ``opaque``) with a pixel that is not."""
    found = pixels.groupBy("image").agg(F.bool_and(F.col("a") == 255).alias("is_opaque"))
    return declared.join(found, "image").where("opaque and not is_opaque").select("image", F.lit("declared opaque, but a pixel is not").alias("message"))
