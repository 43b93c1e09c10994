"""Image arrays as table columns.

Pixels are flat, row-major, channels last, in the BGR order of Spark's image source.
Normalising is a JVM expression; resizing and augmenting run batch-wise in numpy, one
image at a time, seeded by the row key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channel means and deviations of the common image set, red, green, blue.
RGB_MEAN = [0.485, 0.456, 0.406]
RGB_STD = [0.229, 0.224, 0.225]


def _channel(values: list[float], i: Column) -> Column:
    """The BGR channel's value for position i."""
    return F.element_at(F.array(*[F.lit(v) for v in reversed(values)]), (i % 3 + 1).cast("int"))


def normalize(pixels: Column, mode: str) -> Column:
    """Modes: imagenet, 0-1, -1-1; input 0..255."""
    if mode == "imagenet":
        return F.transform(pixels, lambda x, i: (x / 255.0 - _channel(RGB_MEAN, i)) / _channel(RGB_STD, i))
    if mode == "0-1":
        return F.transform(pixels, lambda x: x / 255.0)
    return F.transform(pixels, lambda x: x / 127.5 - 1.0)


def inverse_normalize(pixels: Column, mode: str) -> Column:
    """Back to whole numbers 0..255, cut off as a byte would be."""
    if mode == "imagenet":
        back = F.transform(pixels, lambda x, i: (x * _channel(RGB_STD, i) + _channel(RGB_MEAN, i)) * 255)
    elif mode == "0-1":
        back = F.transform(pixels, lambda x: x * 255)
    else:
        back = F.transform(pixels, lambda x: (x + 1.0) * 127.5)
    return F.transform(back, lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0))).cast("int"))


def _array(row) -> np.ndarray:
    return np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels).astype(float)


def _sample(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional positions, edges repeated."""
    h, w = img.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[..., None], (x - x0)[..., None]
    top = img[y0, x0] * (1 - fx) + img[y0, x1] * fx
    return top * (1 - fy) + (img[y1, x0] * (1 - fx) + img[y1, x1] * fx) * fy


def _resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    y = (np.arange(h) + 0.5) * img.shape[0] / h - 0.5
    x = (np.arange(w) + 0.5) * img.shape[1] / w - 0.5
    return _sample(img, *np.meshgrid(y, x, indexing="ij"))


SCHEMA = "id bigint, copy int, height int, width int, channels int, data binary"


def image_resize(images: DataFrame, height: int, width: int, grey: bool = False) -> DataFrame:
    """(id, copy, height, width, channels, data) at a fixed size with three channels, or one for grey.

    Bilinear. A fourth (opacity) channel is dropped, a single one repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                img = _array(row)[:, :, :3]
                if img.shape[2] == 1:
                    img = np.repeat(img, 3, axis=2)
                img = _resized(img, height, width)
                if grey:
                    # Weights of blue, green and red in brightness.
                    img = (img @ np.array([0.114, 0.587, 0.299]))[:, :, None]
                out.append((row.id, 0, height, width, img.shape[2], np.rint(img).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "copy", "height", "width", "channels", "data"])

    return images.select("id", "height", "width", "channels", "data").mapInPandas(run, SCHEMA)


def image_augment(images: DataFrame, copies: int = 1, seed: int = 42) -> DataFrame:
    """`copies` changed versions per image, same shape: flip, brightness 0.8 to 1.2, rotation up to 15 degrees,
    zoom 0.9 to 1.1, each with probability one half, drawn from the row key."""
    spread = images.select("id", "height", "width", "channels", "data").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                rng = np.random.default_rng(zlib.crc32(f"{seed}-{row.id}-{row.copy}".encode()))
                img = _changed(_array(row), rng)
                out.append((row.id, row.copy, row.height, row.width, row.channels, np.rint(img).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "copy", "height", "width", "channels", "data"])

    return spread.mapInPandas(run, SCHEMA)


def _changed(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    h, w = img.shape[:2]
    flip, bright, turn, zoom = rng.random(4) > 0.5
    if flip:
        img = img[:, ::-1]
    if bright:
        img = np.clip(img * rng.uniform(0.8, 1.2), 0, 255)
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    if turn:
        a = np.deg2rad(rng.uniform(-15, 15))
        img = _sample(img, y * np.cos(a) - x * np.sin(a) + (h - 1) / 2, y * np.sin(a) + x * np.cos(a) + (w - 1) / 2)
    if zoom:
        z = rng.uniform(0.9, 1.1)
        yy, xx = y / z + (h - 1) / 2, x / z + (w - 1) / 2
        # zooming out shows black around the image
        inside = (yy > -1) & (yy < h) & (xx > -1) & (xx < w)
        img = _sample(img, yy, xx) * inside[..., None]
    return img
