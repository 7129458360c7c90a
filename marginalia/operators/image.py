"""Raster operators on image bytes: netpbm decoding, thresholds, profiles, components, geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import ship_package


def decode_pnm(data: bytes) -> np.ndarray:
    """A grey image from plain or raw PGM or PPM bytes."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    kind, w, h, top = fields[0], *map(int, fields[1:])
    depth = 3 if kind in (b"P3", b"P6") else 1
    values = np.array(data[at:].split(), dtype=np.float64) if kind in (b"P2", b"P3") else np.frombuffer(data, np.uint8, w * h * depth, at + 1).astype(np.float64)
    image = values.reshape(h, w, depth).mean(2) * (255 / top)
    return image.round().astype(np.uint8)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % image.shape[::-1] + image.astype(np.uint8).tobytes()


def otsu_threshold(image: np.ndarray) -> int:
    """The last of the levels that best split the grey values."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(w * (w[-1] - w) * (m / w - (m[-1] - m) / (w[-1] - w)) ** 2)
    return int(255 - np.argmax(between[::-1].round(6)))


def box_sums(image: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the square around each pixel, clipped to the image, and the pixels in it, by prefix sums."""
    h, w = image.shape
    s = np.pad(image.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    return s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0], (y1 - y0)[:, None] * (x1 - x0)[None]


def local_threshold(image: np.ndarray, radius: int = 15, k: float = 0.2, *, kind: str = "sauvola") -> np.ndarray:
    """Ink (true) where a pixel is under the local threshold: mean * (1 + k * (sd / 128 - 1)), or mean - k * sd."""
    total, n = box_sums(image, radius)
    squares, _ = box_sums(image.astype(np.float64) ** 2, radius)
    mean = total / n
    sd = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return image < (mean * (1 + k * (sd / 128 - 1)) if kind == "sauvola" else mean - k * sd)


def profile(ink: np.ndarray, axis: int) -> np.ndarray:
    """Ink by row (axis 1) or column (axis 0)."""
    return ink.sum(axis)


def components(ink: np.ndarray) -> np.ndarray:
    """8-connected labels from 1, in scan order; each pixel falls to the least label near it until none changes."""
    label = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    big = ink.size + 1
    while True:
        p = np.pad(np.where(ink, label, big), 1, constant_values=big)
        low = np.min([p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(ink, low, 0)
        if (new == label).all():
            break
        label = new
        flat = label.ravel()
        flat[flat > 0] = flat[flat[flat > 0] - 1]  # and on to the label's own label
    names = np.unique(label[ink])
    return np.where(ink, np.searchsorted(names, label) + 1, 0)


def shear(image: np.ndarray, slope: float, fill: int = 255) -> np.ndarray:
    """Rows moved sideways in proportion to their distance from the bottom."""
    h, w = image.shape
    moved = np.rint(slope * (h - 1 - np.arange(h))).astype(int)
    left = -min(0, moved.min())
    out = np.full((h, w + left + max(0, moved.max())), fill, dtype=image.dtype)
    for y in range(h):
        out[y, left + moved[y] : left + moved[y] + w] = image[y]
    return out


def slant(ink: np.ndarray, slopes: np.ndarray | None = None) -> float:
    """The shear that makes columns most uneven, so that strokes stand upright."""
    slopes = np.linspace(-1, 1, 41) if slopes is None else slopes
    return float(max(slopes, key=lambda s: (profile(shear(ink.astype(np.uint8), s, 0), 0).astype(float) ** 2).sum()))


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """By nearest pixel."""
    return image[(np.arange(h) * image.shape[0] // h)[:, None], np.arange(w) * image.shape[1] // w]


def map_images(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """path, content after ``f`` on each decoded image."""
    ship_package(images.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda c: encode_pgm(f(decode_pnm(bytes(c)))))

    return images.withColumn("content", F.pandas_udf(run, "binary")("content"))


def describe_images(images: DataFrame) -> DataFrame:
    """path, width, height, threshold, ink, n_components, slant of each image."""
    ship_package(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                g = decode_pnm(bytes(content))
                t = otsu_threshold(g)
                ink = g <= t
                out.append((path, g.shape[1], g.shape[0], t, int(ink.sum()), int(components(ink).max(initial=0)), slant(ink)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "threshold", "ink", "n_components", "slant"])

    return images.mapInPandas(run, "path string, width int, height int, threshold int, ink long, n_components int, slant double")
