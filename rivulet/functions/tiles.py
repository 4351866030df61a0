"""Image tiling: which grid of square tiles fits an image's shape, and where the tiles lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 448
# Mean and deviation of the colours that models of this kind were trained with.
COLOUR_MEAN = (0.485, 0.456, 0.406)
COLOUR_DEVIATION = (0.229, 0.224, 0.225)


def cells(least: int, most: int) -> list[tuple[int, int]]:
    """Grids of i by j tiles, least to most in number, by number and then i, j."""
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most // i + 1) if i * j >= least), key=lambda c: (c[0] * c[1], c))


def grid(spark: SparkSession, least: int, most: int, tile: int = TILE) -> DataFrame:
    """i, j, blocks, width, height of each grid."""
    i, j = F.col("i"), F.col("j")
    sides = F.sequence(F.lit(1), F.lit(most))
    all_cells = spark.range(1).select(F.explode(sides).alias("i")).select("i", F.explode(sides).alias("j"))
    return all_cells.where((i * j).between(least, most)).select("i", "j", (i * j).alias("blocks"), (i * tile).alias("width"), (j * tile).alias("height"))


def closest(width: Column, height: Column, least: int = 1, most: int = 12, tile: int = TILE) -> Column:
    """struct(i, j): the grid whose shape is nearest to the image's.

    Of several equally near ones, the largest that the image more than half fills; if it fills none so, the smallest.
    """
    all_cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(i / j).alias("shape"), F.lit(0.5 * tile * tile * i * j).alias("half")) for i, j in cells(least, most)))
    image = F.struct((width.cast("double") / height.cast("double")).alias("shape"), (width.cast("double") * height).alias("area"))
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(float("inf")).alias("away"))

    def nearer(best: Column, c: Column, of: Column) -> Column:
        here = F.struct(c["i"].alias("i"), c["j"].alias("j"), F.abs(of["shape"] - c["shape"]).alias("away"))
        better = (here["away"] < best["away"]) | ((here["away"] == best["away"]) & (of["area"] > c["half"]))
        return F.when(better, here).otherwise(best)

    # the image's shape once, then one pass over the cells
    found = F.get(F.transform(F.array(image), lambda of: F.aggregate(all_cells, start, lambda best, c: nearer(best, c, of))), F.lit(0))
    return F.struct(found["i"].alias("i"), found["j"].alias("j"))


def closest_cell(width: int, height: int, least: int = 1, most: int = 12, tile: int = TILE) -> tuple[int, int]:
    """closest() for one image."""
    away = {c: abs(width / height - c[0] / c[1]) for c in cells(least, most)}
    tied = [c for c in away if away[c] == min(away.values())]
    return next((c for c in reversed(tied) if width * height > 0.5 * tile * tile * c[0] * c[1]), tied[0])


def boxes(cell: Column, thumbnail: bool = True, tile: int = TILE) -> Column:
    """Tiles of a grid as array<struct<left, top, right, bottom, whole>>, row by row; then the whole image on one tile,
    if asked for and the grid has more than one."""
    i, blocks = cell["i"], cell["i"] * cell["j"]

    def box(k: Column) -> Column:
        left, top = (k % i) * tile, F.floor(k / i).cast("int") * tile
        return F.struct(left.alias("left"), top.alias("top"), (left + tile).alias("right"), (top + tile).alias("bottom"), F.lit(False).alias("whole"))

    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), box)
    if not thumbnail:
        return tiles
    whole = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.lit(tile).alias("right"), F.lit(tile).alias("bottom"), F.lit(True).alias("whole"))
    return F.when(blocks > 1, F.concat(tiles, F.array(whole))).otherwise(tiles)


def normalised(pixels: np.ndarray) -> np.ndarray:
    """Height by width by three bytes to three planes of floats as models take them."""
    scaled = pixels.astype(np.float32) / 255.0
    return ((scaled - np.array(COLOUR_MEAN, np.float32)) / np.array(COLOUR_DEVIATION, np.float32)).transpose(2, 0, 1)


def rgb(pixels: np.ndarray) -> np.ndarray:
    """Height by width by three bytes, of grey (with or without a third axis), RGB or RGBA pixels."""
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    return np.repeat(pixels[:, :, :1], 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3]


def _weights(size: int, to: int) -> np.ndarray:
    """A row for each new place: cubic weights (a = -0.5) of the old ones, stretched where the image shrinks."""
    scale = size / to
    wide = max(scale, 1.0)
    center = (np.arange(to) + 0.5) * scale
    at = np.arange(size) + 0.5
    first, end = np.maximum(np.floor(center - 2 * wide + 0.5), 0), np.minimum(np.floor(center + 2 * wide + 0.5), size)
    x = np.abs(at - center[:, None]) / wide
    w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))
    w *= (at - 0.5 >= first[:, None]) & (at - 0.5 < end[:, None])
    return w / w.sum(axis=1, keepdims=True)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic, first along rows, then along columns, rounded to bytes after each."""
    h, w = pixels.shape[:2]
    to_bytes = lambda x: np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
    if w != width:
        pixels = to_bytes(np.einsum("tw,hwc->htc", _weights(w, width), pixels.astype(np.float64), optimize=True))
    if h != height:
        pixels = to_bytes(np.einsum("th,hwc->twc", _weights(h, height), pixels.astype(np.float64), optimize=True))
    return pixels


def stacked(pixels: np.ndarray, most: int = 12, tile: int = TILE, thumbnail: bool = True) -> np.ndarray:
    """An image as tiles by three planes by tile by tile floats: resized to the nearest grid, cut, and the whole
    image on a tile of its own at the end, if asked for and the grid has more than one."""
    image = rgb(pixels)
    i, j = closest_cell(image.shape[1], image.shape[0], 1, most, tile)
    large = resized(image, i * tile, j * tile)
    parts = [large[k // i * tile : (k // i + 1) * tile, k % i * tile : (k % i + 1) * tile] for k in range(i * j)]
    if thumbnail and len(parts) > 1:
        parts.append(resized(image, tile, tile))
    return np.stack([normalised(p) for p in parts])


def pixel_values(images: DataFrame, decode: Callable[[bytes], np.ndarray], most: int = 12, tile: int = TILE, content: str = "content") -> DataFrame:
    """The columns of images but content, n (the tile's place from 0), pixels (its floats, plane after plane), error.

    decode: from an image's bytes to height by width by channels. An image that it cannot read gives one row with
    an error.
    """
    kept = [c for c in images.columns if c != content]
    schema = T.StructType([*images.select(*(F.col(f"`{c}`") for c in kept)).schema.fields]).add("n", "integer").add("pixels", T.ArrayType(T.FloatType())).add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():  # one image's tiles at a time
                try:
                    tiles, error = stacked(decode(bytes(row[content])), most, tile), None
                except Exception as e:  # whatever decode raises on bad bytes
                    tiles, error = [None], f"{type(e).__name__}: {e}"
                out = pd.DataFrame({c: [row[c]] * len(tiles) for c in kept} | {"n": range(len(tiles))})
                yield out.assign(pixels=[None if t is None else t.ravel() for t in tiles], error=error)

    return images.select(*(F.col(f"`{c}`") for c in kept), content).mapInPandas(run, schema)


def normalise_pixels(side: int = TILE):
    """A vectorised function from raw RGB bytes of a side by side tile to its floats, plane after plane."""

    @F.pandas_udf("array<float>")
    def normalise(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else normalised(np.frombuffer(b, np.uint8).reshape(side, side, 3)).ravel())

    return normalise
