"""Array statistics over image rasters, batched through Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_SIDE, RASTER_SIDE = 8, 32
#: Images of one shape that are measured at once; what a worker holds beside its Arrow batch does not grow with that.
STACK = 256
MEASURES = T.StructType([
    *[T.StructField(c, T.DoubleType()) for c in ("uniformidade", "chapado", "gradiente", "branco", "saturacao")],
    T.StructField("cores", T.IntegerType()), T.StructField("uniforme", T.BooleanType()),
])


def _cosines() -> np.ndarray:
    """Rows of the type-II discrete cosine transform that the hash keeps."""
    k, n = np.arange(HASH_SIDE)[:, None], np.arange(RASTER_SIDE)[None, :]
    return 2 * np.cos(np.pi * k * (2 * n + 1) / (2 * RASTER_SIDE))


def _shares(cells: int) -> np.ndarray:
    """How much of each pixel falls into each of ``cells`` equal stretches, in whole numbers so that cells compare exactly."""
    c, k = np.arange(cells)[:, None], np.arange(RASTER_SIDE)[None, :]
    return np.maximum(0, np.minimum(cells * (k + 1), RASTER_SIDE * (c + 1)) - np.maximum(cells * k, RASTER_SIDE * c))


def _pack(flags: np.ndarray) -> np.ndarray:
    """Boolean rows of 64, first flag most significant, as signed longs."""
    return np.packbits(flags.reshape(len(flags), -1), axis=1).view(">u8").astype("u8").view("i8").ravel()


@F.pandas_udf(T.LongType())
def _perceptual(rasters: Iterator[pd.Series]) -> Iterator[pd.Series]:
    basis = _cosines()
    for batch in rasters:
        pixels = np.stack([np.asarray(x, dtype=float) for x in batch]).reshape(-1, RASTER_SIDE, RASTER_SIDE)
        low = basis @ pixels @ basis.T
        middle = np.median(low.reshape(len(low), -1), axis=1)[:, None, None]
        yield pd.Series(_pack(low > middle))


@F.pandas_udf(T.LongType())
def _difference(rasters: Iterator[pd.Series]) -> Iterator[pd.Series]:
    rows, columns = _shares(HASH_SIDE), _shares(HASH_SIDE + 1)
    for batch in rasters:
        whole = np.stack([np.asarray(x, dtype=np.int64) for x in batch]).reshape(-1, RASTER_SIDE, RASTER_SIDE)
        pixels = rows @ whole @ columns.T
        yield pd.Series(_pack(pixels[:, :, 1:] > pixels[:, :, :-1]))


def perceptual_hash(raster: Column) -> Column:
    """64-bit pHash of a flattened 32 x 32 grayscale raster: bit = low-frequency coefficient above their median."""
    return _perceptual(raster)


def difference_hash(raster: Column) -> Column:
    """64-bit dHash of a flattened 32 x 32 grayscale raster, averaged down to 8 rows by 9 columns: bit = cell brighter than
    its left neighbour."""
    return _difference(raster)


def _same_neighbours(gray: np.ndarray, axis: int) -> np.ndarray:
    """Share of neighbouring rows (axis 1) or columns (axis 2) that are equal pixel by pixel."""
    other = 3 - axis
    return (np.diff(gray, axis=axis) == 0).all(axis=other).mean(axis=1)


def _stack_measures(gray: np.ndarray, rgb: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of images of one shape: gray (images, rows, columns), rgb (images, pixels, 3)."""
    across, down = np.abs(np.diff(gray, axis=2))[:, :-1], np.abs(np.diff(gray, axis=1))[:, :, :-1]
    step = np.maximum(across, down).reshape(len(gray), -1)
    high, low = rgb.max(axis=2), rgb.min(axis=2)
    levels = np.sort((rgb // 32) @ np.array([64, 8, 1]), axis=1)
    return {
        "uniformidade": np.maximum(_same_neighbours(gray, 1), _same_neighbours(gray, 2)), "chapado": (step < 2).mean(axis=1),
        "gradiente": step.mean(axis=1), "branco": (low > 235).mean(axis=1), "saturacao": (high - low).mean(axis=1),
        "cores": 1 + (np.diff(levels, axis=1) != 0).sum(axis=1),
    }


def _one_colour(gray: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Every channel holds one value."""
    return (gray == gray[:, :1]).all(axis=1) & (rgb == rgb[:, :1]).all(axis=(1, 2))


@F.pandas_udf(MEASURES)
def _measures(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = MEASURES.fieldNames()
    for width, gray, rgb in batches:
        out = pd.DataFrame({c: pd.Series([None] * len(width), dtype=object) for c in names})
        shapes = pd.DataFrame({"w": width.to_numpy(), "g": gray.map(len).to_numpy(), "c": rgb.map(len).to_numpy()})
        # Images of one shape are one array.
        for (w, pixels, sample), places in shapes.groupby(["w", "g", "c"]).indices.items():
            if not pixels or not sample:
                continue
            for rows in np.split(places, range(STACK, len(places), STACK)):
                flat = np.stack(gray.iloc[rows].to_list()).astype(np.int16)
                colours = np.stack(rgb.iloc[rows].to_list()).astype(np.int16).reshape(len(rows), -1, 3)
                found = {"uniforme": _one_colour(flat, colours)}
                if w > 0 and min(int(w), pixels // int(w)) >= 8:
                    found |= _stack_measures(flat.reshape(len(rows), -1, int(w)), colours)
                for c, values in found.items():
                    out.loc[rows, c] = values.tolist()
        yield out.astype({"cores": "Int32", "uniforme": "boolean", **{c: "float64" for c in names[:5]}})


def with_measures(rasters: DataFrame) -> DataFrame:
    """Adds the classifier's measures to rows of (largura, cinza: full-size gray pixels, rgb: 160 x 160 x 3 sample).

    Texture needs every original pixel; colour does not. A raster under eight pixels on a side has no measures but
    ``uniforme``, whether it is of one colour; one without pixels has none at all. Images of one shape are measured together.
    """
    return rasters.withColumn("__m", _measures("largura", "cinza", "rgb")).select("*", "__m.*").drop("__m", "cinza", "rgb")
