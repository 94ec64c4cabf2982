"""Vectors that can be compared: finite, not zero, of one length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """True for vectors that are not null or zero and hold neither nulls nor non-finite components."""
    finite = f"forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return F.coalesce(F.expr(f"{column} is not null and {finite} and exists({column}, x -> x <> 0)"), F.lit(False))


def matrix(column: np.ndarray) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def select_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, dim) of the usable rows with an id; vectors of different lengths are never compared.

    Single-precision components stay single until they are computed with, which halves what is shuffled.
    """
    single = dict(df.dtypes)[vec_col] == "array<float>"
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & usable("v")).withColumn("dim", F.size("v"))
    )
