"""Linear reduction of vectors for clustering and for plotting."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import unit_length


def reduce_dimensions(df: DataFrame, vector: str = "embedding", k: int = 50, output: str = "reduced") -> DataFrame:
    """Add the first ``k`` principal components of the unit-length vectors (array<double>).

    The fit is one distributed pass over a d x d matrix; the driver sees d x d
    numbers, never rows. Component signs are fixed by their largest loading. Rows
    without a vector are left out.
    """
    rows = df.where(F.col(vector).isNotNull()).withColumn("_raw", array_to_vector(vector))
    vectors = unit_length(rows, "_raw", "_v").drop("_raw")
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors.select("_v"))
    loadings = model.pc.toArray()
    largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    signs = F.array(*[F.lit(float(s)) for s in np.where(largest < 0, -1.0, 1.0)])
    return model.transform(vectors).withColumn(
        output, F.zip_with(vector_to_array("_p"), signs, lambda x, s: x * s)
    ).drop("_v", "_p")


def project_2d(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add two plot coordinates per row, from the original vectors."""
    flat = reduce_dimensions(df.drop("proj_x", "proj_y"), vector, 2, "_xy")
    return flat.withColumns({"proj_x": at("_xy", 0), "proj_y": at("_xy", 1)}).drop("_xy")


def at(vector: str, i: int) -> Column:
    return F.get(F.col(vector), F.lit(i))
