"""Array kernels over rasters: log magnitude spectra and their radial means, a batch of rasters at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spectra(stack: np.ndarray, low: float = 1, high: float = 99) -> np.ndarray:
    """``(n, h, w)`` rasters as log magnitudes of their Fourier transforms, the zero frequency in the middle.

    Each is stretched so that its own percentiles ``low`` and ``high`` become 0
    and 1 and what lies beyond is cut; one whose percentiles are equal is all zeros.
    """
    size = np.log1p(np.abs(np.fft.fft2(stack, axes=(1, 2))))
    size = np.roll(size, (stack.shape[1] // 2, stack.shape[2] // 2), axis=(1, 2))
    ends = np.percentile(size, [low, high], axis=(1, 2), keepdims=True)
    width = ends[1] - ends[0]
    return np.where(width > 0, np.clip((size - ends[0]) / np.where(width > 0, width, 1), 0, 1), 0).astype(np.float32)


def ring_weights(height: int, width: int, bins: int = 64) -> np.ndarray:
    """A matrix that takes flat rasters to the means over rings of equal width around the middle of the raster.

    Rings are half open, so the farthest corners lie in none; an empty ring gives 0.
    """
    y, x = np.mgrid[:height, :width]
    r = np.hypot(y - (height - 1) / 2, x - (width - 1) / 2).ravel()
    ring = np.searchsorted(np.linspace(0, r.max(), bins + 1), r, side="right") - 1
    out = np.zeros((height * width, bins), np.float32)
    inside = np.flatnonzero(ring < bins)
    out[inside, ring[inside]] = 1
    return out / np.maximum(out.sum(0), 1)


def radial_features(df: DataFrame, record_id: str, raster: str, height: int, width: int, bins: int = 64) -> DataFrame:
    """``(id, radial)`` for rasters given as arrays of ``height * width`` values; null for arrays of another length or with nulls."""
    kind = df.schema[record_id].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = ring_weights(height, width, bins)
        for b in batches:
            flat = [None if v is None else np.array(v, float) for v in b.column(1).to_pylist()]
            good = [k for k, v in enumerate(flat) if v is not None and v.size == height * width and not np.isnan(v).any()]
            means = spectra(np.stack([flat[k] for k in good]).reshape(-1, height, width)).reshape(len(good), -1) @ rings if good else ()
            found = dict(zip(good, means))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([found.get(k) for k in range(b.num_rows)], pa.list_(pa.float32()))], ["id", "radial"])

    return df.select(F.col(record_id).alias("id"), F.col(raster).cast("array<double>").alias("raster")).mapInArrow(each, f"id {kind}, radial array<float>").withColumnRenamed("id", record_id)
