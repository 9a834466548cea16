"""Picture planes as arrays of bytes: scaling by whole-number weights, in Arrow batches.

An axis of n samples becomes one of m by weights that sum to 2**14 for each output sample: shrinking, the share of the
output's span that an input sample covers; growing, the two nearest samples, centres aligned, edges held. Rows
come first and keep eight bits of fraction, columns second.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ONE, KEPT = 14, 8


@lru_cache(256)
def weights(n: int, m: int) -> np.ndarray:
    """An m by n matrix of whole numbers, rows summing to 2**14."""
    scale = n / m
    i, j = np.arange(m)[:, None], np.arange(n)[None, :]
    if scale > 1:
        share = np.clip(np.minimum((i + 1) * scale, j + 1) - np.maximum(i * scale, j), 0, None) / scale
        w = np.floor(share * 2**ONE + 0.5).astype(np.int64)
    else:
        at = np.clip((i + 0.5) * scale - 0.5, 0, n - 1)
        first = np.minimum(at.astype(np.int64), max(n - 2, 0))
        second = np.floor((at - first) * 2**ONE + 0.5).astype(np.int64)
        w = np.where(j == first, 2**ONE - second, 0) + np.where(j == first + 1, second, 0)
        if n == 1:
            w[:] = 2**ONE
    w[np.arange(m), w.argmax(axis=1)] += 2**ONE - w.sum(axis=1)
    return w


def scaled(planes: np.ndarray, width: int, height: int) -> np.ndarray:
    """Planes (count, rows, columns) in another size."""
    rows = (planes.astype(np.int64) @ weights(planes.shape[2], width).T + (1 << ONE - KEPT - 1)) >> ONE - KEPT
    return (weights(planes.shape[1], height) @ rows + (1 << ONE + KEPT - 1)) >> ONE + KEPT


def resize(df: DataFrame, key: str, plane: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """(key, plane array<int>) of planes of ``size`` (width, height) in size ``to``. A null plane or one of another length
    gives null."""
    (w, h), (tw, th) = size, to

    def run(batches):
        for batch in batches:
            planes = batch.column(1).to_pylist()
            good = [k for k, p in enumerate(planes) if p is not None and len(p) == w * h and None not in p]
            out: list = [None] * len(planes)
            if good:
                done = scaled(np.array([planes[k] for k in good]).reshape(-1, h, w), tw, th).reshape(len(good), -1)
                for k, p in zip(good, done.tolist()):
                    out[k] = p
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], [key, "plane"])

    return df.select(key, plane).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, plane array<int>")
