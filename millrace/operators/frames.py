"""Raw grey frames to hashes and grids. Where the engine begins: pixels come from an outside decoder as binary rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

HEIGHT, WIDTH = 160, 288
HASH_GRID, FINE_GRID = (8, 9), (20, 36)


def box_means(pixels: np.ndarray, grid: tuple[int, int]) -> np.ndarray:
    """Means of equal boxes: (n, height, width) to (n, rows, columns); the grid must divide the frame."""
    n, height, width = pixels.shape
    rows, columns = grid
    if height % rows or width % columns:
        raise ValueError("the grid does not divide the frame")
    return pixels.reshape(n, rows, height // rows, columns, width // columns).mean(axis=(2, 4), dtype=np.float64)


def gradient_hashes(pixels: np.ndarray) -> np.ndarray:
    """64 bits of each frame, the highest first: is a box brighter than its right neighbour?"""
    means = box_means(pixels, HASH_GRID)
    bits = (means[:, :, :-1] > means[:, :, 1:]).reshape(len(pixels), 64)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def hashed(frames: DataFrame, pixels: str = "px", height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """``frames`` without pixels, with dhash (bigint, the same 64 bits), dhash_hex and fine (720 means). Null pixels give nulls."""
    kept = [c for c in frames.columns if c != pixels]
    from pyspark.sql import types as T

    schema = T.StructType([*frames.select(*kept).schema.fields, *T._parse_datatype_string("dhash bigint, dhash_hex string, fine array<float>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):  # 64 frames are about 3 MB
                part = batch.slice(start, 64)
                raw = part.column(pixels).to_pylist()
                there = [i for i, x in enumerate(raw) if x is not None]
                grid = np.stack([np.frombuffer(raw[i], np.uint8).reshape(height, width) for i in there]) if there else np.zeros((0, height, width), np.uint8)
                h, fine = gradient_hashes(grid), box_means(grid, FINE_GRID).astype(np.float32).reshape(len(there), FINE_GRID[0] * FINE_GRID[1])
                out = {i: (int(h[k].view(np.int64)), f"{int(h[k]):016x}", fine[k].tolist()) for k, i in enumerate(there)}
                made = [out.get(i, (None, None, None)) for i in range(len(raw))]
                arrays = [pa.array([m[j] for m in made], t) for j, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.float32())))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *arrays], names=[*kept, "dhash", "dhash_hex", "fine"])

    return frames.mapInArrow(run, schema)
