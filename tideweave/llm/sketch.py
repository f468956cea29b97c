"""Fixed-size counters over all rows, summed by Spark.

Each task counts into an array of cells and emits it as compressed chunks. Chunks are summed in two steps, by (chunk,
lane) and by chunk, so that no task reads a row of every map task. The result is one array on the driver: its size is a
parameter and doesn't depend on the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

CHUNK = 1 << 16
#: Parts in which the map tasks' chunks are summed first: with a million map tasks each of both steps reads about a thousand.
LANES = 1 << 10


def chunks_of(cells: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(chunk number, compressed cells) of the chunks that aren't all zero."""
    for i in range(0, len(cells), CHUNK):
        part = cells[i : i + CHUNK]
        if part.any():
            yield i // CHUNK, zlib.compress(part.tobytes(), 1)


def summed(parts: DataFrame, size: int, dtype: str, total: str | None = None) -> np.ndarray:
    """Sum of all rows (chunk int, cells binary) as one array of `size` cells; cells of `dtype` are summed as `total`."""
    n = (size + CHUNK - 1) // CHUNK
    total = total or dtype

    def add(batches, kind):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                k, x = b.column(0)[i].as_py(), np.frombuffer(zlib.decompress(b.column(1)[i].as_py()), kind).astype(total)
                if k in held:
                    held[k] += x
                else:
                    held[k] = x.copy()
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1)], pa.binary())], ["chunk", "cells"])

    rows = parts.select("chunk", "cells").repartition("chunk", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    for by in (None, n):
        kind = dtype if by is None else total
        rows = map_arrow(rows if by is None else rows.repartition(by, "chunk"), lambda b, kind=kind: add(b, kind), "chunk int, cells binary")
    out = np.zeros(size, total)
    for r in rows.collect():
        x = np.frombuffer(zlib.decompress(r.cells), total)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(x)] += x
    return out
