"""Order-dependent decisions as a fold over sorted rows that pass through a task one by one; arrays over all rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH = 10_000
FAN_IN = 64  #: neighbouring tasks whose arrays the first level folds


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def fold_sorted(rows: DataFrame, group: list[str], order: list[str], schema: str,
                start: Callable[[], Callable[[dict], Iterable[tuple]]],
                finish: Callable[[Callable], Iterable[tuple]] | None = None) -> DataFrame:
    """The rows that a fold gives, group by group, over rows sorted by ``order``.

    ``start`` makes the fold of one group, a function of a row; what it
    returns comes out.  ``finish`` gives a fold's last rows.  Rows stream
    through sorted partitions, so a group is never held as a whole: memory is
    what the fold itself keeps.  One group stays in one task, since each
    decision needs those before it; callers cut groups as fine as they can.
    """
    out = arrow_schema(schema)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        key, fold = None, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*made)) if made else [[] for _ in out]
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)
            made.clear()
            return b

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in names]
            for values in zip(*cols):
                row = dict(zip(names, values))
                k = tuple(row[g] if not isinstance(row[g], dict) else tuple(row[g].values()) for g in group)
                if k != key:
                    if fold is not None and finish is not None:
                        made.extend(finish(fold))
                    key, fold = k, start()
                made.extend(fold(row))
                if len(made) >= BATCH:
                    yield flush()
        if fold is not None and finish is not None:
            made.extend(finish(fold))
        yield flush()

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def _unpacked(packed: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), dtype)


class Packed:
    """An array to broadcast, which comes out as the array: the driver and each executor keep it as a file, so it travels compressed."""

    def __init__(self, array: np.ndarray) -> None:
        self.array = array

    def __reduce__(self) -> tuple:
        return _unpacked, (zlib.compress(self.array.tobytes(), 1), str(self.array.dtype))


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, flat int64 values) of a list<int64> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False)
    return off - off[0], flat


def or_fold(df: DataFrame, cells: int, dtype: str, fold: str,
            add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """A fixed-size array over all rows, by partition and then by chunk.

    ``add`` updates a partition's array; the arrays are cut into 64 chunks,
    summed or or-ed chunk by chunk on the executors in two levels, first those
    of FAN_IN neighbouring tasks, and only the finished array (``cells`` items,
    whatever the input) comes to the driver.
    """
    from pyspark import TaskContext

    chunks = 64
    width = cells // chunks

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arr, seen = np.zeros(cells, dtype), False
        for b in batches:
            if b.num_rows:
                seen = True
                add(arr, b)
        if seen:
            lane = TaskContext.get().partitionId() // FAN_IN
            pieces = (arr[k * width:(k + 1) * width] for k in range(chunks))
            parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(pieces) if p.any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lane] * len(parts), pa.int32()), pa.array([k for k, _ in parts], pa.int32()), pa.array([v for _, v in parts], pa.binary())],
                names=["lane", "chunk", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column("chunk").to_pylist(), b.column("cells").to_pylist()):
                part = np.frombuffer(zlib.decompress(v), dtype)
                if k not in total:
                    total[k] = part.copy()
                elif fold == "or":
                    total[k] |= part
                elif fold == "two":  # counts that stop at two
                    total[k] = np.minimum(total[k] + part, 2).astype(dtype)
                else:
                    total[k] += part
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())],
                names=["chunk", "cells"])

    level = df.mapInArrow(partial, "lane int, chunk int, cells binary")
    level = level.repartition("lane", "chunk").mapInArrow(merge, "chunk int, cells binary")
    rows = level.repartition(8, "chunk").mapInArrow(merge, "chunk int, cells binary").collect()
    out = np.zeros(cells, dtype)
    for k, v in rows:
        out[k * width:(k + 1) * width] = np.frombuffer(zlib.decompress(bytes(v)), dtype)
    return out
