"""Dense matrices in NumPy archives, read as rows of vectors and written from them."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read_npz(spark: SparkSession, path: str, name: str | None = None, rows_a_batch: int = 1024) -> DataFrame:
    """(path, row, vector): the rows of one matrix of each archive at ``path``; the only one where no ``name`` is given.

    Archives are spread over the cluster, one archive a task.  A vector of one dimension is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    if name is None and len(archive.files) != 1:
                        raise ValueError(f"{at} holds {archive.files}: name one")
                    key = name or archive.files[0]
                    if key not in archive.files:
                        raise KeyError(f"{at} has no array {key}")
                    matrix = np.atleast_2d(archive[key]).astype(np.float32)
                for lo in range(0, len(matrix), rows_a_batch):
                    part = matrix[lo : lo + rows_a_batch]
                    ends = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at] * len(part)), pa.array(np.arange(lo, lo + len(part), dtype=np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(part.ravel()))],
                        names=["path", "row", "vector"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row long, vector array<float>")


def write_npz(df: DataFrame, path: str, vector: str, order: list[str], name: str = "values", most: int = 64_000_000) -> tuple[int, int]:
    """Writes one matrix, rows in ``order``, compressed; its shape.  Raises where it has more than ``most`` numbers.

    An archive is one matrix in one file; larger ones stay Parquet tables of vectors.
    """
    n = df.count()
    width = len(df.select(vector).first()[0]) if n else 0
    if n * width > most:
        raise ValueError(f"{n} x {width} numbers are too many for one archive")
    rows = [r[0] for r in df.orderBy(*order).select(vector).toLocalIterator()]
    matrix = np.array(rows, np.float32).reshape(n, width)
    np.savez_compressed(path, **{name: matrix})
    return matrix.shape


def write_split_pickle(parts: dict[str, list[str]], path: str) -> None:
    """A split as a dictionary of part and conditions, the form graph models read."""
    with open(path, "wb") as f:
        pickle.dump({p: sorted(parts.get(p, [])) for p in ("train", "val", "test")}, f)
