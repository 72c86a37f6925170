"""Intermediate tables and arrays in the folder that driver and executors share.

Tables go through Spark's Parquet writer.  Arrays (filters, sorted hashes, counts) are raw
files that workers memory-map: directly where the shared folder is a mounted path, and
else from a private copy that is unlinked as soon as it is mapped.  A file is written
under a name of its own attempt and then renamed, so a task that runs again, on whatever
executor, leaves the same file.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskflow.session import fresh_folder


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table once below the shared folder and read it back; cuts the lineage."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checked_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A hint to broadcast a narrow table, only if it has no more rows than that; else any join will do."""
    return F.broadcast(df) if df.count() <= rows else df


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for arrays, as a URI that every worker can open."""
    folder = fresh_folder(spark, name)
    return folder if "://" in folder else f"file://{os.path.abspath(folder.removeprefix('file:'))}"


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    files, path = _place(folder)
    files.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as out:
        out.write(np.ascontiguousarray(values).data)
    files.move(draft, f"{path}/{name}")


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    files, path = _place(folder)
    path = f"{path}/{name}"
    info = files.get_file_info(path)
    if info.size in (None, 0):
        return np.empty(0, dtype)
    if files.type_name == "local":
        return np.memmap(path, dtype, "r")
    with tempfile.NamedTemporaryFile() as copy, files.open_input_stream(path) as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype, "r")


def load_array(folder: str, name: str, dtype) -> np.ndarray:
    """Memory-map an array of the shared folder; one that was never written is empty."""
    return _mapped(folder, name, np.dtype(dtype).str)


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as byte planes of their differences, which compress well."""
    return np.ascontiguousarray(np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)
