"""Array files (``.npy``) as a data source: a task reads ranges of bytes, so one large file is many tasks and many small files
are one. The folder's listing is all that planning needs; the header of a file, which tells how many values it has and where,
is read by the tasks that read the file.

Files are opened by the file systems of pyarrow. A path that those do not know (one that only Spark's readers reach) is
read whole, file by file; ``readers.read_series`` chooses.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# task functions travel with their plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 64 << 20
FILES = 1000  # most in a task
TAIL = 4 << 10  # fewer bytes do not make a range; they may be no more than the header's
ROWS = 1 << 16  # per Arrow batch


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    try:
        file_system(path)
        return True
    except (pa.ArrowException, OSError):
        return False


def _header(file) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(file)
    return np.lib.format._read_array_header(file, version) if version > (2, 0) else (
        np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    )(file)


@dataclass
class _Ranges(InputPartition):
    pieces: list[tuple[str, int, int]]  # path, first byte of the values and end; a file's values begin at 0


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "path string, idx long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[_Ranges]:
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        found, weight = [], self.range_bytes
        for path, size in sorted((f.path, f.size) for f in files if f.is_file and f.path.endswith(".npy")):
            for begin in range(0, max(1, size - TAIL), self.range_bytes):
                end = begin + self.range_bytes
                end = end if end < size - TAIL else size
                more = min(end - begin, self.range_bytes) + self.range_bytes // FILES
                if weight + more > self.range_bytes:
                    found.append(_Ranges([]))
                    weight = 0
                found[-1].pieces.append((path, begin, end))
                weight += more
        return found

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        held, size = [], 0
        for piece in part.pieces:
            for path, first, values in _values(system, *piece):
                held.append((path, first, values))
                size += len(values)
                if size >= ROWS:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)


def _values(system: fs.FileSystem, path: str, begin: int, end: int) -> Iterator[tuple[str, int, np.ndarray]]:
    """The values that begin in a range of bytes, some at a time, with the number of the first."""
    with system.open_input_file(path) as file:
        shape, columns_first, kind = _header(file)
        if kind.hasobject:
            raise ValueError(f"{path}: arrays of objects are not read")
        count = int(np.prod(shape, dtype=np.int64))
        whole = None
        first, last = (min(count, -(-byte // max(1, kind.itemsize))) for byte in (begin, end))
        if columns_first and len(shape) > 1:  # its order on disk is not the order of its values
            if begin:
                return
            file.seek(0)
            whole, last = np.load(file, allow_pickle=False).reshape(-1), count
        else:
            file.seek(file.tell() + first * kind.itemsize)
        for i in range(first, last, ROWS):
            n = min(ROWS, last - i)
            some = whole[i : i + n] if whole is not None else np.frombuffer(file.read(n * kind.itemsize), kind)
            yield path, i, some.astype("float64")


def _batch(held: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(values) for _, _, values in held]
    paths = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(held), dtype=np.int32), sizes), pa.array([path for path, _, _ in held]))
    places = np.concatenate([np.arange(first, first + n) for (_, first, _), n in zip(held, sizes)])
    return pa.RecordBatch.from_arrays(
        [paths.cast(pa.string()), pa.array(places), pa.array(np.concatenate([values for _, _, values in held]))], names=["path", "idx", "value"]
    )


def write_arrays(df, path: str) -> int:
    """One ``<series_id>.npy`` of doubles per series from ``(series_id, idx, score)`` rows, ordered by idx. Each file is one
    stream, as its format asks; the task that writes it holds one batch. A rerun writes the same files. Returns the number
    of files."""
    from pyspark.sql import functions as F

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        name, file, files = None, None, 0
        for batch in batches:
            names, sizes = batch.column("series_id").to_pylist(), batch.column("n").to_pylist()
            scores = batch.column("score").to_numpy(zero_copy_only=False).astype("<f8")
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, z in zip(cuts, [*cuts[1:], len(names)]):
                if names[a] != name:
                    if file:
                        file.close()
                    name, files = names[a], files + 1
                    file = system.open_output_stream(f"{root}/{name}.npy")
                    np.lib.format.write_array_header_1_0(file, {"descr": "<f8", "fortran_order": False, "shape": (sizes[a],)})
                file.write(scores[a:z].tobytes())
        if file:
            file.close()
        yield pa.RecordBatch.from_pydict({"files": [files]}, schema=pa.schema({"files": pa.int64()}))

    sizes = df.groupBy("series_id").agg(F.count("*").alias("n"))
    named = df.join(sizes, "series_id").select(F.col("series_id").cast("string").alias("series_id"), "idx", "score", "n")
    ordered = named.repartition("series_id").sortWithinPartitions("series_id", "idx")
    return ordered.mapInArrow(put, "files long").agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first().n
