"""NumPy array files as DataFrames, read and written by byte ranges.

A dataset is a folder with Adj_src.npy (rows, columns, then the receiver of each
edge), Adj_dst.npy (the sender of each edge), Feat.npy, Lab.npy and the masks
TnMsk.npy, VlMsk.npy and TsMsk.npy.

An array's entries have one width, so a file's head, read once, tells where each
row stands.  The reader's partitions are ranges of rows of some ``SPLIT`` bytes,
at least one a core; files of one length (both ends of the edges, the three
masks) are read side by side by one partition, so nothing is joined by place.
The writer sets the file's length first; then each task writes its rows at their
place, and a task that runs again writes the same bytes there.

Reading goes through the file system that the path names; writing at a place
needs one that can, so the writer takes paths of mounted folders only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from numpy.lib import format as head
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.graph import Graph, with_self_loops
from tessera.operators import adjacency, subgraphs

#: Bytes of a partition.
SPLIT = 32 << 20
#: Bytes of a record batch.
BATCH = 1 << 20

KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "vector": pa.list_(pa.float64())}
SQL = {"long": "long", "int": "int", "double": "double", "boolean": "boolean", "vector": "array<double>"}


class NpyError(ValueError):
    """The file is not one that can be read, or files do not fit together."""


def _local(path: str) -> str | None:
    """The path on a mounted folder, or None."""
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return re.sub(r"^file:/+", "/", path) if path.startswith("file:") else None
    return path


def _open(path: str):
    mounted = _local(path)
    if mounted is not None:
        return pa.OSFile(mounted)
    fs, rest = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(rest)


@dataclass(frozen=True)
class Array:
    """What a file's head says: entry type, shape, order, and where entries begin."""

    path: str
    dtype: str
    shape: tuple[int, ...]
    fortran: bool
    begin: int

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) if self.shape else 1

    def read(self, file, low: int, high: int) -> np.ndarray:
        """Rows low .. high - 1, flat, row by row."""
        size = np.dtype(self.dtype).itemsize
        if not self.fortran or self.width == 1:
            file.seek(self.begin + low * self.width * size)
            return np.frombuffer(file.read((high - low) * self.width * size), self.dtype)
        columns = []  # each column's entries stand together
        for j in range(self.width):
            file.seek(self.begin + (j * self.rows + low) * size)
            columns.append(np.frombuffer(file.read((high - low) * size), self.dtype))
        return np.stack(columns, 1).ravel()


def array(path: str) -> Array:
    """The head of a file."""
    with _open(path) as f:
        try:
            version = head.read_magic(f)
            shape, fortran, dtype = (head.read_array_header_1_0 if version == (1, 0) else head.read_array_header_2_0)(f)
        except ValueError as e:
            raise NpyError(f"{path}: {e}") from e
        if dtype.kind not in "biuf":
            raise NpyError(f"{path}: entries of type {dtype} are not numbers")
        if fortran and len(shape) > 2:
            raise NpyError(f"{path}: more than two dimensions by columns")
        return Array(path, dtype.str, shape, fortran, f.tell())


@dataclass
class Rows(InputPartition):
    low: int
    high: int

    def __post_init__(self):
        super().__init__((self.low, self.high))


class NpySource(DataSource):
    """Options: ``columns``, a JSON list of {name, path, skip, kind}; ``split``
    bytes a partition; ``least`` partitions, if there are as many rows."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _columns(self) -> list[dict]:
        return json.loads(self.options["columns"])

    def schema(self) -> str:
        return ", ".join(["i long", *(f"{c['name']} {SQL[c['kind']]}" for c in self._columns())])

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self._columns(), int(self.options.get("split", SPLIT)), int(self.options.get("least", 1)))


class NpyReader(DataSourceReader):
    def __init__(self, columns: list[dict], split: int, least: int):
        self.columns, self.split, self.least = columns, split, least
        self.arrays = [array(c["path"]) for c in columns]
        flat = [a.rows * a.width if c["kind"] != "vector" else a.rows for c, a in zip(columns, self.arrays, strict=True)]
        lengths = {n - c["skip"] for n, c in zip(flat, columns, strict=True)}
        if len(lengths) != 1 or min(lengths) < 0:
            raise NpyError(f"arrays of different lengths: {[(a.path, a.shape) for a in self.arrays]}")
        self.rows = lengths.pop()

    def _bytes(self) -> int:
        """Bytes of a row of all files together."""
        return sum(np.dtype(a.dtype).itemsize * (a.width if c["kind"] == "vector" else 1) for c, a in zip(self.columns, self.arrays, strict=True))

    def partitions(self) -> list[Rows]:
        each = max(1, min(self.split // max(1, self._bytes()), -(-self.rows // self.least)))
        return [Rows(low, min(low + each, self.rows)) for low in range(0, self.rows, each)] or [Rows(0, 0)]

    def _column(self, c: dict, a: Array, file, low: int, high: int) -> pa.Array:
        low, high = low + c["skip"], high + c["skip"]
        if c["kind"] == "vector":
            x = a.read(file, low, high).astype(np.float64)
            places = np.arange(high - low + 1, dtype=np.int32) * a.width
            return pa.ListArray.from_arrays(pa.array(places), pa.array(x))
        if a.width > 1:  # entries of a matrix, row by row
            first = low // a.width
            x = a.read(file, first, -(-high // a.width))[low - first * a.width : high - first * a.width]
        else:
            x = a.read(file, low, high)
        return pa.array(x != 0) if c["kind"] == "boolean" else pa.array(x.astype(KINDS[c["kind"]].to_pandas_dtype()))

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH // max(1, self._bytes()))
        names = ["i", *(c["name"] for c in self.columns)]
        files = [_open(a.path) for a in self.arrays]
        try:
            for low in range(partition.low, partition.high, step):
                high = min(low + step, partition.high)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high)), *(self._column(c, a, f, low, high) for c, a, f in zip(self.columns, self.arrays, files, strict=True))], names=names)
        finally:
            for f in files:
                f.close()


def columns(spark: SparkSession, split: int = SPLIT, **files: tuple[str, str] | tuple[str, str, int]) -> DataFrame:
    """(i, name...) of files of one length: name=(path, kind[, entries to skip])."""
    if not getattr(spark, "_tessera_npy", False):
        spark.dataSource.register(NpySource)
        spark._tessera_npy = True
    listed = [{"name": n, "path": f[0], "kind": f[1], "skip": f[2] if len(f) > 2 else 0} for n, f in files.items()]
    return spark.read.format("npy").option("columns", json.dumps(listed)).option("split", split).option("least", spark.sparkContext.defaultParallelism).load()


def values(spark: SparkSession, path: str) -> DataFrame:
    """(i LONG, x DOUBLE) of a file, flattened."""
    return columns(spark, x=(path, "double"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vec) of a two-dimensional file, a row each."""
    return columns(spark, vec=(path, "vector")).withColumnRenamed("i", "id")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """(dst, src); the first two entries of Adj_src.npy are the matrix's size."""
    return columns(spark, dst=(f"{folder}/Adj_src.npy", "long", 2), src=(f"{folder}/Adj_dst.npy", "long")).select("dst", "src")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return columns(spark, label=(f"{folder}/Lab.npy", "int")).withColumnRenamed("i", "id")


def masks(spark: SparkSession, folder: str) -> DataFrame:
    """(id, train, valid, test)."""
    files = {name: (f"{folder}/{file}.npy", "boolean") for name, file in (("train", "TnMsk"), ("valid", "VlMsk"), ("test", "TsMsk"))}
    return columns(spark, **files).withColumnRenamed("i", "id")


def load(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame, DataFrame, DataFrame]:
    """Graph, features, labels and masks of a folder."""
    return Graph(edges(spark, folder)), vectors(spark, f"{folder}/Feat.npy"), labels(spark, folder), masks(spark, folder)


def begin(path: str, dtype: str, shape: tuple[int, ...]) -> int:
    """Makes a file of the array's full length, with its head; where entries begin."""
    mounted = _local(path)
    if mounted is None:
        raise NpyError(f"{path}: arrays are written in place, which needs a mounted folder")
    os.makedirs(os.path.dirname(mounted) or ".", exist_ok=True)
    with open(mounted, "wb") as f:
        head.write_array_header_1_0(f, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": shape})
        start = f.tell()
        f.truncate(start + int(np.prod(shape, dtype=np.int64)) * np.dtype(dtype).itemsize)
    return start


def put(fd: int, data: bytes, at: int) -> None:
    while data:
        done = os.pwrite(fd, data, at)
        data, at = data[done:], at + done


def write(df: DataFrame, path: str, dtype: str, n: int, width: int | None = None) -> None:
    """Writes (i, x): value or vector x of row i, for every i < n, as an array of
    n entries, or of n rows of ``width``."""
    size = np.dtype(dtype).itemsize * (width or 1)
    start, mounted = begin(path, dtype, (n,) if width is None else (n, width)), _local(path)

    def run(batches):
        fd = os.open(mounted, os.O_WRONLY)
        try:
            for batch in batches:
                places, x = batch.columns
                places = places.to_numpy().astype(np.int64)
                if pa.types.is_list(x.type):
                    if len(x) and set(np.diff(x.offsets.to_numpy())) != {width}:
                        raise NpyError(f"{path}: vectors of other widths than {width}")
                    x = x.flatten()
                raw = x.to_numpy(zero_copy_only=False).astype(dtype).tobytes()
                cuts = np.flatnonzero(np.diff(places) != 1) + 1
                for low, high in zip([0, *cuts], [*cuts, len(places)], strict=True):
                    if high > low:
                        put(fd, raw[low * size : high * size], start + int(places[low]) * size)
                yield pa.RecordBatch.from_arrays([pa.array([len(places)], pa.int64())], names=["n"])
        finally:
            os.close(fd)

    each = df.select(F.col("i").cast("long"), "x").repartitionByRange("i").sortWithinPartitions("i")
    done = each.mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first().n or 0
    if done != n:
        raise NpyError(f"{path}: {done} rows written of {n}")


def write_edges(edges: DataFrame, folder: str, n: int) -> None:
    """Adj_src.npy and Adj_dst.npy in order of (dst, src).  Adjacency rows, whose
    places are sums of counts, are the runs that tasks write: no edge is sorted
    into one order."""
    total = edges.count()
    heads = [(f"{folder}/{name}.npy", skip) for name, skip in (("Adj_src", 2), ("Adj_dst", 0))]
    starts = [begin(path, "uint32", (total + skip,)) for path, skip in heads]
    paths = [_local(path) for path, _ in heads]
    with open(paths[0], "r+b") as f:
        f.seek(starts[0])
        f.write(np.array([n, n], np.uint32).tobytes())

    def run(batches):
        fds = [os.open(p, os.O_WRONLY) for p in paths]
        try:
            for batch in batches:
                done = 0
                for at, dst, senders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    ids = senders.values.to_numpy().astype(np.uint32)
                    put(fds[0], np.full(len(ids), dst, np.uint32).tobytes(), starts[0] + 4 * (at + 2))
                    put(fds[1], ids.tobytes(), starts[1] + 4 * at)
                    done += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])
        finally:
            for fd in fds:
                os.close(fd)

    placed = adjacency.rows(edges.select("dst", "src")).join(adjacency.offsets(edges).select("dst", "begin"), "dst").select((F.col("begin") + F.col("first")).alias("at"), "dst", "senders")
    done = placed.mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first().n or 0
    if done != total:
        raise NpyError(f"{folder}: {done} edges written of {total}")


def export(graph: Graph, features: DataFrame, labels: DataFrame, masks: DataFrame | None, folder: str, seed: int = 0) -> None:
    """Writes a dataset folder.  Nodes are 0 .. n - 1; loops are taken out and one
    put at each node; without masks 70 % of the nodes train, 15 % validate and
    the rest test, drawn without a remainder."""
    ids = features.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.size("vec")).alias("width")).first()
    n, width = ids.n, ids.width or 0
    if n and (ids.low, ids.high) != (0, n - 1):
        raise NpyError(f"nodes are {ids.low} .. {ids.high}, {n} of them: number them first (subgraphs.renumbered)")
    write_edges(with_self_loops(graph.edges, features.select("id")), folder, n)
    write(features.select(F.col("id").alias("i"), F.col("vec").alias("x")), f"{folder}/Feat.npy", "float32", n, width)
    write(labels.select(F.col("id").alias("i"), F.col("label").cast("long").alias("x")), f"{folder}/Lab.npy", "int64", n, 1)
    masks = subgraphs.exact_masks(features, seed) if masks is None else masks
    for name, file in (("train", "TnMsk"), ("valid", "VlMsk"), ("test", "TsMsk")):
        write(masks.select(F.col("id").alias("i"), F.col(name).cast("int").alias("x")), f"{folder}/{file}.npy", "int32", n, 1)
