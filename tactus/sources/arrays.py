"""Array files (.npy and .npz) as a data source: a row for each entry of an array's first axis.

Reading plans from sizes and headers alone: files up to `splitBytes` go several to a partition, larger ones are cut into ranges of
rows, and a task reads the bytes of its range and no others. Where so small parts would be too many for a scheduler, they are larger
(`part_bytes`). Members of an .npz that are compressed can't be cut and are a
partition each. Writing streams: a task holds a batch of rows, never a file.

    arrays.register(spark)
    spark.read.format("arrays").load("folder/*.npy")                    # path, name, at, value
    spark.read.format("arrays").option("array", "beat").load("folder/*.npz")
    arrays.save(rows, "folder", "npz")                                  # rows: file, name, at, value

value has the array's type, nested once for each further axis; unsigned types are widened, half floats become floats. Arrays of objects
are refused, for reading them would run what they hold. An array without axes is one row. Option `axes` lets the first so many axes count
rows: `at` runs over all of them, and a column `index` has the place on each. Files that keep the first axis innermost are read
too, with one such axis. Without a schema the first file decides; files that differ from it raise. With option `flat`, value
is always array<double>.
"""

from __future__ import annotations

import ast
import fnmatch
import json
import posixpath
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tactus.sources.store import store_of

FORMAT = "arrays"
#: Bytes of a partition, and of a batch of rows.
SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Partitions that are planned before parts become larger than asked for, and files of a partition.
MOST_PARTS = 400
MOST_FILES = 1024

# The files' magic number and the length of a member's local header without its names.
MAGIC = b"\x93NUMPY"
LOCAL_HEADER = 30

#: Spark's and Arrow's types of an entry by the array's kind and size.
ENTRY = {
    "b1": (T.BooleanType(), pa.bool_()), "i1": (T.ByteType(), pa.int8()), "i2": (T.ShortType(), pa.int16()), "i4": (T.IntegerType(), pa.int32()), "i8": (T.LongType(), pa.int64()),
    "u1": (T.ShortType(), pa.int16()), "u2": (T.IntegerType(), pa.int32()), "u4": (T.LongType(), pa.int64()), "u8": (T.DecimalType(20, 0), pa.decimal128(20)),
    "f2": (T.FloatType(), pa.float32()), "f4": (T.FloatType(), pa.float32()), "f8": (T.DoubleType(), pa.float64()), "U": (T.StringType(), pa.string()), "S": (T.BinaryType(), pa.binary()),
}


@dataclass(frozen=True)
class Header:
    """What precedes an array's bytes. start: where these begin, counted from the array's own beginning."""

    dtype: str
    shape: tuple[int, ...]
    columns_first: bool
    start: int
    lead: tuple[int, ...] = ()  # lengths of the axes that count rows

    def counted(self, axes: int, name: str) -> Header:
        """The first `axes` axes as one."""
        if axes > 1 and self.columns_first:
            raise ValueError(f"{name} has its first axis innermost: only that one can count rows")
        if axes > 1 and len(self.shape) < axes:
            raise ValueError(f"{name} has less than {axes} axes")
        return replace(self, shape=(int(np.prod(self.shape[:axes], dtype=np.int64)), *self.shape[axes:]), lead=self.shape[:axes]) if axes > 1 else self

    @property
    def rows(self) -> int:
        return self.shape[0] if self.shape else 1

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize

    @property
    def kind(self) -> str:
        dtype = np.dtype(self.dtype)
        return dtype.kind if dtype.kind in "US" else dtype.str[1:]


def read_header(read: Callable[[int, int], bytes], name: str) -> Header:
    """read(at, n): n bytes of the array's file from byte at on."""
    first = read(0, 12)
    if first[:6] != MAGIC:
        raise ValueError(f"{name} is no array file")
    wide = first[6] > 1
    size = struct.unpack_from("<I" if wide else "<H", first, 8)[0]
    start = (12 if wide else 10) + size
    told = ast.literal_eval(read(start - size, size).decode("utf-8" if first[6] > 2 else "latin-1"))
    if not isinstance(told["descr"], str) or Header(told["descr"], (), False, 0).kind not in ENTRY:
        raise ValueError(f"{name} has entries of {told['descr']}, which are not read")
    return Header(told["descr"], tuple(told["shape"]), bool(told["fortran_order"]), start)


def write_header(dtype: np.dtype, shape: tuple[int, ...]) -> bytes:
    text = f"{{'descr': {dtype.str!r}, 'fortran_order': False, 'shape': {shape!r}, }}".encode()
    wide = len(text) > 60_000
    size = 12 if wide else 10
    text += b" " * (-(size + len(text) + 1) % 64) + b"\n"
    return MAGIC + (bytes([2, 0]) + struct.pack("<I", len(text)) if wide else bytes([1, 0]) + struct.pack("<H", len(text))) + text


@dataclass
class Part(InputPartition):
    """Rows low to high (all with high None) of the arrays of some files; places: (uri, member or "", where its bytes begin or -1)."""

    places: list[tuple[str, str, int]]
    low: int = 0
    high: int | None = None


def listed(pattern: str, suffixes: tuple[str, ...] = (".npy", ".npz")) -> list[tuple[str, int]]:
    """(uri, size) of the files that a path names: a file, a folder with all that is in it, or a pattern of names."""
    store, root = store_of(pattern)
    lead = pattern[: len(pattern) - len(root)] if pattern.endswith(root) else ""
    fixed = root
    while any(c in fixed for c in "*?["):
        fixed = posixpath.dirname(fixed)
    info = store.get_file_info(fixed or ".")
    if info.type == pyarrow.fs.FileType.File:
        found = [info]
    elif info.type == pyarrow.fs.FileType.NotFound:
        found = []
    else:
        found = [f for f in store.get_file_info(pyarrow.fs.FileSelector(fixed or ".", recursive=True)) if f.type == pyarrow.fs.FileType.File]
        parts = root.split("/")
        if fixed != root:
            found = [f for f in found if len(p := f.path.split("/")) == len(parts) and all(map(fnmatch.fnmatchcase, p, parts))]
    plain = [f for f in found if f.path.lower().endswith(suffixes) and not f.base_name.startswith((".", "_"))]
    return sorted((lead + f.path, f.size) for f in plain)


def part_bytes(total: int, split: int) -> int:
    """Bytes of a partition: split, or what makes MOST_PARTS partitions of all files where that is more, but for that never above SPLIT_BYTES."""
    return max(split, min(SPLIT_BYTES, -(-total // MOST_PARTS)))


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, small batches put together: files of a few rows would cost a batch each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        if batch.nbytes > most:  # nothing is kept beside a whole batch
            yield batch
            continue
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def arrays_in(uri: str, file, only: tuple[str, ...] | None, axes: int = 1) -> Iterator[tuple[str, int, Header]]:
    """(member or "", where its bytes begin or -1 if it is compressed, header) of the arrays of an open file."""
    for name, begin, header in _arrays_in(uri, file, only):
        yield name, begin, header.counted(axes, f"{uri} {name}")


def _arrays_in(uri: str, file, only: tuple[str, ...] | None) -> Iterator[tuple[str, int, Header]]:
    if not uri.endswith(".npz"):
        yield "", 0, read_header(lambda at, n: file.read_at(n, at), uri)
        return
    with zipfile.ZipFile(file) as members:
        for m in members.infolist():
            name = m.filename.removesuffix(".npy")
            if only is not None and name not in only:
                continue
            if m.compress_type == zipfile.ZIP_STORED:
                local = file.read_at(LOCAL_HEADER, m.header_offset)
                begin = m.header_offset + LOCAL_HEADER + sum(struct.unpack_from("<HH", local, 26))
                yield name, begin, read_header(lambda at, n, begin=begin: file.read_at(n, begin + at), f"{uri}/{name}")
            else:
                with members.open(m) as f:
                    yield name, -1, read_header(lambda at, n, f=f: (f.seek(at), f.read(n))[1], f"{uri}/{name}")


def nested(values: np.ndarray, kind: str) -> pa.Array:
    """An Arrow list for each entry of the first axis, nested by axis."""
    arrow = ENTRY[kind][1]
    if kind == "u8":
        out = pa.array([str(v) for v in values.ravel().tolist()], pa.string()).cast(arrow)
    elif kind in "US":
        out = pa.array(values.ravel().tolist(), arrow)
    else:
        out = pa.array(np.ascontiguousarray(values, values.dtype.newbyteorder("=")).ravel().astype(arrow.to_pandas_dtype(), copy=False), arrow)
    for axis in range(values.ndim - 1, 0, -1):
        size, number = values.shape[axis], int(np.prod(values.shape[:axis], dtype=np.int64))
        out = pa.ListArray.from_arrays(pa.array(np.arange(number + 1, dtype=np.int64) * size, pa.int32()), out)
    return out


def rows_between(read: Callable[[int, int], bytes], header: Header, low: int, high: int) -> np.ndarray:
    """Rows of an array from its bytes of these rows. read counts from the first byte behind the header."""
    dtype, inner = np.dtype(header.dtype), header.shape[1:]
    if not header.columns_first or len(header.shape) < 2:
        return np.frombuffer(read(low * header.row_bytes, (high - low) * header.row_bytes), dtype).reshape(high - low, *inner)
    runs = int(np.prod(inner, dtype=np.int64))
    held = [np.frombuffer(read((k * header.rows + low) * dtype.itemsize, (high - low) * dtype.itemsize), dtype) for k in range(runs)]
    return np.concatenate(held or [np.zeros(0, dtype)]).reshape(*inner[::-1], high - low).T


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _options(self) -> tuple[str, tuple[str, ...] | None, int, bool, int]:
        o = self.options
        only = tuple(json.loads(o["arrays"])) if "arrays" in o else (o["array"],) if "array" in o else None
        return o["path"], only, int(o.get("axes", 1)), o.get("flat", "false").lower() == "true", int(o.get("splitBytes", SPLIT_BYTES))

    def schema(self) -> T.StructType:
        path, only, count, flat, _ = self._options()
        value: T.DataType = T.ArrayType(T.DoubleType())
        if not flat:
            found = listed(path)
            if not found:
                raise FileNotFoundError(f"no array files at {path}")
            store, place = store_of(found[0][0])
            with store.open_input_file(place) as f:
                kinds = {(h.kind, max(1, len(h.shape))) for _, _, h in arrays_in(found[0][0], f, only, count)}
            if len(kinds) != 1:
                raise ValueError(f"{found[0][0]} has {'several kinds of arrays' if kinds else f'no array {", ".join(only or ())}'}: name one by option array, or set option flat")
            kind, axes = kinds.pop()
            value = ENTRY[kind][0]
            for _ in range(axes - 1):
                value = T.ArrayType(value)
        index = [T.StructField("index", T.ArrayType(T.LongType()))] if count > 1 else []
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("name", T.StringType()), T.StructField("at", T.LongType()), *index, T.StructField("value", value)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrayReader(*self._options(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("array files are replaced one by one: use mode append")
        return ArrayWriter(self.options["path"], self.options.get("kind", "npy"), set(self.options.get("scalars", "").split(",")) - {""})


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, only: tuple[str, ...] | None, axes: int, flat: bool, split: int, schema: T.StructType):
        self.path, self.only, self.axes, self.flat, self.split, self.schema = path, only, axes, flat, split, schema

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        together: list[tuple[str, str, int]] = []
        held = 0
        files = listed(self.path)
        split = part_bytes(sum(size for _, size in files), self.split)
        for uri, size in files:
            if size <= split:  # its header is the task's to read
                if together and (held + size > split or len(together) == MOST_FILES):
                    parts.append(Part(together))
                    together, held = [], 0
                together.append((uri, "", 0))
                held += size
                continue
            store, place = store_of(uri)
            with store.open_input_file(place) as f:
                for member, begin, h in arrays_in(uri, f, self.only, self.axes):
                    step = h.rows if begin < 0 else max(1, split // max(1, h.row_bytes))
                    parts += [Part([(uri, member, begin)], low, min(low + step, h.rows)) for low in range(0, h.rows, step)]
        return [*parts, *([Part(together)] if together else [])] or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return gathered(self._read(part))

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for uri, member, begin in part.places:
            store, place = store_of(uri)
            with store.open_input_file(place) as f:
                if part.high is None:
                    for name, start, header in arrays_in(uri, f, self.only, self.axes):
                        yield from self._rows(f, uri, name, start, header, 0, header.rows)
                else:
                    header = next(h for _, _, h in arrays_in(uri, f, (member,) if member else None, self.axes))
                    yield from self._rows(f, uri, member, begin, header, part.low, part.high)

    def _rows(self, file, uri: str, name: str, begin: int, header: Header, low: int, high: int) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_BYTES // max(1, header.row_bytes))
        if begin >= 0:
            yield from self._batches(lambda at, n: file.read_at(n, begin + header.start + at), uri, name, header, low, high, step)
            return
        with zipfile.ZipFile(file) as members, members.open(f"{name}.npy") as f:
            if header.columns_first and len(header.shape) > 1:  # runs of all rows: the member at once
                data = f.read()
                yield from self._batches(lambda at, n: data[header.start + at : header.start + at + n], uri, name, header, low, high, step)
            else:  # from front to back, so nothing is expanded twice
                yield from self._batches(lambda at, n: (f.seek(header.start + at), f.read(n))[1], uri, name, header, low, high, step)

    def _batches(self, read, uri: str, name: str, header: Header, low: int, high: int, step: int) -> Iterator[pa.RecordBatch]:
        known = name or posixpath.basename(uri).removesuffix(".npy")
        for at in range(low, high, step):
            values = rows_between(read, header, at, min(at + step, high))
            if self.flat:
                column = nested(values.reshape(len(values), -1).astype(np.float64), "f8")
            else:
                column = nested(values, header.kind)
                wanted = self.schema["value"].dataType
                axes, inner = 1, wanted
                while isinstance(inner, T.ArrayType):
                    axes, inner = axes + 1, inner.elementType
                if inner != ENTRY[header.kind][0] or axes != max(1, len(header.shape)):
                    raise ValueError(f"{uri} {name}: {header.dtype} of {len(header.shape)} axes is not {wanted.simpleString()}")
            n = len(values)
            columns = {"path": pa.array([uri] * n), "name": pa.array([known] * n), "at": pa.array(np.arange(at, at + n))}
            if self.axes > 1:
                columns["index"] = nested(np.stack(np.unravel_index(np.arange(at, at + n), header.lead), 1).astype(np.int64), "i8")
            yield pa.RecordBatch.from_pydict(columns | {"value": column})


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Rows (file, name, at, lead, value) sorted by file, name and at, all of a file in one task. scalars: names of arrays whose rows hold one entry."""

    def __init__(self, folder: str, kind: str, scalars: set[str]):
        if kind not in ("npy", "npz"):
            raise ValueError(f"array files are npy or npz, not {kind}")
        self.folder, self.kind, self.scalars = folder, kind, scalars

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = store_of(self.folder)
        files: list[str] = []
        open_file: OpenFile | None = None
        try:
            for batch in batches:
                names = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "name")]
                keys = list(zip(*names, strict=True))
                low = 0
                while low < len(keys):
                    high = low + 1
                    while high < len(keys) and keys[high] == keys[low]:
                        high += 1
                    if open_file is None or open_file.name != keys[low][0]:
                        if open_file is not None:
                            files.append(open_file.close())
                        store.create_dir(root, recursive=True)  # only for something
                        open_file = OpenFile(store, root, keys[low][0], self.kind, self.scalars)
                    open_file.add(keys[low][1], batch.slice(low, high - low))
                    low = high
            if open_file is not None:
                files.append(open_file.close())
        except BaseException:
            if open_file is not None:
                open_file.drop()
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Every file is there already, whole, under its own name."""


class OpenFile:
    """One file being written under a temporary name."""

    def __init__(self, store: pyarrow.fs.FileSystem, root: str, name: str, kind: str, scalars: set[str]):
        self.store, self.name, self.path, self.scalars = store, name, f"{root}/{name}", scalars
        self.temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.stream = store.open_output_stream(self.temporary)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED) if kind == "npz" else None
        self.out = None if self.zip else self.stream
        self.array: str | None = None
        self.rows = self.expected = 0
        self.inner: tuple[int, ...] = ()

    def add(self, array: str, batch: pa.RecordBatch) -> None:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        values, inner = _stacked(column("value"), f"{self.name} {array}")
        if array in self.scalars and inner == (1,):
            values, inner = values[:, 0], ()
        if array != self.array:
            self._end()
            lead = column("lead")[0].as_py()
            self.array, self.rows, self.expected, self.inner = array, 0, int(np.prod(lead, dtype=np.int64)), inner
            if self.zip:
                self.out = self.zip.open(zipfile.ZipInfo(f"{array}.npy"), "w", force_zip64=True)
            self.dtype = values.dtype.newbyteorder("<")
            self.out.write(write_header(self.dtype, (*lead, *inner)))
        at = column("at").to_numpy()
        if inner != self.inner or not np.array_equal(at, np.arange(self.rows, self.rows + len(at))):
            raise ValueError(f"{self.name} {array}: rows are of several shapes, or don't count from 0 on without gaps")
        self.rows += len(at)
        self.out.write(np.ascontiguousarray(values, self.dtype).tobytes())

    def _end(self) -> None:
        if self.array is None:
            return
        if self.rows != self.expected:
            raise ValueError(f"{self.name} {self.array}: {self.rows} rows of {self.expected}")
        if self.zip:
            self.out.close()

    def close(self) -> str:
        self._end()
        if self.zip:
            self.zip.close()
        self.stream.close()
        self.store.move(self.temporary, self.path)
        return self.path

    def drop(self) -> None:
        self.stream.close()
        self.store.delete_file(self.temporary)


def _stacked(values: pa.Array, name: str) -> tuple[np.ndarray, tuple[int, ...]]:
    """Values as one array, and the shape of each."""
    inner: list[int] = []
    n = len(values)
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        sizes = values.value_lengths().to_numpy(zero_copy_only=False)
        if values.null_count or (len(sizes) and (sizes != sizes[0]).any()):
            raise ValueError(f"{name}: rows are of several shapes, or null")
        inner.append(int(sizes[0]) if len(sizes) else 0)
        values = values.flatten()
    if values.null_count:
        raise ValueError(f"{name}: an entry is null")
    if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
        raise ValueError(f"{name}: texts are not written")
    return values.to_numpy(zero_copy_only=False).reshape(n, *inner), tuple(inner)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrayFiles)


def read(spark: SparkSession, path: str, array: str | tuple[str, ...] | None = None, axes: int = 1, flat: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, name, at, value) of the array files at path, with more axes than one also index; array: the member or members of .npz files that are read."""
    register(spark)
    reader = spark.read.format(FORMAT).option("flat", str(flat).lower()).option("splitBytes", split_bytes).option("axes", axes)
    return (reader if array is None else reader.option("array", array) if isinstance(array, str) else reader.option("arrays", json.dumps(array))).load(path)


def save(rows: DataFrame, folder: str, kind: str = "npy", scalars: tuple[str, ...] = ()) -> None:
    """rows (file, at, value, for .npz name, perhaps lead) -> <folder>/<file>, whole or not at all. at counts an array's rows from 0.

    lead: the lengths of the axes that at runs over, where it is more than one. scalars: names of arrays whose rows are arrays of
    one entry and are written without that axis. A file is written in one task, in order; files are the parallelism. Without rows
    nothing is made, not even the folder.
    """
    register(rows.sparkSession)
    named = rows if kind == "npz" else rows.withColumn("name", F.lit(""))
    own = F.col("lead") if "lead" in rows.columns else F.lit(None).cast("array<bigint>")
    counted = named.repartition("file").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("file", "name")))
    lead = F.coalesce(own.cast("array<bigint>"), F.array("_n")).alias("lead")
    ordered = counted.select("file", "name", F.col("at").cast("long").alias("at"), lead, "value").sortWithinPartitions("file", "name", "at")
    ordered.write.format(FORMAT).option("kind", kind).option("scalars", ",".join(scalars)).mode("append").save(folder)
