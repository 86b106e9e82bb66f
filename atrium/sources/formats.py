"""Raster and line files as data sources of their own: ``spark.read.format("npy_pixels")`` and ``("ordered_lines")``.

Both read in parallel pieces and write in two steps: each task stages its files below
``_staging-<job>/<partition>-<attempt>`` in the target folder, and the driver moves the files of the
attempts that Spark committed, once, when all tasks have ended.  A lost or repeated attempt leaves
nothing that a reader sees; a failed job removes its staging folder.  Files are reached through
``pyarrow.fs``, so the path may lie in any store it knows, and nothing is opened by local path.

Filters are not pushed into the readers: Spark keeps the pushed filters of a Python source with the
DataFrame, where another query on it would meet them.  ``glob`` chooses files instead.

Options: ``path``; ``glob`` (names to read); ``split`` (bytes of one read partition); ``ifexists``
(``error`` refuses a folder that holds committed files); ``dtype`` of written rasters;
``extension`` of written line files.
"""

from __future__ import annotations

import fnmatch
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPLIT = 32 << 20
BLOCK = 1 << 20  # bytes that a task turns into rows at once
PIXELS = "name string, pix_row int, pix_col int, value double"
LINES = "part int, at long, line string"


def register_formats(spark: SparkSession) -> None:
    """Make the formats of this module known to the session."""
    for source in (PixelFiles, LineFiles):
        spark.dataSource.register(source)


@dataclass(frozen=True)
class Piece:
    """A share of a file: of ``count`` equal ones, the ``index``-th."""

    path: str
    part: int  # place of the file in name order
    size: int
    index: int
    count: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


@dataclass
class Staged(WriterCommitMessage):
    """Files one attempt staged: (staged path, final name)."""

    files: list[tuple[str, str]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def _visible(store: fs.FileSystem, root: str, glob: str) -> list[fs.FileInfo]:
    """Committed files below ``root`` in path order; names that begin with ``_`` or ``.`` are not data."""
    itself = store.get_file_info(root)
    if itself.is_file:
        return [itself]
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    inside = lambda f: f.path[len(root):].strip("/").split("/")
    return sorted((f for f in found if f.is_file and not any(p[:1] in "_." for p in inside(f)) and fnmatch.fnmatch(f.base_name, glob)), key=lambda f: f.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, glob: str):
        self.path, self.glob, self.split = options["path"], options.get("glob", glob), int(options.get("split", SPLIT))

    def partitions(self) -> list[Pieces]:
        """Large files are cut, small ones go together, so that each partition reads about ``split`` bytes."""
        store, root = _open(self.path)
        out, held, size = [], [], 0
        for part, f in enumerate(_visible(store, root, self.glob)):
            count = max(1, -(-f.size // self.split))
            for i in range(count):
                held.append(Piece(f.path, part, f.size, i, count))
                size += f.size // count
                if size >= self.split or len(held) >= 10_000:
                    out.append(Pieces(held))
                    held, size = [], 0
        return out + [Pieces(held)] if held else out or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        for piece in partition.pieces:
            with store.open_input_file(piece.path) as file:
                yield from self.rows(file, piece)

    def rows(self, file: pa.NativeFile, piece: Piece) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


class _Writer(DataSourceArrowWriter):
    """Tasks stage, the driver commits."""

    def __init__(self, options: dict, overwrite: bool, glob: str):
        self.path, self.overwrite, self.glob = options["path"], overwrite, glob
        self.staging = f"_staging-{uuid.uuid4().hex}"
        store, root = _open(self.path)
        if not overwrite and options.get("ifexists") == "error" and _visible(store, root, glob):
            raise FileExistsError(f"{self.path} holds files already")

    def stage(self, name: str, write) -> tuple[str, str]:
        """Write one file of this attempt; ``write`` gets the open stream."""
        store, root = _open(self.path)
        context = TaskContext.get()
        folder = f"{root}/{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            write(out)
        return f"{folder}/{name}", name

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _open(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        try:
            names = [name for _, name in files]
            if len(set(names)) < len(names):
                twice = sorted({n for n in names if names.count(n) > 1} if len(names) < 10_000 else {"?"})
                raise ValueError(f"files written twice: {twice[:5]}")
            old = _visible(store, root, self.glob)
            if not self.overwrite and (clash := {f.base_name for f in old} & set(names)):
                raise FileExistsError(f"files exist already: {sorted(clash)[:5]}")
            store.create_dir(root, recursive=True)
            if self.overwrite:
                for f in old:
                    store.delete_file(f.path)
            for staged, name in files:
                store.move(staged, f"{root}/{name}")
        finally:
            self._clear(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


# ---- rasters --------------------------------------------------------------------------------------------------


class PixelFiles(DataSource):
    """Rasters in ``.npy`` files as one row per pixel; a file is one frame and its name without folder is ``name``.

    Written rows come sorted by name, row and column, all rows of a frame in one task (see
    ``writers.write_pixel_maps``); a frame that is no full rectangle is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_pixels"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        return _PixelReader(dict(self.options), "*.npy")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PixelWriter(dict(self.options), overwrite, "*.npy")


class _PixelReader(_Reader):
    def rows(self, file, piece):
        (height, width), dtype, begin = self.header(file, piece.path)
        first, last = height * piece.index // piece.count, height * (piece.index + 1) // piece.count
        step = max(1, BLOCK // max(1, width * dtype.itemsize))
        for at in range(first, last, step):
            n = min(step, last - at)
            file.seek(begin + at * width * dtype.itemsize)
            value = np.frombuffer(file.read(n * width * dtype.itemsize), dtype).astype(np.float64)
            row, col = np.divmod(np.arange(n * width, dtype=np.int32), max(width, 1))
            name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n * width, np.int32)), pa.array([piece.path.rsplit("/", 1)[-1]])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([name, pa.array((row + at).astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(value)],
                                             names=["name", "pix_row", "pix_col", "value"])

    @staticmethod
    def header(file, path: str) -> tuple[tuple[int, int], np.dtype, int]:
        """Shape, type and first data byte; only numeric two-dimensional arrays in row order are rasters."""
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(file)
        if len(shape) != 2 or by_column or dtype.kind not in "biuf":
            raise ValueError(f"{path} is no raster: shape {shape}, type {dtype}, column order {by_column}")
        return shape, dtype, file.tell()


class _PixelWriter(_Writer):
    def __init__(self, options, overwrite, glob):
        super().__init__(options, overwrite, glob)
        self.dtype = np.dtype(options.get("dtype", "float64"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        done, held, current = [], [], None
        for batch in iterator:
            names = batch.column("name").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
            for a, b in zip(starts, [*starts[1:], len(names)]):
                if held and names[a] != current:
                    done.append(self.frame(current, held))
                    held = []
                current = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            done.append(self.frame(current, held))
        return Staged(done)

    def frame(self, name: str | None, parts: list[pa.RecordBatch]) -> tuple[str, str]:
        rows = pa.Table.from_batches(parts)
        row, col, value = (rows.column(c).to_numpy() for c in ("pix_row", "pix_col", "value"))
        height, width = (int(x.max()) + 1 for x in (row, col))
        if not name or "/" in name or not name.endswith(".npy") or not np.array_equal(row.astype(np.int64) * width + col, np.arange(height * width)):
            raise ValueError(f"frame {name!r} is no named full rectangle of sorted pixels")
        buffer = io.BytesIO()
        np.lib.format.write_array(buffer, value.astype(self.dtype).reshape(height, width), allow_pickle=False)
        return self.stage(name, lambda out: out.write(buffer.getbuffer()))


# ---- lines ----------------------------------------------------------------------------------------------------


class LineFiles(DataSource):
    """Text whose order matters, spread over part files.

    Read: the place of the file in name order, the byte at which a line begins, and the line; a line
    belongs to the piece in which it begins.  Written: the lines of each partition in one part file
    named by its number, so that the parts in name order are the text; columns other than ``line``
    are not written.
    """

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(dict(self.options), "*")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _LineWriter(dict(self.options), overwrite, "*")


class _LineReader(_Reader):
    def rows(self, file, piece):
        begin, end = piece.size * piece.index // piece.count, piece.size * (piece.index + 1) // piece.count
        at = begin
        if begin:  # a line that began before this piece is not ours, unless it ends right here
            file.seek(begin - 1)
            at = begin - 1 + self._rest(file)
        file.seek(at)
        tail = b""
        while at + len(tail) < end or tail:
            if at >= end:
                break
            block = file.read(BLOCK)
            data = tail + block
            stop = data.rfind(b"\n") + 1 if block else len(data)
            if block and not stop:
                tail = data
                continue
            lines = data[:stop].split(b"\n")
            if lines and not lines[-1]:
                lines.pop()
            starts = at + np.cumsum([0, *(len(x) + 1 for x in lines[:-1])], dtype=np.int64) if lines else np.zeros(0, np.int64)
            ours = int(np.searchsorted(starts, end))
            if ours:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(ours, piece.part, np.int32)), pa.array(starts[:ours]), pa.array([x.decode("utf-8", "replace") for x in lines[:ours]], pa.string())],
                    names=["part", "at", "line"])
            if ours < len(lines) or not block:
                break
            tail, at = data[stop:], at + stop

    @staticmethod
    def _rest(file) -> int:
        """Bytes up to and with the next line end."""
        passed = 0
        while block := file.read(1 << 16):
            found = block.find(b"\n")
            if found >= 0:
                return passed + found + 1
            passed += len(block)
        return passed


class _LineWriter(_Writer):
    def __init__(self, options, overwrite, glob):
        super().__init__(options, overwrite, glob)
        self.extension = options.get("extension", ".txt")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        batches = (b for b in iterator if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Staged([])

        def put(out) -> None:
            batch = first
            while batch is not None:
                lines = batch.column("line").to_pylist()
                out.write("".join(f"{x}\n" for x in lines if x is not None).encode())
                batch = next(batches, None)

        return Staged([self.stage(f"part-{TaskContext.get().partitionId():08d}{self.extension}", put)])
