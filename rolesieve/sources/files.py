"""Reading raw text files, those without bytes and those that cannot be read included."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rolesieve.operators.tables import parse_bytes

FILE = "path string, size long, content binary, error string"


@dataclass
class Files(InputPartition):
    """Paths and sizes that one task reads."""

    files: list[tuple[str, int]]


class RawFiles(DataSource):
    """``spark.read.format("raw_files").load(path)``: a row for each file below a folder (or the file itself).

    Spark's own readers leave out files of no bytes before anything can see them; this one lists the
    folder itself, through pyarrow, so local and mounted folders and the stores that pyarrow knows can be read.
    Files are dealt to tasks by size: ``task_bytes`` (32 MB) and ``task_files`` (2,000) at most, one file at least.  A file
    that cannot be read gives a row with its error and no content.  Names that begin with . or _ are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_files"

    def schema(self) -> str:
        return FILE

    def reader(self, schema) -> DataSourceReader:
        return RawFilesReader(self.options)


class RawFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most_bytes = int(options.get("task_bytes", 32 << 20))
        self.most_files = int(options.get("task_files", 2_000))

    def _store(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, path = self._store()
        top = store.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        every = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        below = lambda f: f.path[len(path) :].strip("/").split("/") if f.path != path else []
        return sorted((f.path, f.size or 0) for f in every if f.type != fs.FileType.Directory and not any(p[:1] in "._" for p in below(f)))

    def partitions(self) -> list[Files]:
        out, held, size = [], [], 0
        for path, n in self.listed():
            if held and (size + n > self.most_bytes or len(held) >= self.most_files):
                out.append(Files(held))
                held, size = [], 0
            held.append((path, n))
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        types = [pa.string(), pa.int64(), pa.binary(), pa.string()]
        for path, size in partition.files:
            content = error = None
            try:
                with store.open_input_stream(path) as f:
                    content = f.read()
            except OSError as e:
                error = str(e) or type(e).__name__
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((path, size if content is None else len(content), content, error), types)], names=[c.split()[0] for c in FILE.split(", ")])


def read_raw_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, size, content, error) of the files below ``path``."""
    spark.dataSource.register(RawFiles)
    return spark.read.format("raw_files").options(**options).load(path)


def read_text_files(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(texts, rejects) of the files below ``path``: path, text, page; and path, reason.

    Bytes that are no UTF-8 are left out, a text is one page.  Files without bytes, without text or that cannot be
    read are rejects.  Each of the two reads the files when it is used.
    """
    return parse_bytes(read_raw_files(spark, path, **options))
