"""HTML tables as a Spark data source: spark.read.format("html_table").load(path), a partition for each file.

A file that cannot be read as the one table of so many columns gives no rows of data: with mode=failfast it ends the read
with the file's name, with mode=permissive it gives a single row whose columns are null but for _erro. Files are read and
written in pieces, so that a task holds no more than some thousand rows of a file of any length.
"""

from __future__ import annotations

import codecs
import gzip
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from .ledger import COLUMNS, MISSING, HtmlRows

#: Added to the schema: the file of a row, and why a file gave none.
FILE, ERROR = "_arquivo", "_erro"
#: Bytes of a file that are parsed at once.
PIECE = 1 << 20
_MISSING = frozenset(MISSING)


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), posixpath.abspath(path))


class _File(InputPartition):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = [n for n in schema.names if n not in (FILE, ERROR)]
        self.all, self.root, self.mode = schema.names, options.get("path"), options.get("mode", "failfast").lower()
        self.encoding = options.get("encoding", "utf-8")
        if not self.root:
            raise ValueError("html_table needs a path")
        if self.mode not in ("failfast", "permissive"):
            raise ValueError(f"mode is failfast or permissive, not {self.mode}")

    def partitions(self) -> list[InputPartition]:
        """One for each file, by name: the listing alone runs in the driver. Hidden files are left out."""
        system, root = _filesystem(self.root)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))
        return [_File(*f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _File):  # a folder without files
            return
        try:
            if self.mode == "permissive":  # rows leave only once the whole file is known to be good
                for _ in self._pieces(partition):
                    pass
            for rows in self._pieces(partition):
                columns = [[None if c in _MISSING else c for c in column] for column in zip(*rows, strict=True)]
                yield self._batch(partition, columns, None)
        except (ValueError, OSError) as error:
            if self.mode == "failfast":
                raise ValueError(f"{partition.path}: {error}") from error
            yield self._batch(partition, [[None] for _ in self.names], str(error))

    def _pieces(self, partition: _File) -> Iterator[list]:
        """The rows of a file, some at a time."""
        system, _ = _filesystem(self.root)
        rows, decoder = HtmlRows(len(self.names)), codecs.getincrementaldecoder(self.encoding)()
        with system.open_input_stream(partition.path) as stream:
            while piece := stream.read(PIECE):
                if found := rows.feed(decoder.decode(piece)):
                    yield found
        if found := rows.feed(decoder.decode(b"", final=True), last=True):
            yield found

    def _batch(self, partition: _File, columns: list[list], why: str | None) -> pa.RecordBatch:
        n = len(columns[0])
        every = dict(zip(self.names, columns, strict=True)) | {FILE: [posixpath.basename(partition.path)] * n, ERROR: [why] * n}
        return pa.RecordBatch.from_arrays([pa.array(every[c], pa.string()) for c in self.all], names=self.all)


class _Written(WriterCommitMessage):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows


def _cells(column: pa.Array) -> pa.Array:
    """A column as escaped text, null as nothing."""
    if not pa.types.is_string(column.type):
        column = pa.array([None if v is None else str(v) for v in column.to_pylist()], pa.string())
    if pc.any(pc.match_substring_regex(column, "[&<>\"']")).as_py():
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            column = pc.replace_substring(column, sign, name)
    return pc.fill_null(column, "")


class _Writer(DataSourceArrowWriter):
    """A file for each partition, under a name of its own; those of attempts that do not count are taken away."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.root, self.compression = schema.names, options["path"], options.get("compression", "none").lower()
        if self.compression not in ("none", "gzip"):
            raise ValueError(f"compression is none or gzip, not {self.compression}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from html import escape
        from uuid import uuid4

        system, root = _filesystem(self.root)
        system.create_dir(root, recursive=True)
        packed = self.compression == "gzip"
        path, n = f"{root}/part-{uuid4().hex}.html{'.gz' if packed else ''}", 0
        with system.open_output_stream(path, compression=None) as stream:
            out = gzip.GzipFile(fileobj=stream, mode="wb", compresslevel=1) if packed else stream
            out.write(("<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in self.names) + "</tr>\n").encode())
            for batch in batches:
                if batch.num_rows:
                    between = [x for column in batch.columns for x in ("</td><td>", _cells(column))][1:]
                    rows = pc.binary_join_element_wise("<tr><td>", *between, "</td></tr>\n", "")
                    out.write("".join(rows.to_pylist()).encode())
                    n += batch.num_rows
            out.write(b"</table>\n")
            if packed:
                out.close()
        return _Written(path, n)

    def commit(self, messages: list) -> None:
        return None

    def abort(self, messages: list) -> None:
        system, _ = _filesystem(self.root)
        for message in messages:
            if message is not None:
                system.delete_file(message.path)


class HtmlTable(DataSource):
    """Options: path (a file or a folder in any file system that Arrow knows), mode, encoding; for writing compression.

    All columns are strings. Files named .gz are read as such.
    """

    @classmethod
    def name(cls) -> str:
        return "html_table"

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in (*COLUMNS, FILE, ERROR)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("html_table appends; it takes nothing away")
        return _Writer(schema, dict(self.options))


def read_tables(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The tables under path by the data source, which this registers."""
    spark.dataSource.register(HtmlTable)
    return spark.read.format("html_table").options(**options).load(path)


def write_tables(df: DataFrame, path: str, **options: str) -> None:
    """df as HTML tables under path, a file for each partition; compression is none or gzip."""
    df.sparkSession.dataSource.register(HtmlTable)
    df.write.format("html_table").options(**options).mode("append").save(path)
