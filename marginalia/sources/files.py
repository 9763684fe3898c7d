"""Files as pages, in batch and as a stream, and reports as files: data sources of Spark, registered by register().

    spark.read.format("paged_files").option("path", folder).option("suffix", ".txt").load()
    spark.readStream.format("paged_files").option("path", folder).load()
    reports.write.format("report_files").option("path", folder).option("suffix", ".md").mode("append").save()

The reader makes one partition of each file, so a file that is refused or breaks its decoder is a quarantine row and ends nothing else. The decoder is an
adapter, `module:function`, from bytes to the texts of pages; the default takes UTF-8 with form feeds between pages. The writer puts each report into a temporary
file of its own and moves all of them to their stems when every task has succeeded; what a failed job wrote is removed.
Paths are those of pyarrow's file systems.
"""

from __future__ import annotations

import importlib
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

PAGES = "path string, page_no int, text string, size_bytes long, error_code string"
MAX_MB = 25


def plain_pages(content: bytes) -> list[str]:
    return content.decode("utf-8").split("\f")


def filesystem(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


@dataclass
class FilePartition(InputPartition):
    path: str


class _Files:
    """What both readers share."""

    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", "").lower()
        self.decoder, self.most = options.get("decoder", ""), float(options.get("max_mb", MAX_MB)) * 1024 * 1024

    def listed(self) -> list[tuple[str, int, str]]:
        """(modified, in nanoseconds; path) of every file, in that order."""
        from pyarrow import fs

        store, root = filesystem(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        store, _ = filesystem(self.root)
        path, size = partition.path, None
        try:
            size = store.get_file_info([path])[0].size
            error = "no_file" if not size else "invalid_type" if not path.lower().endswith(self.suffix) else "too_large" if size > self.most else None
            if error is None:
                module, _, name = self.decoder.partition(":")
                decode = getattr(importlib.import_module(module), name) if name else plain_pages
                with store.open_input_stream(path) as stream:
                    pages = decode(stream.read())
                error = None if pages else "empty"
        except Exception:  # one file must not end the job
            error = "corrupt"
        if error is None:
            yield from ((path, i, text, size, None) for i, text in enumerate(pages, 1))
        else:
            yield (path, None, None, size, error)


class PagedFileReader(_Files, DataSourceReader):
    def partitions(self) -> list[FilePartition]:
        return [FilePartition(path) for _, path in self.listed()]


class PagedFileStream(_Files, DataSourceStreamReader):
    """An offset is the newest file taken; files that come later with an older time are found by the next full read, not by the stream."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.listed()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return [FilePartition(path) for time, path in self.listed() if low < (time, path) <= high]

    def commit(self, end: dict) -> None:
        pass


class PagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> PagedFileReader:
        return PagedFileReader(self.options)

    def streamReader(self, schema) -> PagedFileStream:
        return PagedFileStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class ReportWriter(DataSourceWriter):
    """Rows (stem, body): one file for each stem; of rows with the same stem the ones behind the first get `-2`, `-3` and so on by what is there."""

    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", ".md")
        self.job = uuid.uuid4().hex

    def temporary(self, root: str) -> str:
        return f"{root}/_writing-{self.job}"

    def write(self, rows: Iterator) -> Written:
        store, root = filesystem(self.root)
        store.create_dir(self.temporary(root), recursive=True)
        moves = []
        for row in rows:
            place = f"{self.temporary(root)}/{uuid.uuid4().hex}"
            with store.open_output_stream(place) as out:
                out.write(row["body"].encode())
            moves.append((place, row["stem"]))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = filesystem(self.root)
        store.create_dir(root, recursive=True)
        taken = {f.base_name for f in store.get_file_info(fs.FileSelector(root))}
        for place, stem in sorted((m for x in messages if x for m in x.moves), key=lambda m: (m[1], m[0])):
            name, n = f"{stem}{self.suffix}", 1
            while name in taken:
                n += 1
                name = f"{stem}-{n}{self.suffix}"
            taken.add(name)
            store.move(place, f"{root}/{name}")
        self.clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.root)
        self.clear(store, root)

    def clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info([self.temporary(root)])[0].type == fs.FileType.Directory:
            store.delete_dir(self.temporary(root))


class ReportFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "stem string, body string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        if overwrite:
            raise ValueError("reports are only added; take a new folder to write all of them again")
        return ReportWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedFiles)
    spark.dataSource.register(ReportFiles)
