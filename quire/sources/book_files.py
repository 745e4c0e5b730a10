"""A data source that writes a file per row: tasks write aside, a commit moves the files in place, a failed job leaves none."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

FORMAT = "book_files"
DONE = "_SUCCESS"
#: Bytes of a file's name before it is cut and told apart by a digest.
LONGEST_NAME = 180


def file_name(book_id: str | None, extension: str) -> str:
    """A name for a book's file: the id with anything but letters, digits and `-.~` escaped, so that different ids have different names."""
    name = quote(book_id or "", safe="~").replace("_", "%5F")
    if not name or name[0] == ".":
        name = "%" + name
    if len(name) > LONGEST_NAME:
        name = f"{name[: LONGEST_NAME - 33]}-{hashlib.sha256(name.encode()).hexdigest()[:32]}"
    return f"{name}.{extension}"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its own folder, and how much is in it."""

    folder: str
    files: int
    size: int


class BookWriter(DataSourceWriter):
    """Made and ended on the driver (commit, abort), runs in tasks (write). An attempt has its own folder, so one that is lost or repeated leaves nothing that a commit takes.

    The job's folder is made with the writer, and tasks make theirs only inside it: one that is still running when the job has been aborted fails instead of writing on.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        store, base = self._store()
        store.create_dir(self._aside(base))

    def _store(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, base.rstrip("/")

    def _aside(self, base: str) -> str:
        return f"{base}/_temporary-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = self._store()
        folder, files, size = f"{self._aside(base)}/{uuid.uuid4().hex}", 0, 0
        store.create_dir(folder, recursive=False)
        seen: set[str] = set()
        for row in iterator:
            if row["name"] in seen:
                raise ValueError(f"two rows want the file {row['name']}")
            seen.add(row["name"])
            with store.open_output_stream(f"{folder}/{row['name']}") as out:
                out.write(bytes(row["content"]))
            files, size = files + 1, size + len(row["content"])
        return Written(folder, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = self._store()
        here = lambda folder: store.get_file_info(fs.FileSelector(folder))
        for info in here(base):
            if info.base_name == DONE or self.overwrite and not info.base_name.startswith("_temporary-"):
                (store.delete_file if info.is_file else store.delete_dir)(info.path)
        done = [m for m in messages if m is not None]
        for m in done:
            for info in here(m.folder):
                store.move(info.path, f"{base}/{info.base_name}")
        self._clear(store, base)
        with store.open_output_stream(f"{base}/{DONE}") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._aside(base)).type == fs.FileType.Directory:
            store.delete_dir(self._aside(base))


class BookFiles(DataSource):
    """Format `book_files`: rows (name, content) as files of a folder in any store that pyarrow opens. Mode append replaces files of the same name, overwrite all that the folder holds."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        kinds = {f.name: f.dataType for f in schema.fields}
        if kinds != {"name": StringType(), "content": BinaryType()}:
            raise ValueError("files are made of rows (name string, content binary)")
        if not self.options.get("path"):
            raise ValueError("an output path is needed")
        return BookWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows(name, content) as files of a folder that driver and executors share."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(BookFiles)
    rows.select("name", "content").write.format(FORMAT).mode(mode).save(path)
