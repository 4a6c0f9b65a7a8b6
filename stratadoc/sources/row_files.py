"""A writer of one file per row, for batches and streams: all files of a batch appear, or none.

Tasks write below a hidden folder of their own run and report what they wrote. The commit on the driver
gives the files their names and leaves a mark for the batch; an abort removes the run's folder. A batch
that is committed already is dropped, so a replay changes nothing.

    spark.dataSource.register(RowFiles)
    rows.write.format("row_files").mode("append").save(folder)          # name string, content string or binary
    stream.writeStream.format("row_files").option("path", folder)...
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: their folder, with a list of their names, and how many. No name is sent to the driver."""

    folder: str
    count: int


class _Files:
    """What both kinds of writers do."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def _put(self, rows: Iterator) -> Written:
        store, root = file_system(self.path)
        own = f"{root}/_pending/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        count = 0
        with store.open_output_stream(f"{own}/names") as names:
            for row in rows:
                if row["name"] is None or row["content"] is None:
                    continue
                content = row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"])
                with store.open_output_stream(f"{own}/{count}") as sink:
                    sink.write(content)
                names.write(json.dumps(row["name"]).encode() + b"\n")
                count += 1
        # Other tasks may still run when the batch is given up: either they see the mark, or the abort sees their files.
        if store.get_file_info(f"{root}/_aborted/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(own)
            raise RuntimeError("the batch was aborted")
        return Written(own, count)

    def _clear(self) -> None:
        store, root = file_system(self.path)
        pending = f"{root}/_pending/{self.run}"
        if store.get_file_info(pending).type != fs.FileType.NotFound:
            store.delete_dir(pending)

    def _give_up(self) -> None:
        store, root = file_system(self.path)
        store.create_dir(f"{root}/_aborted", recursive=True)
        store.open_output_stream(f"{root}/_aborted/{self.run}").close()
        self._clear()

    def _publish(self, messages: list[Written | None], batch: str) -> None:
        store, root = file_system(self.path)
        mark = f"{root}/_commits/{batch}.json"
        if store.get_file_info(mark).type == fs.FileType.NotFound:
            written = [m for m in messages if m is not None]
            for message in written:
                with store.open_input_stream(f"{message.folder}/names") as names:
                    for number, name in enumerate(io.TextIOWrapper(names, "utf-8")):
                        target = f"{root}/{json.loads(name)}"
                        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                        store.move(f"{message.folder}/{number}", target)
            store.create_dir(f"{root}/_commits", recursive=True)
            with store.open_output_stream(f"{mark}.new") as sink:
                sink.write(json.dumps({"batch": batch, "files": sum(m.count for m in written)}).encode())
            store.move(f"{mark}.new", mark)
        self._clear()


class BatchFiles(_Files, DataSourceWriter):
    def write(self, iterator: Iterator) -> Written:
        return self._put(iterator)

    def commit(self, messages) -> None:
        self._publish(messages, self.run)

    def abort(self, messages) -> None:
        self._give_up()


class StreamFiles(_Files, DataSourceStreamWriter):
    def write(self, iterator: Iterator) -> Written:
        return self._put(iterator)

    def commit(self, messages, batchId: int) -> None:
        self._publish(messages, f"batch-{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self._give_up()


class RowFiles(DataSource):
    """``row_files``: rows of ``name, content``; a row without either is left out."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchFiles(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return StreamFiles(self.options["path"])
