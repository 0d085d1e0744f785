"""A text file per row, many rows at once: a folder of texts with a committed list, as a Spark data source.

``write_texts`` writes the column ``value`` of every row, with a line break at its end, to a file that the
column ``name`` names. A task writes a folder of its own with numbered folders in it, each of at most
``FOLDER_FILES`` files or, but for its last file, ``FOLDER_BYTES`` bytes; a name that comes again goes to the
next folder, so no row covers another. Files are opened and closed, nothing else: no process is started for
a file's mode, and the driver moves none. It writes the list of the tasks' folders once all have
succeeded; files of failed attempts are in no list. Reading makes one partition per numbered folder, so the
driver lists no file, and checks that a folder still has as many files as the list says. The path is any
that Arrow can open (a shared folder, ``hdfs``, ``s3``, ``gs``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "text_files"
LIST = "_texts.json"
FOLDER_FILES = 1_000
FOLDER_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
SCHEMA = "path string, filename string, value string"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _committed(path: str) -> list[dict]:
    """Name of every task's folder and the numbers of files in its numbered folders."""
    files, folder = _place(path)
    with files.open_input_stream(f"{folder}/{LIST}") as stream:
        return json.loads(stream.read())


def holds(path: str) -> bool:
    """Whether ``path`` is a folder that ``write_texts`` has written."""
    try:
        files, folder = _place(path)
    except (pa.ArrowException, OSError):  # a store that Arrow does not know
        return False
    return files.get_file_info(f"{folder}/{LIST}").type == pafs.FileType.File


class TextFiles(DataSource):
    """Data source ``text_files``; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TextReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TextWriter(self.options["path"])


@dataclass
class Folder(InputPartition):
    name: str
    files: int


class TextReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Folder]:
        return [Folder(f"{t['name']}/{i}", n) for t in _committed(self.path) for i, n in enumerate(t["files"])]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark reads once where there is no partition
            return
        files, folder = _place(self.path)
        found = files.get_file_info(pafs.FileSelector(f"{folder}/{partition.name}"))
        if len(found) != partition.files:
            raise ValueError(f"{partition.name} has {len(found)} files instead of {partition.files}")
        names, texts, size = [], [], 0
        for info in found:
            with files.open_input_stream(info.path) as stream:
                texts.append(stream.read())
            names.append(info.base_name)
            size += len(texts[-1])
            if size >= BATCH_BYTES:
                yield self._batch(partition, names, texts)
                names, texts, size = [], [], 0
        if names:
            yield self._batch(partition, names, texts)

    def _batch(self, partition: Folder, names: list[str], texts: list[bytes]) -> pa.RecordBatch:
        paths = [f"{self.path}/{partition.name}/{n}" for n in names]
        # Bytes stay as they are, whatever they encode.
        values = pa.array(texts, pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(names), values], names=["path", "filename", "value"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    files: list[int]


class TextWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _place(self.path)
        name, counts, taken, size = f"texts-{uuid.uuid4().hex}", [], set(), 0
        for batch in iterator:
            texts = batch.column("value").cast(pa.binary()).to_pylist()
            for file, text in zip(batch.column("name").to_pylist(), texts):
                text = (text or b"") + b"\n"
                if not file or "/" in file:
                    raise ValueError(f"no file can be named {file!r}")
                if not counts or file in taken or len(taken) >= FOLDER_FILES or size >= FOLDER_BYTES:
                    counts.append(0)
                    taken, size = set(), 0
                    files.create_dir(f"{folder}/{name}/{len(counts) - 1}", recursive=True)
                with files.open_output_stream(f"{folder}/{name}/{len(counts) - 1}/{file}") as stream:
                    stream.write(text)
                taken.add(file)
                counts[-1] += 1
                size += len(text)
        return Written(name, counts)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        tasks = [{"name": m.name, "files": m.files} for m in messages if m is not None and m.files]
        files.create_dir(folder, recursive=True)
        draft = f"{folder}/{LIST}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            stream.write(json.dumps(tasks).encode())
        files.move(draft, f"{folder}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        for message in messages:
            if message is not None and message.files:
                files.delete_dir(f"{folder}/{message.name}")


def write_texts(texts: DataFrame, path: str) -> None:
    """A file per row of ``name, value``; a folder that holds texts already is replaced as a whole."""
    texts.sparkSession.dataSource.register(TextFiles)
    texts.select("name", "value").write.format(FORMAT).mode("overwrite").option("path", path).save()


def open_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, filename, value`` of every committed file."""
    spark.dataSource.register(TextFiles)
    return spark.read.format(FORMAT).option("path", path).load()
