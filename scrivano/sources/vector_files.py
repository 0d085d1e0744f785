"""A second kind of vector collection: Arrow files with a committed list, as a Spark data source.

``df.write.format("vector_files").mode("overwrite").save(path)`` writes one Arrow stream per task, in
batches; only when all tasks have succeeded does the driver write the list of files and rows, so a reader
sees a whole collection or none, and files of failed attempts are in no list. Reading makes one partition
per file and checks that a file still has the rows the list says. The path is any that Arrow can open
(a shared folder, ``hdfs``, ``s3``, ``gs``).
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
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "vector_files"
LIST = "_collection.json"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def committed(path: str) -> dict:
    """The list of a collection: its schema, and name and rows of every file."""
    files, folder = _place(path)
    where = f"{folder}/{LIST}"
    if files.get_file_info(where).type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no vector collection at {path}; build it first")
    with files.open_input_stream(where) as stream:
        return json.loads(stream.read())


class VectorFiles(DataSource):
    """Data source ``vector_files``; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(committed(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return VectorWriter(self.options["path"], schema, overwrite)


@dataclass
class VectorFile(InputPartition):
    name: str
    rows: int


class VectorReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[VectorFile]:
        return [VectorFile(f["name"], f["rows"]) for f in committed(self.path)["files"]]

    def read(self, partition: VectorFile) -> Iterator[pa.RecordBatch]:
        files, folder = _place(self.path)
        rows = 0
        with files.open_input_stream(f"{folder}/{partition.name}") as stream, pa.ipc.open_stream(stream) as reader:
            for batch in reader:
                rows += batch.num_rows
                yield batch
        if rows != partition.rows:
            raise ValueError(f"{partition.name} has {rows} rows instead of {partition.rows}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _place(self.path)
        files.create_dir(folder, recursive=True)
        name, rows = f"{self.run}-{uuid.uuid4().hex}.arrow", 0
        schema = to_arrow_schema(self.schema)
        with files.open_output_stream(f"{folder}/{name}") as stream, pa.ipc.new_stream(stream, schema) as out:
            for batch in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema))
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        new = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.rows]
        before = [] if self.overwrite else self._before()
        text = json.dumps({"schema": self.schema.jsonValue(), "files": before + new})
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{LIST}.{self.run}") as stream:
            stream.write(text.encode())
        files.move(f"{folder}/{LIST}.{self.run}", f"{folder}/{LIST}")

    def _before(self) -> list[dict]:
        try:
            return committed(self.path)["files"]
        except FileNotFoundError:
            return []

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _place(self.path)
        for message in messages:
            if message is not None:
                files.delete_file(f"{folder}/{message.name}")


def write_vectors(collection: DataFrame, path: str, append: bool = False) -> None:
    collection.sparkSession.dataSource.register(VectorFiles)
    collection.write.format(FORMAT).mode("append" if append else "overwrite").option("path", path).save()


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The committed collection; a clear error when it was not built."""
    committed(path)
    spark.dataSource.register(VectorFiles)
    return spark.read.format(FORMAT).option("path", path).load()


def count_vectors(path: str) -> int:
    """Rows of the collection, from its list: nothing is scanned."""
    return sum(f["rows"] for f in committed(path)["files"])
