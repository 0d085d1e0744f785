"""Intermediate tables in the shared checkpoint folder, dropped when they are no longer needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.session import scratch_path


class Scratch:
    """Written tables of one job. They cut lineage, so lost executors cost one stage at most."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}

    def keep(self, frame: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, name)
        frame.write.parquet(path, compression=codec)
        # What the job shuffled is of no use now; the driver frees such files when it collects garbage.
        self.spark._jvm.System.gc()
        written = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(written)] = path
        return written

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables nothing reads any more."""
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path:
                self._delete(path)

    def drop_all(self) -> None:
        for path in self.paths.values():
            self._delete(path)
        self.paths.clear()

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark._jsc.hadoopConfiguration()
        where.getFileSystem(conf).delete(where, True)


def unused(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each changed where ``names`` holds it in any case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hinted(frame: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The written frame of a few numbers a row, for broadcast where it has at most ``most`` rows."""
    return F.broadcast(frame) if frame.count() <= most else frame
