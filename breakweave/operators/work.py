"""Tables written into the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; where that is unset, on a local master only, a temporary one made once per session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("breakweave.work.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="breakweave-")
        spark.conf.set("breakweave.work.dir", folder)
    return folder.rstrip("/")


class WorkTables:
    """Tables of one call. Results are read from them later, so they stay until ``close``; ``release`` closes all of a session."""

    made: ClassVar[list[WorkTables]] = []

    def __init__(self, spark: SparkSession):
        WorkTables.made.append(self)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/breakweave-{uuid.uuid4().hex}"
        self.n, self.held = 0, []

    def save(self, frame: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "snappy") -> DataFrame:
        """Write a table and return it as read again, partitioned into folders by ``partition_by``."""
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        frame.write.partitionBy(*partition_by).parquet(path, compression=codec)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        saved.work_path = path
        self.held.append(saved)
        return saved

    def write_text(self, lines: DataFrame, name: str) -> str:
        """Write lines of text (one string column) and return the folder."""
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{name}"
        lines.write.text(path)
        return path

    def drop(self, frame: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.work_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        for frame in self.held:
            if not any(frame is x for x in frames):
                self.drop(frame)
        self.held = list(frames)

    def close(self) -> None:
        """Delete the whole folder, once no result is read any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.held = []


def release(spark: SparkSession) -> None:
    """Delete the work tables of all calls in this session; frames returned by them can't be read afterwards."""
    for tables in [t for t in WorkTables.made if t.spark is spark]:
        tables.close()
        WorkTables.made.remove(tables)
