"""Small files through Spark's own file systems, so that any path Spark reads works."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share: ``spark.checkpoint.dir`` as the session has it.

    Only where the setting is missing and the session runs in one local JVM is
    a temporary folder made, as in tests; a cluster without it is an error.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{CHECKPOINT_DIR} must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="sedimo-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(CHECKPOINT_DIR, f"file://{made}")
    return f"file://{made}"


class Appender:
    """A file that grows by whole records; a record is out of this process when :meth:`add` returns.

    Where the file system can flush a file that is open, so does a killed
    writer's file hold all records; with ``sync`` they are on disk too.
    """

    def __init__(self, stream, sync: bool):
        self.stream, self.sync = stream, sync

    def add(self, data: bytes) -> None:
        self.stream.write(bytearray(data))
        (self.stream.hsync if self.sync else self.stream.hflush)()

    def close(self) -> None:
        self.stream.close()


class Files:
    """Whole-file access under one file system; for metadata, never for rows of a table."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def mkdirs(self, folder: str) -> None:
        self.fs.mkdirs(self._path(folder))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes, sync: bool = False) -> bool:
        """Write a new file, to the disk itself with ``sync``; False where one of that name is there.

        The data is written beside and renamed, so a file is whole or absent.
        Where a file system has no atomic rename that refuses to overwrite, as
        some object stores, only one process may write at a time.
        """
        path, draft = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        if self.fs.exists(path):
            return False
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(data))
            if sync:
                stream.hsync()
        finally:
            stream.close()
        if not self.fs.exists(path) and self.fs.rename(draft, path):
            return True
        self.fs.delete(draft, False)
        return False

    def appender(self, name: str, sync: bool = False) -> Appender | None:
        """A new file that is open for appending; None where one of that name is there."""
        path = self._path(name)
        if self.fs.exists(path):
            return None
        # The checksums of a local file system are written in blocks, which a killed process would lose.
        hadoop = self._jvm.org.apache.hadoop.fs.FileSystem
        fs = hadoop.getLocal(self.fs.getConf()).getRawFileSystem() if self.fs.getUri().getScheme() == "file" else self.fs
        return Appender(fs.create(path, False), sync)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
