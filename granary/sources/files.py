"""Small files through Hadoop's file systems, so that a workspace may be in any store Spark can use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``. A local session
    without that setting uses a temporary one; on a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return bool(fs.exists(at))

    def make_dir(self, path: str) -> None:
        at, fs = self._at(path)
        fs.mkdirs(at)

    def remove(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)

    def children(self, path: str) -> list[tuple[str, bool, int]]:
        """(name, whether a folder, bytes) of what is in a folder, by name."""
        at, fs = self._at(path)
        if not fs.exists(at):
            return []
        return sorted((s.getPath().getName(), bool(s.isDirectory()), int(s.getLen())) for s in fs.listStatus(at))

    def total(self, path: str) -> tuple[int, int]:
        """The number and the bytes of the files below a folder, but for the mark of its completion."""
        at, fs = self._at(path)
        found = fs.getContentSummary(at)
        mark = fs.exists(self.jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
        return int(found.getFileCount()) - bool(mark), int(found.getLength())

    def read(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @contextmanager
    def writing(self, path: str) -> Iterator[Callable[[bytes], None]]:
        """A function that adds bytes to a new file, which takes the place of an old one."""
        at, fs = self._at(path)
        stream = fs.create(at, True)
        try:
            yield lambda raw: stream.write(bytearray(raw), 0, len(raw))
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write beside the file, then move over it: readers see the old or the new text."""
        self._moved(path, text, "OVERWRITE")

    def create(self, path: str, text: str) -> bool:
        """Write a file that does not exist yet. False if there is one already, which then stays. Of
        several that try at once one succeeds, if the store renames atomically, as HDFS does."""
        at, fs = self._at(path)
        if fs.exists(at):
            return False
        try:
            self._moved(path, text, "NONE")
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def _moved(self, path: str, text: str, how: str) -> None:
        at, fs = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.new")
        stream = fs.create(beside, True)
        try:
            self.jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, how)
        try:
            context.rename(beside, at, options)
        except Py4JJavaError:
            fs.delete(beside, False)
            raise
