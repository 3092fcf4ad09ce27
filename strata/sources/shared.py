"""The shared working folder and a small file-system helper over Hadoop's API."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """Folder that all executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local session (as in tests) gets a temporary
    folder of its own; a session on a cluster is refused, because its executors
    could not see a folder of the driver's machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    root = getattr(spark, "_strata_root", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strata-")
        spark._strata_root = root
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A new, empty folder below work_root, deleted when the application ends: results that are read from it are lazy."""
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs = Fs(spark, path)
    fs.mkdirs()
    fs.delete_on_exit()
    return path


def own_session(spark: SparkSession, conf: dict[str, object]) -> SparkSession:
    """A copy of a session with some settings of its own; the given session keeps its settings, also for other threads."""
    copy = spark._jsparkSession.cloneSession()
    for name, value in conf.items():
        copy.conf().set(name, str(value))
    return SparkSession(spark.sparkContext, copy)


def within(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df, to be run under the settings of another session of the same application."""
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed())
    return DataFrame(rows, spark)


class Fs:
    """File operations below one root through Hadoop, so any of its file systems will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def is_file(self, name: str = "") -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._path(name)).isFile()

    def mkdirs(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write_bytes(self, name: str, data: bytes) -> None:
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet, complete or not at all; False if it exists."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(temporary), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            return self._publish(temporary, name)
        finally:
            self._fs.delete(self._path(temporary), False)

    def _publish(self, temporary: str, name: str) -> bool:
        """Give a file its name, unless the name is taken. A link on local disks and a rename elsewhere both do it in one step."""
        if self._fs.getScheme() == "file":
            try:
                os.link(*(self._path(n).toUri().getPath() for n in (temporary, name)))
            except FileExistsError:
                return False
            return True
        return not self.exists(name) and self._fs.rename(self._path(temporary), self._path(name))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def delete_on_exit(self) -> None:
        """Delete the root, which must exist, when this application's JVM ends."""
        self._fs.deleteOnExit(self._path(""))
