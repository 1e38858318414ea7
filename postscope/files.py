"""Names, small texts and removal below one folder, through the session's Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._at(old), self._at(new))

    def write_text(self, name: str, text: str) -> None:
        """The file appears whole or not at all."""
        tmp = f"{name.rpartition('/')[0]}/_tmp-{name.rpartition('/')[2]}".lstrip("/")
        out = self._fs.create(self._at(tmp), True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(self._at(name), False)
        self.rename(tmp, name)

    def read_text(self, name: str) -> str:
        src = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(src, "UTF-8")
        finally:
            src.close()
