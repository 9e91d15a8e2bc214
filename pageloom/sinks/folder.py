"""Small files and renames in the file system that Spark reads a path from."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.root = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path
        self.gateway = spark.sparkContext._gateway
        self.files = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in (self.files.globStatus(self.path(pattern)) or []))

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        stream = self.files.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> bool:
        """Whether ``to`` was free and is now what ``name`` was."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.makeQualified(self.path("")).toUri(), self.conf)
        try:
            context.rename(self.path(name), self.path(to), self.gateway.new_array(kind, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)
