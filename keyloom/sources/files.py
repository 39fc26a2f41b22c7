"""Files through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = self._path(root)
        self.fs = self.root.getFileSystem(self.conf)

    def _path(self, p: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, sub: str = "") -> list[str]:
        """Names in a folder, sorted; none if it is not there."""
        p = self._path(f"{self.root}/{sub}") if sub else self.root
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, sub: str) -> bool:
        return self.fs.exists(self._path(f"{self.root}/{sub}"))

    def make(self, sub: str = "") -> None:
        self.fs.mkdirs(self._path(f"{self.root}/{sub}") if sub else self.root)

    def delete(self, sub: str) -> None:
        self.fs.delete(self._path(f"{self.root}/{sub}"), True)

    def write_text(self, sub: str, text: str) -> None:
        """Whole or not at all: written aside, then moved over what was there, in one step."""
        aside = self._path(f"{self.root}/.{sub.replace('/', '-')}.new")
        out = self.fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf).rename(aside, self._path(f"{self.root}/{sub}"), how)

    def read_text(self, sub: str) -> str:
        stream = self.fs.open(self._path(f"{self.root}/{sub}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def size(self, sub: str = "") -> int:
        p = self._path(f"{self.root}/{sub}") if sub else self.root
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0

    def uri(self, sub: str) -> str:
        return f"{self.root}/{sub}"
