"""Files of a lake through Spark's Hadoop file systems, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tarn.errors import LakeError


class FileSystem:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def delete(self, path: str, recursive: bool = False) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, recursive)

    def rename(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(to)):
            raise LakeError(f"can't move {path}")

    def reported(self, path: str) -> str:
        """A path as Spark's _metadata.file_path shows it."""
        return self._jvm.org.apache.spark.paths.SparkPath.fromPathString(self.canonical(path)).urlEncoded()

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))

    def walk(self, path: str) -> list[tuple[str, int, int]]:
        """(path, size, modification time in ms) of all files below a folder."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def canonical(self, path: str) -> str:
        fs, p = self._at(path)
        return p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(data)
        finally:
            stream.close()
